"""Causal effects of factors on the portfolio: regression effects, intervals, discovery, shocks.

The variables of one book form a wide daily table. Every regression needs only its moment matrix,
so a moment matrix per (book, replicate) is summed by Spark and each edge is solved from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from bookheat import constants as C
from bookheat.functions import fits
from bookheat.functions import linalg as L

VARIABLES = [*C.FACTORS, C.PORTFOLIO_NODE]


def daily_table(returns: DataFrame, factors: DataFrame, books: DataFrame, value: str = "ret") -> DataFrame:
    """(book_id, t, one column per variable): factor returns and the equal-weight book return."""
    wide = (
        returns.join(factors, "symbol").groupBy("t").pivot("factor", list(C.FACTORS)).agg(F.first(value))
    )
    port = (
        books.select("book_id", "symbol").join(returns, "symbol").groupBy("book_id", "t").agg(F.avg(value).alias(C.PORTFOLIO_NODE))
    )
    return port.join(wide, "t").dropna(subset=VARIABLES)


def _moments(df: DataFrame, keys: list[str], left: list[str], right: list[str]) -> DataFrame:
    """Σ left·right as one flat array per key, row-major, plus the row count."""
    sums = [F.sum(F.col(a) * F.col(b)) for a in left for b in right]
    return df.groupBy(*keys).agg(F.array(*sums).alias("m"), F.count("*").alias("n"))


def edge_rows(edges=C.CAUSAL_EDGES) -> Column:
    """Array of edges with the indexes of treatment, outcome and controls."""
    return F.array(
        *[
            F.struct(
                F.lit(s).alias("source"),
                F.lit(t).alias("target"),
                F.array(*[F.lit(VARIABLES.index(v)) for v in (s, *[c for c in C.CONFOUNDERS if c not in (s, t)])]).alias("x"),
                F.lit(VARIABLES.index(t)).alias("y"),
            )
            for s, t in edges
        ]
    )


def _coefficient(full: np.ndarray, x: list[int], y: int) -> float:
    """First slope of y on x from the moment matrix whose index 0 is the constant."""
    idx = [0, *[i + 1 for i in x]]
    return float(np.linalg.lstsq(full[np.ix_(idx, idx)], full[idx, y + 1], rcond=None)[0][1])


@F.pandas_udf(DoubleType())
def _slope(m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    k = len(VARIABLES) + 1
    return pd.Series([_coefficient(np.asarray(a).reshape(k, k), list(b), int(c)) for a, b, c in zip(m, x, y)])


def shuffled_rows(row: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Where each row number below ``n`` goes under the permutation that ``key`` names.

    A Feistel network on numbers written with two digits, of base about the root of ``n``: each round adds a hash of one digit to the other,
    which is a bijection. The few numbers from ``n`` on are walked through until they fall below it.
    """
    n, out = n.astype(np.int64), row.astype(np.int64).copy()
    low = np.maximum(np.ceil(np.sqrt(n)).astype(np.int64), 1)
    high = -(-n // low)

    def hashed(digit: np.ndarray, at: np.ndarray, turn: int) -> np.ndarray:
        x = key[at].astype(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) + digit.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)

    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] // low[todo], out[todo] % low[todo]
        for turn in range(rounds):
            if turn % 2:
                b = (b + hashed(a, todo, turn)) % low[todo]
            else:
                a = (a + hashed(b, todo, turn)) % high[todo]
        out[todo] = a * low[todo] + b
        todo = todo[out[todo] >= n[todo]]
    return out


def permuted(numbered: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(book_id, rep, row, place): every row of every book with its place in each replicate, no row sorted or gathered."""
    kind = dict(numbered.dtypes)["book_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, n, own = (b.column(c).to_numpy() for c in ("row", "rows", "own"))
            for rep in range(1, replicates + 1):
                key = own.astype(np.uint64) ^ np.uint64(rep * 0xD6E8FEB86659FD93 % (1 << 64))
                cols = [b.column("book_id"), pa.array(np.full(len(row), rep, np.int32)), pa.array(row, pa.int32()), pa.array(shuffled_rows(row, n, key), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["book_id", "rep", "row", "place"])

    keyed = numbered.select("book_id", F.col("row").cast("int").alias("row"), F.col("rows").cast("long").alias("rows"), F.xxhash64(F.lit(seed), F.col("book_id").cast("string")).alias("own"))
    return keyed.mapInArrow(run, f"book_id {kind}, rep int, row int, place int")


def permutation_p(numbered: DataFrame, point: DataFrame, edges=C.CAUSAL_EDGES, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(book_id, source, target, p_value): how often the correlation of the shuffled treatment with the outcome is at least the effect.

    ``numbered`` is the daily table with ``row`` (from 0) and ``rows`` per book, ``point`` the effects. The share is at
    least one over the replicates and one. A book's treatments are shuffled alike in a replicate.
    """
    treated = sorted({s for s, _ in edges})
    left = permuted(numbered, replicates, seed).join(numbered.select("book_id", "row", *[F.col(c).alias(f"p_{c}") for c in treated]), ["book_id", "row"])
    right = numbered.select("book_id", F.col("row").alias("place"), *sorted({t for _, t in edges}))
    sums = left.join(right, ["book_id", "place"]).groupBy("book_id", "rep").agg(F.array(*[F.sum(F.col(f"p_{s}") * F.col(t)) for s, t in edges]).alias("xy"))
    named = sorted({v for e in edges for v in e})
    base = numbered.groupBy("book_id").agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m_{v}") for v in named], *[F.stddev_pop(v).alias(f"s_{v}") for v in named])
    spread_of = lambda s, t: F.col(f"s_{s}") * F.col(f"s_{t}")
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("source"),
                F.lit(t).alias("target"),
                F.when(spread_of(s, t) > 0, (F.col("xy")[k] / F.col("n") - F.col(f"m_{s}") * F.col(f"m_{t}")) / spread_of(s, t)).alias("corr"),
            )
            for k, (s, t) in enumerate(edges)
        ]
    )
    keys = ["book_id", "source", "target"]
    seen = sums.join(base, "book_id").select("book_id", F.explode(rows).alias("e")).select("book_id", "e.*").join(point.select(*keys, "effect"), keys)
    share = F.avg(F.coalesce(F.abs("corr") >= F.abs("effect"), F.lit(False)).cast("double"))
    return seen.groupBy(*keys).agg(F.greatest(share, F.lit(1.0 / (replicates + 1))).alias("p_value"))


def effects(table: DataFrame, edges=C.CAUSAL_EDGES, min_rows: int = 60) -> DataFrame:
    """Confounder-adjusted effect of every known edge: (book_id, source, target, effect, n)."""
    cols = ["_one", *VARIABLES]
    m = _moments(table.withColumn("_one", F.lit(1.0)), ["book_id"], cols, cols).filter(F.col("n") >= min_rows)
    e = m.withColumn("e", F.explode(edge_rows(edges)))
    return e.select("book_id", "e.source", "e.target", _slope("m", "e.x", "e.y").alias("effect"), "n")


def intervals(
    table: DataFrame, edges=C.CAUSAL_EDGES, bootstraps: int = 100, replicates: int = 200, min_rows: int = 60, seed: int = 42
) -> DataFrame:
    """Effects with percentile intervals from resampled rows and p values from permuted treatments (``permutation_p``).

    Draws are hashes of (seed, replicate, row), so reruns and other partitionings give equal output.
    """
    cols = ["_one", *VARIABLES]
    w = Window.partitionBy("book_id").orderBy("t")
    numbered = (
        table.withColumn("_one", F.lit(1.0))
        .withColumn("row", F.row_number().over(w) - 1)
        .withColumn("rows", F.count("*").over(Window.partitionBy("book_id")))
        .filter(F.col("rows") >= min_rows)
    )
    point = effects(table, edges, min_rows)

    draws = numbered.select(
        "book_id", "row", "rows", F.explode(F.sequence(F.lit(1), F.lit(bootstraps))).alias("rep")
    ).select(
        "book_id", "rep", F.pmod(F.xxhash64(F.lit(seed), "rep", "row"), F.col("rows")).cast("int").alias("row")
    )
    boot = _moments(draws.join(numbered, ["book_id", "row"]), ["book_id", "rep"], cols, cols)
    slopes = boot.withColumn("e", F.explode(edge_rows(edges))).select(
        "book_id", "e.source", "e.target", _slope("m", "e.x", "e.y").alias("b")
    )
    ci = slopes.groupBy("book_id", "source", "target").agg(
        F.percentile("b", 0.025).alias("ci_lower"), F.percentile("b", 0.975).alias("ci_upper")
    )

    keys = ["book_id", "source", "target"]
    p = permutation_p(numbered, point, edges, replicates, seed)
    return point.join(ci, keys).join(p, keys)


def regression_effects(table: DataFrame, edges=C.CAUSAL_EDGES) -> DataFrame:
    """Fallback estimate: effect, t-test p value and ±1.96 standard errors (no intercept column in the errors)."""
    cols = ["_one", *VARIABLES]
    m = _moments(table.withColumn("_one", F.lit(1.0)), ["book_id"], cols, cols)
    k = len(cols)

    def one(rec: dict) -> list[tuple]:
        full = rec["m"][0].reshape(k, k)
        return [(s, t, *_ols_effect(full, float(rec["n"][0]), s, t)) for s, t in edges]

    packed = m.select("book_id", F.array(F.struct("m", "n")).alias("items"))
    return L.map_packed(
        packed, ["book_id"], one,
        "source string, target string, effect double, p_value double, ci_lower double, ci_upper double",
    )


def _ols_effect(full: np.ndarray, n: float, source: str, target: str) -> tuple[float, float, float, float]:
    x = [VARIABLES.index(v) for v in (source, *[c for c in C.CONFOUNDERS if c not in (source, target)])]
    y = VARIABLES.index(target) + 1
    idx = [0, *[i + 1 for i in x]]
    coef = np.linalg.lstsq(full[np.ix_(idx, idx)], full[idx, y], rcond=None)[0]
    sse = float(full[y, y] - coef @ full[idx, y])
    df = n - len(x) - 1
    se = math.sqrt(max(sse / df * np.linalg.pinv(full[np.ix_(idx[1:], idx[1:])])[0, 0], 0))
    effect = float(coef[1])
    p = fits.t_two_sided(abs(effect / se), df) if se > 0 else 1.0
    return effect, p, effect - 1.96 * se, effect + 1.96 * se


def discover(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Directed edges found by the PC search on each book's correlation matrix, with their effects."""
    cols = ["_one", *VARIABLES]
    m = _moments(table.withColumn("_one", F.lit(1.0)), ["book_id"], cols, cols)
    k = len(cols)

    def one(rec: dict) -> list[tuple]:
        full, n = rec["m"][0].reshape(k, k), float(rec["n"][0])
        mean = full[0, 1:] / n
        cov = full[1:, 1:] / n - np.outer(mean, mean)
        s = np.sqrt(np.maximum(np.diag(cov), 1e-300))
        found = fits.pc_edges(cov / np.outer(s, s), int(n), alpha)
        return [
            (VARIABLES[i], VARIABLES[j], *_ols_effect(full, n, VARIABLES[i], VARIABLES[j])) for i, j in found
        ]

    packed = m.select("book_id", F.array(F.struct("m", "n")).alias("items"))
    return L.map_packed(
        packed, ["book_id"], one,
        "source string, target string, effect double, p_value double, ci_lower double, ci_upper double",
    )


def significant(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    return edges.filter(F.col("p_value") < alpha)


def intervene(edges: DataFrame, deviations: DataFrame, shocks: DataFrame) -> DataFrame:
    """Direct and one-hop indirect portfolio impact of shocking a factor by ``k`` deviations.

    ``deviations`` (book_id, factor, std), ``shocks`` (book_id, factor, k); an unknown factor counts
    as one percent.
    """
    port = C.PORTFOLIO_NODE
    size = shocks.join(deviations, ["book_id", "factor"], "left").withColumn(
        "shock", F.col("k") * F.coalesce("std", F.lit(0.01))
    )
    direct = edges.filter(F.col("target") == port).select("book_id", F.col("source").alias("factor"), F.col("effect").alias("direct"))
    hop1 = edges.filter(F.col("target") != port).select(
        "book_id", F.col("source").alias("factor"), F.col("target").alias("mid"), F.col("effect").alias("e1")
    )
    hop2 = direct.select("book_id", F.col("factor").alias("mid"), F.col("direct").alias("e2"))
    indirect = (
        hop1.join(hop2, ["book_id", "mid"])
        .groupBy("book_id", "factor")
        .agg(F.sum(F.col("e1") * F.col("e2")).alias("indirect"))
    )
    zero = F.lit(0.0)
    return (
        size.join(direct, ["book_id", "factor"], "left")
        .join(indirect, ["book_id", "factor"], "left")
        .select(
            "book_id",
            "factor",
            "k",
            "shock",
            (F.coalesce("direct", zero) * F.col("shock")).alias("direct_impact"),
            (F.coalesce("indirect", zero) * F.col("shock")).alias("indirect_impact"),
        )
        .withColumn("total_impact", F.col("direct_impact") + F.col("indirect_impact"))
    )


def export(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rounded edge rows with a significance flag."""
    return edges.select(
        "book_id",
        "source",
        "target",
        F.round("effect", 6).alias("effect"),
        F.round("p_value", 4).alias("p_value"),
        F.round("ci_lower", 6).alias("ci_lower"),
        F.round("ci_upper", 6).alias("ci_upper"),
        (F.col("p_value") < alpha).alias("significant"),
    )

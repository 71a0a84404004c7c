"""Covariance and correlation of symbols.

Each symbol becomes one vector whose inner products are the wanted moments. Scalars such as the
mean correlation follow from vector sums, linear in the number of symbols. Where pairs themselves
are the answer, symbols are hashed into blocks and numpy multiplies block by block, so a pair
exists as a row only if it is part of the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.functions import arrays as A
from bookheat.functions.linalg import map_packed
from bookheat.session import spread

BLOCK = 512


def series(returns: DataFrame, value: str, last: int | None = None) -> DataFrame:
    """One array of returns per symbol over the newest ``last`` dates, oldest first."""
    if last is not None:
        newest = returns.agg(F.max("t")).scalar()
        returns = returns.filter(F.col("t") > newest - last)
    return (
        returns.groupBy("symbol")
        .agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("v")))).alias("s"))
        .select("symbol", F.transform("s", lambda e: e["v"]).alias("x"))
    )


def ewma_vectors(df: DataFrame, span: int = C.EWMA_SPAN) -> DataFrame:
    """Adds ``c`` (EWMA covariance vectors, debiased) and ``z`` (unit vectors)."""
    return A.with_unit(A.with_ewma_centered(df, "x", "c", span, debias=True), "c", "z")


def sample_vectors(df: DataFrame) -> DataFrame:
    """Adds ``c`` (sample covariance vectors) and ``z`` (unit vectors)."""
    return A.with_unit(A.with_centered(df, "x", "c"), "c", "z")


def _blocked(vectors: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Send every symbol to each pair of blocks it takes part in."""
    per = vectors.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sized = vectors.join(per, keys) if keys else vectors.withColumn("blocks", per.scalar())
    own = F.pmod(F.xxhash64("symbol"), F.col("blocks")).cast("int")
    return (
        sized.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("bi", F.least("own", "other"))
        .withColumn("bj", F.greatest("own", "other"))
    )


def pair_values(
    vectors: DataFrame,
    keys: list[str],
    cols: list[str],
    keep: str = "all",
    threshold: float = 0.0,
    block: int = BLOCK,
) -> DataFrame:
    """Inner products of symbol vectors: (keys, a, b, *cols) with a < b.

    ``keep``: all pairs, only ``edges`` with |first column| >= threshold, or the ``top`` pair.
    """
    packed = (
        spread(_blocked(vectors, keys, block), *keys, "bi", "bj")
        .groupBy(*keys, "bi", "bj")
        .agg(F.array_sort(F.collect_list(F.struct("symbol", "own", "bi", "bj", *cols))).alias("items"))
    )

    def products(rec: dict) -> list[tuple]:
        names = np.array(rec["symbol"], dtype=object)
        own, bi, bj = rec["own"], rec["bi"][0], rec["bj"][0]
        if bi == bj:
            i, j = np.triu_indices(len(names), 1)
        else:
            li, ri = np.nonzero(own == bi)[0], np.nonzero(own == bj)[0]
            i, j = (a.ravel() for a in np.meshgrid(li, ri, indexing="ij"))
            i, j = np.minimum(i, j), np.maximum(i, j)
        if len(i) == 0:
            return []
        mats = [rec[c] @ rec[c].T for c in cols]
        first = np.abs(mats[0][i, j])
        if keep == "edges":
            sel = np.nonzero(first >= threshold)[0]
        elif keep == "top":
            sel = np.array([int(np.argmax(first))])
        else:
            sel = np.arange(len(i))
        i, j = i[sel], j[sel]
        return list(zip(names[i], names[j], *[m[i, j].tolist() for m in mats]))

    columns = "a string, b string, " + ", ".join(f"{c} double" for c in cols)
    out = map_packed(packed, [*keys, "bi", "bj"], products, columns).drop("bi", "bj")
    if keep == "top":
        best = F.max_by(F.struct("a", "b", *cols), F.struct(F.abs(cols[0]), F.col("a"), F.col("b"))).alias("m")
        out = out.groupBy(*keys).agg(best).select(*keys, "m.*")
    return out


def avg_pairwise(members: DataFrame, keys: list[str]) -> DataFrame:
    """Mean off-diagonal correlation from unit vectors ``z``: (|Σz|² - Σ|z|²)/(n(n-1)).

    One pass, linear in the number of symbols: no pair is formed. Zero for fewer than two symbols.
    The outer explode keeps the optimizer from copying the vector expression into a size filter.
    """
    v = F.col("_v")
    per_step = (
        members.select(*keys, F.posexplode_outer("z").alias("_k", "_v"))
        .groupBy(*keys, "_k")
        .agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"), F.count("*").alias("_n"))
    )
    tot = per_step.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("_sq"), F.sum("_q").alias("_diag")
    )
    value = (F.col("_sq") - F.col("_diag")) / (F.col("n") * (F.col("n") - 1))
    return tot.select(*keys, "n", F.when(F.col("n") < 2, 0.0).otherwise(value).alias("avg_corr"))


def market_beta(windowed: DataFrame, market: str, keys: list[str]) -> DataFrame:
    """Slope of each symbol on the market symbol within the same window."""
    c = A.with_centered(windowed, "x", "c")
    m = c.filter(F.col("symbol") == market).select(*keys, F.col("c").alias("mc"))
    joined = c.join(m, keys) if keys else c.withColumn("mc", m.select("mc").scalar())
    return joined.select(
        *keys, "symbol", F.try_divide(A.dot(F.col("c"), F.col("mc")), A.dot(F.col("mc"), F.col("mc"))).alias("beta")
    )


def cross_sectional_std(returns: DataFrame, keys: list[str], value: str, last: int) -> DataFrame:
    """Per-date standard deviation over symbols and its mean over the newest ``last`` dates."""
    per = returns.groupBy(*keys, "t", "date").agg(F.stddev_samp(value).alias("cs_std"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(-(last - 1), 0)
    return per.withColumn("dispersion", F.avg("cs_std").over(w))

"""Share of each position in its book's heat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bookheat import constants as C
from bookheat.functions import arrays as A
from bookheat.functions import linalg as L
from bookheat.functions import rules as R
from bookheat.operators import metrics as M

#: Symbols up to which books are rows of one matrix over all of them.
MAX_DENSE_SYMBOLS = 512


def symbol_vectors(windowed: DataFrame, exposures: DataFrame, span: int = C.EWMA_SPAN) -> DataFrame:
    """Per symbol: unit EWMA vector ``z``, covariance vector ``c``, factor betas and dominant factor."""
    base = A.with_centered(windowed, "x", "c")
    base = A.with_unit(A.with_ewma_centered(base, "x", "_e", span), "_e", "z").select("t", "symbol", "c", "z")
    betas = exposures.groupBy("t", "symbol").agg(
        F.array_sort(F.collect_list(F.struct("factor", "beta"))).alias("f"),
        F.max_by(F.struct("factor", "beta"), F.struct(F.abs("beta"), "factor")).alias("d"),
    )
    none = F.transform(F.sequence(F.lit(1), F.lit(len(C.FACTORS))), lambda i: F.lit(0.0))
    return base.join(betas, ["t", "symbol"], "left").select(
        "t",
        "symbol",
        "c",
        "z",
        F.coalesce(F.transform("f", lambda e: e["beta"]), none).alias("betas"),
        F.coalesce("d.factor", F.lit("")).alias("dominant_factor"),
        F.coalesce("d.beta", F.lit(0.0)).alias("dominant_beta"),
    )


_PARTS = (
    "symbol string, weight double, corr_contribution double, factor_contribution double, risk_contribution double, "
    "dominant_factor string, dominant_beta double, heat_share double"
)


def _share(raw: np.ndarray, owner: np.ndarray, count: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """``raw`` over its sum per book, ``otherwise`` where that is not positive."""
    total = np.bincount(owner, raw, len(count))[owner]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, raw / total, otherwise)


def _parts(owner: np.ndarray, at: np.ndarray, w: np.ndarray, books: int, pairs: np.ndarray, cov: np.ndarray, betas: np.ndarray) -> tuple[np.ndarray, ...]:
    """Correlation, factor and risk contribution and heat share of positions: book ``owner`` holds ``w`` of the symbol on the place ``at``.

    ``pairs`` are absolute correlations and ``cov`` covariances of all symbols; books are rows of one matrix over the symbols.
    """
    count = np.bincount(owner, minlength=books)
    held = np.bincount(owner * len(pairs) + at, w, books * len(pairs)).reshape(books, len(pairs))
    n, some = count[owner], count[owner] >= 2
    off = pairs - np.diag(np.diag(pairs))
    # a symbol that a book lists twice is another position to itself
    corr = w * ((held @ off)[owner, at] + np.diag(pairs)[at] * (held[owner, at] - w))
    corr = np.where(some, _share(corr, owner, count, corr), 1.0)
    sw = (held @ cov)[owner, at] + 1e-10 * w
    var = np.bincount(owner, w * sw, books)[owner]
    with np.errstate(divide="ignore", invalid="ignore"):
        risk = np.where(some & (var > 0), np.abs(w * sw / var), 1.0 / n)
    risk = np.where(some, _share(risk, owner, count, 1.0 / n), 1.0 / n)
    total = np.abs(held @ betas)
    gross = total.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        of_factor = total / gross[:, None]
    factor = np.abs(w) * (np.abs(betas[at]) * of_factor[owner]).sum(axis=1)
    factor = np.where(gross[owner] == 0, 1.0 / n, _share(factor, owner, count, factor))
    raw = 0.35 * corr + 0.30 * factor + 0.35 * risk
    whole = np.bincount(owner, raw, books)[owner]
    with np.errstate(divide="ignore", invalid="ignore"):
        return corr, factor, risk, np.where(whole <= 0, 1.0 / n, raw / whole)


def contributions(books: DataFrame, vectors: DataFrame, heat: DataFrame) -> DataFrame:
    """Score, ``positions`` of the book, correlation, factor and Euler risk contribution and heat share of every position of the books in ``heat`` (book_id, score).

    Books are packed, one row each (``books`` may be packed already), and meet their score before their positions are rows again, so positions are shuffled once.
    The pairs of a universe of bounded size go to the tasks with the function, which computes many books at once.
    """
    cols = ["z", "c", "betas", "dominant_factor", "dominant_beta"]
    known = M.shipped(vectors, cols)
    scores = heat.select("book_id", "score")

    def fixed(rec: dict):
        return np.abs(rec["z"] @ rec["z"].T), rec["c"] @ rec["c"].T, rec["betas"]

    if known is None or not len(known["symbol"]) or len(known["symbol"]) > MAX_DENSE_SYMBOLS or not all(np.isfinite(m).all() for m in fixed(known)):

        def one(rec: dict) -> list[tuple]:
            n, w = len(rec["weight"]), rec["weight"]
            made = _parts(np.zeros(n, np.int64), np.arange(n), w, 1, *fixed(rec))
            return list(zip(rec["symbol"], w, *made[:3], rec["dominant_factor"], rec["dominant_beta"], made[3]))

        sizes = M.packed_books(books).select("book_id", F.size("items").alias("positions"))
        return M.map_books(books, vectors, cols, one, _PARTS).join(scores, "book_id").join(sizes, "book_id")

    packed = M.packed_books(books).join(scores, "book_id").select("book_id", "score", F.size("items").alias("positions"), "items")
    out_schema = StructType([packed.schema[c] for c in ("book_id", "score", "positions")] + L.schema_of(_PARTS).fields)
    schema = to_arrow_schema(out_schema)
    matrices = fixed(known)
    names, dominant = pa.array(known["symbol"]), pa.array(known["dominant_factor"], pa.string())
    step = max(1, M.CHUNK_NUMBERS // len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), step):
                batch = whole.slice(lo, step)
                items = batch.column(3)
                structs = items.flatten()
                at = pc.index_in(structs.field("symbol"), value_set=names)
                owner = np.repeat(np.arange(len(batch)), pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64))
                seen = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
                owner, place = owner[seen], pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[seen].astype(np.int64)
                w = structs.field("weight").to_numpy(zero_copy_only=False)[seen]
                corr, factor, risk, share = _parts(owner, place, w, len(batch), *matrices)
                of_book, of_symbol = pa.array(owner), pa.array(place)
                values = [
                    *[batch.column(k).take(of_book) for k in range(3)], names.take(of_symbol), pa.array(w), pa.array(corr), pa.array(factor), pa.array(risk),
                    dominant.take(of_symbol), pa.array(known["dominant_beta"][place]), pa.array(share),
                ]
                yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, schema)], schema=schema)

    return packed.mapInArrow(run, out_schema)


def attribution(books: DataFrame, vectors: DataFrame, heat: DataFrame) -> DataFrame:
    """Heat share, marginal heat and advice per position; ``heat`` is (book_id, score)."""
    df = contributions(books, vectors, heat).withColumn("marginal_heat", F.col("heat_share") * F.col("score"))
    rec, reason = R.position_advice(
        F.col("score"),
        F.col("heat_share"),
        F.col("corr_contribution"),
        F.col("factor_contribution"),
        F.col("risk_contribution"),
        F.col("weight"),
    )
    return df.withColumn("recommendation", rec).withColumn("reason", reason)


def top_contributors(attributed: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` largest heat shares per book."""
    w = Window.partitionBy("book_id").orderBy(F.col("heat_share").desc(), "symbol")
    return attributed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

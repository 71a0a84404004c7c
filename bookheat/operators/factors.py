"""Factor regressions and exposures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bookheat.functions import linalg as L
from bookheat.operators import metrics as M

#: Symbols up to which books are rows of one matrix over all of them.
MAX_DENSE_SYMBOLS = 512

_FIT = T.StructType(
    [
        T.StructField("beta", T.ArrayType(T.DoubleType())),
        T.StructField("t", T.ArrayType(T.DoubleType())),
        T.StructField("r2", T.DoubleType()),
    ]
)


@F.pandas_udf(_FIT)
def _fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for ys, xs in batches:
        rows = []
        for y, x in zip(ys, xs):
            b, t, r2 = L.ols(np.asarray(y), np.asarray(x).reshape(-1, len(y)))
            rows.append((b, t, r2))
        yield pd.DataFrame(rows, columns=["beta", "t", "r2"])


def factor_exposures(windowed: DataFrame, factors: DataFrame, min_rows: int = 20) -> DataFrame:
    """OLS of each symbol on all factors inside each window.

    ``windowed`` (t, symbol, x) holds positions and factor symbols, ``factors`` maps symbol to
    name. The factor block is packed once per day and shared by every symbol of that day.
    Result: (t, symbol, factor, beta, t_stat, r_squared).
    """
    block = (
        windowed.join(factors, "symbol")
        .groupBy("t")
        .agg(F.array_sort(F.collect_list(F.struct("factor", "x"))).alias("f"))
        .select("t", F.transform("f", lambda e: e["factor"]).alias("names"), F.flatten(F.transform("f", lambda e: e["x"])).alias("fx"))
    )
    fitted = (
        windowed.join(factors.select("symbol"), "symbol", "left_anti")
        .filter(F.size("x") >= min_rows)
        .join(block, "t")
        .select("t", "symbol", "names", _fit("x", "fx").alias("m"))
    )
    return fitted.select(
        "t",
        "symbol",
        F.explode(F.arrays_zip(F.col("names"), F.col("m.beta").alias("beta"), F.col("m.t").alias("ts"))).alias("e"),
        F.col("m.r2").alias("r_squared"),
    ).select(
        "t",
        "symbol",
        F.col("e.names").alias("factor"),
        F.col("e.beta").alias("beta"),
        F.col("e.ts").alias("t_stat"),
        "r_squared",
    )


#: Days of a block of rolling regressions, and symbols that a task takes of it.
BLOCK_DAYS = 256
SHARD_SYMBOLS = 2048


def _window_sums(products: np.ndarray, window: int) -> np.ndarray:
    """Sums of each ``window`` rows along axis 0, as differences of prefix sums carried in extended precision."""
    run = np.cumsum(products, axis=0, dtype=np.longdouble)
    run = np.concatenate([np.zeros((1, *run.shape[1:]), np.longdouble), run])
    return (run[window:] - run[:-window]).astype(np.float64)


def rolling_fits(x: np.ndarray, y: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """OLS of every row of ``y`` on the rows of ``x`` over each ``window`` columns: slopes, t statistics, R².

    Shapes are (windows, factors, symbols) twice and (windows, symbols). The moment matrix of a window is inverted once for all symbols.
    """
    k = len(x)
    design = np.concatenate([np.ones((1, x.shape[1])), x - x.mean(axis=1, keepdims=True)]).T
    own = (y - y.mean(axis=1, keepdims=True)).T
    inverse = np.linalg.pinv(_window_sums(design[:, :, None] * design[:, None, :], window), hermitian=True)
    cross = np.stack([_window_sums(design[:, [j]] * own, window) for j in range(k + 1)], axis=1)
    total, square = cross[:, 0], _window_sums(own * own, window)
    beta = inverse @ cross
    sse = np.maximum(square - (beta * cross).sum(axis=1), 0)
    sst = square - total**2 / window
    se = np.sqrt(np.maximum(np.diagonal(inverse, axis1=1, axis2=2)[:, :, None] * (sse / max(window - k - 1, 1))[:, None, :], 0))
    ts = np.divide(beta, se, out=np.zeros_like(beta), where=se > 0)
    r2 = np.where(sst > 0, 1 - np.divide(sse, sst, out=np.zeros_like(sse), where=sst > 0), 0.0)
    return beta[:, 1:], ts[:, 1:], r2


def rolling_exposures(returns: DataFrame, factors: DataFrame, value: str, window: int, block: int = BLOCK_DAYS) -> DataFrame:
    """``factor_exposures`` of the ``window`` days before every day, without a copy of the window per day.

    ``returns`` is (t, symbol, value) with ``t`` counting days. Days are dealt in blocks; a row goes to its own block and, at the
    end of one, to the next as well, so it is copied ``1 + window / block`` times instead of ``window`` times. A
    symbol (or factor) that misses one of the days gets no row on the days whose window has it.
    """
    block = max(block, window)
    shards = max(1, -(-returns.select("symbol").distinct().count() // SHARD_SYMBOLS))
    own = F.floor(F.col("t") / block)
    late = F.col("t") % block >= block - window
    # the factors of a block go to each of its shards, another symbol to one
    shard = F.when(F.col("factor").isNull(), F.array(F.pmod(F.xxhash64("symbol"), F.lit(shards)))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    rows = (
        returns.select("t", "symbol", F.col(value).cast("double").alias("v"))
        .join(factors.select("symbol", "factor"), "symbol", "left")
        .withColumn("block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumn("shard", F.explode(shard))
    )

    def run(group: pa.Table) -> pa.Table:
        first = group.column("block")[0].as_py() * block - window
        coded = group.column("symbol").combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        series = np.full((len(names), window + block), np.nan)
        series[coded.indices.to_numpy(), group.column("t").to_numpy() - first] = group.column("v").to_numpy()
        role = dict(zip(group.column("symbol").to_pylist(), group.column("factor").to_pylist()))
        lead = sorted((f, i) for i, f in ((i, role[s]) for i, s in enumerate(names)) if f is not None)
        rest = [i for i, s in enumerate(names) if role[s] is None]
        x, y = series[[i for _, i in lead]], series[rest]
        gaps = np.concatenate([np.zeros((len(rest) + 1, 1), np.int64), np.cumsum(np.concatenate([np.isnan(x).any(axis=0)[None, :], np.isnan(y)]), axis=1)], axis=1)
        gaps = gaps[:, window:-1] - gaps[:, : -window - 1]
        whole = (gaps[:1] == 0) & (gaps[1:] == 0) & ~np.isnan(y[:, window:])
        day, who = np.nonzero(whole.T)
        out = [np.zeros(0)] * 3
        if len(day) and lead:
            b, s, r = rolling_fits(np.nan_to_num(x), np.nan_to_num(y), window)
            out = [b[day, :, who].ravel(), s[day, :, who].ravel(), np.repeat(r[day, who], len(lead))]
        n = len(lead) if len(day) else 0
        symbol = pa.array([names[i] for i in rest], pa.string()).take(pa.array(np.repeat(who, n)))
        factor = pa.array([f for f, _ in lead] * (len(day) if n else 0), pa.string())
        t = pa.array(np.repeat(first + window + day, n), pa.int32())
        return pa.table([t, symbol, factor, *[pa.array(o, pa.float64()) for o in out]], ["t", "symbol", "factor", "beta", "t_stat", "r_squared"])

    return rows.groupBy("block", "shard").applyInArrow(run, "t int, symbol string, factor string, beta double, t_stat double, r_squared double")


def aggregate_exposures(exposures: DataFrame, books: DataFrame) -> DataFrame:
    """Σ weight·beta per (book, day, factor) and its share of total absolute exposure."""
    tot = (
        books.select("book_id", "symbol", "weight")
        .join(exposures, "symbol")
        .groupBy("book_id", "t", "factor")
        .agg(F.sum(F.col("weight") * F.col("beta")).alias("total_exposure"))
    )
    w = Window.partitionBy("book_id", "t")
    size = F.sum(F.abs("total_exposure")).over(w)
    return tot.withColumn(
        "exposure_share", F.abs("total_exposure") / F.when(size == 0, 1.0).otherwise(size)
    )


def exposure_lists(exposures: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, factor_exposures): ``aggregate_exposures`` of one day, one row per book with the list of its factors.

    A book's exposures are its weights times the betas of its symbols, so no row is made per position and factor. Where symbols have
    betas on different factors, some without a value, or are many, they are summed as rows. Many books are rows of one matrix over the symbols.
    """
    fields = ("factor", "total_exposure", "exposure_share")
    pairs = F.array_sort(F.collect_list(F.struct("factor", "beta")))
    vectors = exposures.groupBy("symbol").agg(pairs.alias("p")).select(
        "symbol", F.transform("p", lambda e: e["factor"]).alias("f"), F.transform("p", lambda e: e["beta"]).alias("betas"), F.exists("p", lambda e: e["beta"].isNull()).alias("gap")
    )
    kinds = vectors.select("f", "gap").distinct().limit(2).collect()
    known = M.shipped(vectors.select("symbol", "betas"), ["betas"]) if len(kinds) == 1 and not kinds[0].gap and len(set(kinds[0].f)) == len(kinds[0].f) else None
    if known is None or len(known["symbol"]) > MAX_DENSE_SYMBOLS:
        rows = books.select("book_id", F.inline("items")) if "items" in books.columns else books
        return aggregate_exposures(exposures, rows).groupBy("book_id").agg(F.collect_list(F.struct(*fields)).alias("factor_exposures"))
    packed = M.packed_books(books)
    out_schema = T.StructType([packed.schema["book_id"], *L.schema_of("factor_exposures array<struct<factor:string,total_exposure:double,exposure_share:double>>").fields])
    schema = to_arrow_schema(out_schema)
    names, symbols, betas = kinds[0].f, pa.array(known["symbol"], pa.string()), known["betas"]
    step = max(1, M.CHUNK_NUMBERS // len(betas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), step):
                batch = whole.slice(lo, step)
                items = batch.column(1)
                structs = items.flatten()
                at = pc.fill_null(pc.index_in(structs.field("symbol"), value_set=symbols), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(batch)), pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64))
                owner, place = owner[at >= 0], at[at >= 0]
                # a position without a weight adds nothing to a sum
                w = pc.fill_null(structs.field("weight"), 0.0).to_numpy(zero_copy_only=False)[at >= 0]
                total = np.bincount(owner * len(betas) + place, w, len(batch) * len(betas)).reshape(len(batch), -1) @ betas
                some = np.unique(owner)
                total = total[some]
                size = np.abs(total).sum(axis=1, keepdims=True)
                share = np.abs(total) / np.where(size == 0, 1.0, size)
                each = [pa.array(names * len(some), pa.string()), pa.array(total.ravel()), pa.array(share.ravel())]
                lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * len(names), pa.StructArray.from_arrays(each, list(fields)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), lists.cast(schema.field(1).type)], schema=schema)

    return packed.mapInArrow(run, out_schema)


def factor_hhi(exposures: DataFrame) -> DataFrame:
    """Concentration of absolute exposures and the dominant factor per (book, day)."""
    a = F.abs("total_exposure")
    return (
        exposures.groupBy("book_id", "t")
        .agg(
            F.sum(a).alias("_s"),
            F.sum(a * a).alias("_q"),
            F.count("*").alias("n_factors"),
            F.max_by("factor", F.struct(a.alias("x"), F.col("factor"))).alias("dominant_factor"),
        )
        .select(
            "book_id",
            "t",
            F.when(F.col("_s") == 0, 0.0).otherwise(F.col("_q") / (F.col("_s") * F.col("_s"))).alias("factor_hhi"),
            "n_factors",
            "dominant_factor",
        )
    )

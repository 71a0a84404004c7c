"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: White space of the word contracts: space and the five control characters 9 to 13.
SPACE = r"\x20\x09-\x0D"
#: Largest amount of text, in characters, that a task turns into results at a time.
CHUNK_CHARS = 1_000_000
#: Most bytes of an Arrow batch that Spark hands to a task.
BATCH_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that tasks get, where the session leaves Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, without building the list of words.

    Each word and the white space after it shrink to one character; what remains besides is the
    white space in front of the first word.
    """
    shrunk = F.length(F.regexp_replace(text, rf"[^{SPACE}]++[{SPACE}]*+", "."))
    lead = F.length(F.regexp_extract(text, rf"^[{SPACE}]*+", 0))
    return (shrunk - lead).cast("long")


def other_columns(docs: DataFrame, *replaced: str) -> list[str]:
    """Columns of ``docs`` but those named like ``replaced``, in whatever case of letters, as Spark compares names."""
    gone = {c.lower() for c in replaced}
    return [c for c in docs.columns if c.lower() not in gone]


def row_of(names: list[str]) -> Column:
    """Columns packed into one struct, so that their names meet no others on the way."""
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(1).alias("one"))


def with_row(docs: DataFrame, names: list[str], others: str, row: str = "row") -> StructType:
    """Schema of a packed row and other columns, given as DDL."""
    kind = docs.select(row_of(names).alias("row")).schema["row"].dataType
    return StructType([StructField(row, kind), *StructType.fromDDL(others).fields])


def unpacked(names: list[str], row: str = "row") -> list[Column]:
    return [F.col(f"{row}.`{c}`").alias(c) for c in names]


def fan_out(spark: SparkSession) -> int:
    """Number of partitions for work that is heavy per row and small in bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def release() -> None:
    """Give freed memory back to the system: workers stay for later tasks, and would hold the most they ever took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, with ``release`` once a partition is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def lean_group(run: Callable) -> Callable:
    """``run`` for ``applyInArrow``, with ``release`` once a group is done."""

    def wrapped(group: pa.Table) -> pa.Table:
        out = run(group)
        release()
        return out

    return wrapped


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)

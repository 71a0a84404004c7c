"""Labelled rows for the classifiers: fold rule and a bounded training sample.

A document is held out when the CRC-32 of its id, written as text, is divisible by 5; a null id is
held out. Labels are learned from the others only, from at most ``FIT_ROWS`` of them: those with the
smallest hash of their id, whatever the order of the tables. The list of their ids has that bound and
may be broadcast, so no text is shuffled to find the sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookheat.llm.common import lean, other_columns, row_of, unpacked, with_row

#: Most labelled documents that a model is fitted on.
FIT_ROWS = 6000
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


def training(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """``text`` and ``y`` of the sample. A label given twice counts once, as 1 if either is 1."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # bounded by rows, two numbers each
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y", "doc_id")


def scored(docs: DataFrame, run: Callable, text: str, into: str) -> DataFrame:
    """``docs`` with ``into``, where ``run`` adds ``p`` to Arrow batches of ``row`` and ``text``; a text crosses once each way."""
    others = other_columns(docs, text, into)
    kind = with_row(docs, others, "text string, p double")
    out = docs.select(row_of(others).alias("row"), F.col(f"`{text}`").alias("text")).mapInArrow(lean(run), kind)
    columns = dict(zip(others, unpacked(others)))
    return out.select(*[columns.get(c, F.col("text").alias(c)) for c in other_columns(docs, into)], F.col("p").alias(into))

"""Substring deduplication by content-defined blocks and window hashes; no Lempel-Ziv parse is made.

The reference is the corpus itself, cut into blocks: a block is a run of windows (of ``window`` words)
that have their first smallest ``SEED``-word hash at the same place, so equal passages are cut alike wherever they stand. The
index has one row per smallest hash: how often it occurs and whether all its blocks are the same.

Each block of a document is then looked up once. A block whose hash occurs elsewhere and has one content in
the whole corpus is duplicate as a whole. Where contents differ, which is at the ends of repeated passages,
the windows of the block are counted by hash. No match is extended past its block. The windows found, joined, are the duplicate spans. A window's smallest hash follows from its words, so equal
windows always meet under one key: the result is that of comparing all windows with all.

Shuffled are two hashes per block (about one per 14 words), counted on the map side first, so a passage
that a third of all documents share costs each task one row; windows only of blocks with differing contents. Two
filters of fixed size tell the second reading of the texts which blocks are worth sending. Contents are
compared by 128 bits of hashes.

Cases: a null text has no words; texts shorter than a window keep all; rows with the same text, repeated
rows included, repeat each other; null ids and further columns pass through, columns named like new ones
are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookheat.llm.common import chunks, other_columns, row_of, unpacked, with_row
from bookheat.llm.hashing import Ranges, WordHashes, grams, member, membership, text_key
from bookheat.session import stage

WINDOW = 35
SEED = 8


def first_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of each ``width`` consecutive numbers, by doubling."""

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[a] <= x[b], a, b)

    have, out = 1, np.arange(len(x))
    while have * 2 <= width:
        out = better(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return better(out[: len(out) - rest], out[rest:]) if rest else out


def cut(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of texts laid end to end: first window, number of windows, smallest seed hash.

    ``h`` are word hashes and ``doc`` the number of the text of each word.
    """
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none.astype(np.uint64)
    g = grams(h, SEED)
    place = first_least(g, window - SEED + 1)
    # windows inside one text, by runs with one place; no two windows of such a run are equal
    at = np.flatnonzero(doc[: len(place)] == doc[window - 1 :])
    if not len(at):
        return none, none, none.astype(np.uint64)
    first = np.flatnonzero(np.diff(place[at], prepend=-1) != 0)
    return at[first], np.diff(np.append(first, len(at))), g[place[at[first]]]


def _laid(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, text of each word, first word of each text) of texts laid end to end."""
    parts = [hashes.of(t.encode().split()) for t in texts]
    sizes = np.array([len(p) for p in parts])
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def repeated_blocks(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The index, of hashes that occur more than once: ``seed`` and ``mixed`` (contents differ)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in chunks(batches, "_text"):
            h, doc, _ = _laid(b.column("_text").to_pylist(), hashes)
            start, count, seed = cut(h, doc, window)
            if len(start):
                yield pa.RecordBatch.from_arrays([_signed(seed), _signed(Ranges(h).of(start, start + count + window - 1))], ["seed", "content"])

    blocks = texts.select("_text").mapInArrow(run, "seed long, content long").groupBy("seed")
    index = blocks.agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    return stage(index.filter("n > 1").select("seed", (F.col("low") != F.col("high")).alias("mixed")), "reference-blocks")


def spans(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``k1``, ``k2`` (key of a text) and ``spans``, its repeated windows as (first, number) runs."""
    index = repeated_blocks(texts, window)
    sc = texts.sparkSession.sparkContext
    any_, mixed = sc.broadcast(membership(index, "seed")), sc.broadcast(membership(index.filter("mixed"), "seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in chunks(batches, "_text"):
            h, doc, zero = _laid(b.column("_text").to_pylist(), hashes)
            start, count, seed = cut(h, doc, window)
            pick = member(any_.value, seed)
            start, count, seed = start[pick], count[pick], seed[pick]
            if not len(start):
                continue
            split = member(mixed.value, seed)
            many = np.where(split, count, 0)
            ends = np.concatenate([[0], np.cumsum(many)])
            each = np.repeat(start - ends[:-1], many) + np.arange(ends[-1])
            windows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(Ranges(h).of(each, each + window)))
            of = doc[start]
            keys = [b.column(k).take(pa.array(of)) for k in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays(
                [_signed(seed), *keys, pa.array(start - zero[of], pa.int64()), pa.array(count, pa.int64()), windows], ["seed", "k1", "k2", "first", "n", "windows"]
            )

    sent = stage(texts.mapInArrow(run, "seed long, k1 long, k2 long, first long, n long, windows array<long>"), "sent-blocks")
    known = sent.join(index, "seed")
    whole = known.filter("not mixed").select("k1", "k2", "first", "n")
    loose = known.filter("mixed").select("seed", "k1", "k2", "first", F.posexplode("windows").alias("at", "content"))
    twice = loose.groupBy("seed", "content").count().filter("count > 1").select("seed", "content")
    single = loose.join(twice, ["seed", "content"]).select("k1", "k2", (F.col("first") + F.col("at")).alias("first"), F.lit(1).cast("long").alias("n"))
    # a set, because texts that occur often send the same runs often
    return whole.unionAll(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n")).alias("spans"))


def deduplicate(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the words left joined by a space."""
    new = ("n_words", "n_removed", "kept")
    others = other_columns(docs, *new, text)
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(row_of(others).alias("_row"), F.col(text).isNull().alias("_null"), body.alias("_text"), *text_key(body))
    found = spans(keyed.select("_text", "k1", "k2"), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text"):
            total, removed, kept = [], [], []
            for t, runs in zip(b.column("_text").to_pylist(), b.column("spans").to_pylist()):
                words = t.encode().split()
                total.append(len(words))
                if not runs:
                    removed.append(0)
                    kept.append(b" ".join(words).decode())
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [r["first"] for r in runs], 1)
                np.add.at(edge, [r["first"] + r["n"] + window - 1 for r in runs], -1)
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                removed.append(len(words) - len(stay))
                kept.append(b" ".join([words[i] for i in stay.tolist()]).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), b.column("_null"), b.column("_text"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["_row", "_null", "_text", *new],
            )

    out = keyed.join(found, ["k1", "k2"], "left").select("_row", "_null", "_text", "spans")
    out = out.mapInArrow(run, with_row(docs, others, "_null boolean, _text string, n_words long, n_removed long, kept string", "_row"))
    back = F.when(~F.col("_null"), F.col("_text"))
    columns = dict(zip(others, unpacked(others, "_row")))
    return out.select(*[columns.get(c, back.alias(c)) for c in other_columns(docs, *new)], *new)

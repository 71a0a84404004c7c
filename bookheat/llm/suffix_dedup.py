"""Deduplication of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``window`` bytes that covers it also starts anywhere else. Windows are first dealt
by an anchor, the smallest hash of the byte grams in a window: a run of windows with one anchor is a
block, and equal windows have equal anchors. Blocks whose anchor occurs once hold no repeat. Those of an
anchor with a single content are repeats as a whole. Where contents differ, at the ends of repeated passages,
the blocks' bytes are dealt to cells by anchor; a cell cuts them into shards, builds the shards'
Burrows-Wheeler transforms and merges these by interleave refinement (``interleave``). The places of
the merged order that have ``ROUNDS`` symbols, that is a window, in common with a neighbour are the repeated
intervals; mapped back they are the repeated windows.

An anchor with more than ``HOT`` different blocks is split before: its windows are cut into runs by their distance
from the anchor and dealt by the bytes that all windows of a run share. This is done over until few blocks
share a key; at runs of one window these are the windows themselves. So no cell grows with the corpus.

Shuffled are, per block (about one per 70 bytes), its hash twice, packed texts twice, and the bytes of different blocks that share
an anchor. Blocks that repeat inside a chunk of texts, as in a text of one repeated character, are folded
there. Blocks are compared by 128 bits of hashes, symbols by 64.

Cases: a null text is empty; texts below a window keep all; rows with the same text, repeated rows included,
repeat each other; null ids and further columns pass through, ``text`` and columns named like new ones, in either
case of letters, are replaced; ties do not occur; an empty table gives no rows. Long texts are cut into
segments of ``SEGMENT`` windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookheat.llm.common import fan_out, other_columns, unpacked, with_row
from bookheat.llm.hashing import mix
from bookheat.llm.interleave import byte_grams, repeated, transforms
from bookheat.llm.packed import pack, text_bytes, unpack
from bookheat.session import stage

WINDOW = 200
ROUNDS = 4
SEGMENT = 1 << 20
#: Most different blocks of one anchor that a cell takes.
HOT = 2048
#: Windows of a run when a hot anchor is split, in turn.
RUNS = (32, 8, 1)
CELL_BYTES = 1_000_000
SHARD_BYTES = 1 << 16
_PLACE = np.uint64((1 << 24) - 1)
_PIECE = "key long, chunk long, pos int, n int, off int, open boolean, body binary"


def symbol_bytes(window: int, rounds: int = ROUNDS) -> int:
    """Bytes of a symbol: the window is a whole number of them, ``rounds`` or the next that fits."""
    while window % rounds:
        rounds += 1
    return window // rounds


def gram_bytes(window: int) -> int:
    return 1 << max(0, (window // 3).bit_length() - 1)


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive numbers, by running minima inside blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    padded = padded.reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def cut(b: np.ndarray, ends: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of texts laid end to end, segment by segment: first window, number, anchor's distance, anchor hash."""
    gram = gram_bytes(window)
    for lo in range(0, max(0, len(b) - window + 1), SEGMENT):
        part = b[lo : lo + SEGMENT + window - 1]
        h = byte_grams(part, gram)
        # the first of the smallest: place in the low bits
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        place = (smallest(key, window - gram + 1) & _PLACE).astype(np.int64)
        inside = np.ones(len(place), bool)
        first, last = np.searchsorted(ends, [lo, lo + len(place) + window], "left")
        for end in ends[first : last + 1].tolist():
            inside[max(0, end - window + 1 - lo) : max(0, end - lo)] = False
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        head = np.flatnonzero(np.diff(place[at], prepend=-1) != 0)
        start = at[head]
        yield lo + start, np.diff(np.append(head, len(at))), place[start] - start, h[place[start]]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _signed(x: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64(), mask=null)


def _blocks(window: int):
    """``seed`` null: a run of windows that the chunk itself repeats; else a block and how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob")):
                data, ends = text_bytes(unpack(blob.as_buffer()).column("text"))
                view = memoryview(data)
                for start, n, off, seed in cut(data, ends, window):
                    stop = start + n + window - 1
                    content = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(start.tolist(), stop.tolist())), np.uint64, len(start))
                    _, first, back, times = np.unique(mix(seed) ^ content, return_index=True, return_inverse=True, return_counts=True)
                    known = np.zeros(int(stop[-1] - start[0]) + 1, np.int64)
                    again = times[back] > 1
                    np.add.at(known, start[again] - start[0], 1)
                    np.add.at(known, start[again] + n[again] - start[0], -1)
                    run_start, run_n = _runs(np.cumsum(known) > 0)
                    m = len(run_start)
                    pos, count = np.concatenate([start[first], run_start + start[0]]), np.concatenate([n[first], run_n])
                    null = np.arange(len(pos)) >= len(first)
                    pad = np.zeros(m, np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(pos), chunk), pa.int64()),
                            pa.array(pos, pa.int32()),
                            pa.array(count, pa.int32()),
                            pa.array(np.concatenate([off[first], np.zeros(m, np.int64)]), pa.int32()),
                            pa.array(np.concatenate([times, np.full(m, 2)]), pa.int32()),
                            _signed(np.concatenate([seed[first], pad]), null),
                            _signed(np.concatenate([content[first], pad]), null),
                        ],
                        ["chunk", "pos", "n", "off", "times", "seed", "content"],
                    )

    return run


def _bodies(window: int):
    """The bytes of the blocks asked of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob, wanted in zip(b.column("chunk").to_pylist(), b.column("blob"), b.column("wanted")):
                data, _ = text_bytes(unpack(blob.as_buffer()).column("text"))
                view, want = memoryview(data), pa.RecordBatch.from_struct_array(wanted.values)
                stop = (want.column("pos").to_numpy().astype(np.int64) + want.column("n").to_numpy() + window - 1).tolist()
                body = pa.array([bytes(view[s:e]) for s, e in zip(want.column("pos").to_pylist(), stop)], pa.binary())
                yield pa.RecordBatch.from_arrays([want.column("seed"), pa.array(np.full(len(body), chunk), pa.int64()), *[want.column(c) for c in ("pos", "n", "off", "open")], body], ["key", "chunk", "pos", "n", "off", "open", "body"])

    return run


def _split(window: int, width: int):
    """Pieces cut into runs of ``width`` windows by their distance from the anchor, keyed by what such windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, chunk, pos, n, off, open_, body in zip(*(b.column(c).to_pylist() for c in ("key", "chunk", "pos", "n", "off", "open", "body"))):
                first = 0
                while first < n:
                    near = (off - first) // width * width  # the run's smallest distance
                    count = min(n - first, off - first - near + 1)
                    core = body[off - near : off - near - width + 1 + window]
                    name = xxhash.xxh3_64_intdigest(core, (key ^ (near * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF)
                    part = body[first : first + count + window - 1]
                    out.append((name - (1 << 63), chunk, pos + first, count, off - first, open_, part, xxhash.xxh3_64_intdigest(part) - (1 << 63)))
                    first += count
            names = ["key", "chunk", "pos", "n", "off", "open", "body", "content"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names)

    return run


def _cell(window: int):
    """Runs of repeated windows of the open pieces of a cell."""
    width = symbol_bytes(window)

    def run(group: pa.Table) -> pa.Table:
        data, ends = text_bytes(group.column("body").cast(pa.large_binary()).combine_chunks())
        sizes = np.diff(ends)
        x = transforms(data, sizes, ends[:-1] // SHARD_BYTES, width)
        chunk, pos, n, open_ = (group.column(c).to_numpy() for c in ("chunk", "pos", "n", "open"))
        flags = repeated(x, window // width)
        of = np.repeat(np.arange(len(sizes)), sizes + 1)
        base = np.cumsum(sizes + 1) - (sizes + 1)
        place = np.arange(len(of)) - base[of]
        start, count = _runs(flags & (place < n[of]) & open_[of])
        piece = of[start]
        return pa.table([pa.array(chunk[piece]), pa.array(pos[piece] + place[start], pa.int32()), pa.array(count, pa.int32())], ["chunk", "pos", "n"])

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, spans in zip(b.column("blob"), b.column("spans")):
                rows = unpack(blob.as_buffer())
                data, ends = text_bytes(rows.column("text"))
                edge = np.zeros(len(data) + 1, np.int32)
                if spans.is_valid:
                    found = pa.RecordBatch.from_struct_array(spans.values)
                    pos, n = (found.column(c).to_numpy().astype(np.int64) for c in ("pos", "n"))
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + n + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                starts = gone.copy()
                starts[1:] &= ~gone[:-1]
                heads = ends[:-1][np.diff(ends) > 0]
                starts[heads] = gone[heads]
                left = np.concatenate([[0], np.cumsum(~gone)])[ends]
                number = np.diff(np.concatenate([[0], np.cumsum(starts)])[ends])
                kept = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~gone])]).cast(pa.binary())
                sizes = np.diff(ends)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), pa.array(sizes, pa.int64()), pa.array(sizes - np.diff(left), pa.int64()), pa.array(number, pa.int64()), kept],
                    ["row", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def _cool(pieces: DataFrame, window: int, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pieces of keys with at most ``hot`` of them, and the spans found while splitting the others."""
    done, spans = [], []
    for width in [w for w in RUNS if 2 * w <= window]:
        crowded = stage(pieces.groupBy("key").count().filter(F.col("count") > hot).select("key"), "hot-anchors")
        if crowded.isEmpty():
            break
        done.append(pieces.join(crowded, "key", "left_anti"))
        finer = pieces.join(crowded, "key", "left_semi").mapInArrow(_split(window, width), _PIECE + ", content long")
        finer = stage(finer, "finer-pieces")
        # equal pieces are one; all of them are repeats
        kinds = finer.groupBy("key", "content").agg(F.count("*").alias("m"), F.min(F.struct("chunk", "pos")).alias("one"))
        several = kinds.filter("m > 1").select("key", "content", "one")
        both = finer.join(several, ["key", "content"])
        spans.append(both.filter("open").select("chunk", "pos", "n"))
        alone = finer.join(kinds.filter("m = 1").select("key", "content"), ["key", "content"], "left_semi")
        one = both.filter("chunk = one.chunk and pos = one.pos").withColumn("open", F.lit(False))
        pieces = stage(alone.select(*pieces.columns).unionByName(one.select(*pieces.columns)), "pieces")
    for d in done:
        pieces = pieces.unionByName(d)
    return pieces, spans


def spans(packed: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``chunk``, ``pos`` (first window, in bytes from the chunk's start), ``n`` windows: all repeated windows."""
    blocks = stage(packed.mapInArrow(_blocks(window), "chunk long, pos int, n int, off int, times int, seed long, content long"), "blocks")
    dealt = blocks.filter("seed is not null")
    ends = dealt.groupBy("seed").agg(F.sum("times").alias("m"), F.min("content").alias("low"), F.max("content").alias("high"))
    index = ends.filter("m > 1").select("seed", (F.col("low") != F.col("high")).alias("mixed"))
    hit = stage(dealt.join(index, "seed"), "shared-blocks")
    mixed = hit.filter("mixed")
    kinds = mixed.groupBy("seed", "content").agg(F.sum("times").alias("m"), F.min(F.struct("chunk", "pos", "n", "off")).alias("one"))
    kinds = stage(kinds, "block-kinds")
    copies = mixed.filter("times = 1").join(kinds.filter("m > 1").select("seed", "content"), ["seed", "content"], "left_semi")
    want = kinds.select("one.*", "seed", (F.col("m") == 1).alias("open"))
    lists = want.groupBy("chunk").agg(F.collect_list(F.struct("pos", "n", "off", "seed", "open")).alias("wanted"))
    pieces = stage(packed.join(lists, "chunk").select("chunk", "blob", "wanted").mapInArrow(_bodies(window), _PIECE), "pieces")
    pieces, found = _cool(pieces, window, hot)
    total = pieces.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    cells = max(fan_out(packed.sparkSession), int(total) // CELL_BYTES)
    placed = pieces.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
    found.append(placed.groupBy("cell").applyInArrow(_cell(window), "chunk long, pos int, n int"))
    whole = hit.filter("not mixed and times = 1").select("chunk", "pos", "n")
    out = blocks.filter("seed is null").select("chunk", "pos", "n").unionByName(whole).unionByName(copies.select("chunk", "pos", "n"))
    for f in found:
        out = out.unionByName(f)
    return out


def deduplicate(docs: DataFrame, text: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """The other columns of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes left."""
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    others = other_columns(docs, *new, text)
    packed = pack(docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`")), text)
    kind = with_row(docs, others, "n_bytes long, n_removed long, n_spans long, kept binary")
    lists = spans(packed, window, hot).groupBy("chunk").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    out = packed.join(lists, "chunk", "left").select("blob", "spans").mapInArrow(_kept(window), kind)
    return out.select(*unpacked(others), *new)

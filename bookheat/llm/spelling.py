"""Spelling variants by edit-matrix rows shared along a sorted vocabulary.

Words within one edit are equal but for a stretch, so each word is posted under what stands around
the ``SEGMENTS`` stretches of its length and of the length above; a cell sorts the stretches posted under a key and
scans the sorted list against each of its own entries. Of the edit matrix only the three diagonals that one edit can reach are kept. A row
belongs to a prefix: entries that share it, known from the longest common prefixes (LCPs) of neighbours in the
list, share the row, and as soon as all of a row exceeds one edit, the whole range of entries with that prefix is
skipped. All entries are scanned at once, prefix length by prefix length.

A key with more than ``HOT`` words (a common beginning or end) is posted again position by position; such a
key says all of a word but one place, so the alphabet bounds its size. A pair that meets under several keys counts under the
first, so pairs need no shuffle to be made distinct. Chains of forms are followed by doubling joins.

Cases: a null text has no words, a null id stands as empty text, repeated rows count again; of near words as
frequent, the one that comes first in code-point order is the form; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookheat.llm.common import chunks, fan_out
from bookheat.session import stage

LEAST_CHARS = 7
LEAST_TIMES = 2
#: A form is at least so many times as frequent.
FACTOR = 10
SEGMENTS = 2
HOT = 1024
CELL_ROWS = 40_000
LANES = 50_000
_FAR = np.int8(9)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_POST = "key long, word string, n long, head int, tail int, low int, high int, longest int"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, slip: int | None = None) -> DataFrame:
    """Staged ``word``, ``n``: runs of Latin letters, A-Z lower-cased, and how often they occur.

    With ``slip``, a run loses the code point ``h % length`` wherever ``slip`` divides ``h``, the CRC-32 of ``<doc_id>:<run>``.
    """
    runs = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % least_chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            total: Counter[str] = Counter()
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                seen = Counter(runs.findall(t.encode().translate(_LOWER).decode()))
                if slip is None:
                    total.update(seen)
                    continue
                start = zlib.crc32(f"{i}:".encode())
                for w, n in seen.items():
                    h = zlib.crc32(w.encode(), start)
                    if h % slip == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < least_chars:
                            continue
                    total[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stage(counts.filter(F.col("n") >= least_times), "vocabulary")


def _key(longest: int, low: int, high: int, before: str, after: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{longest} {low} {high} {before}\n{after}".encode()) - (1 << 63)


def _stretches(length: int) -> list[tuple[int, int]]:
    cuts = [round(k * length / SEGMENTS) for k in range(SEGMENTS + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    names = ["key", "word", "n", "head", "tail", "low", "high", "longest"]
    kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.int32()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per stretch and length of the longer word: what stands before and after it is the key."""
    for b in batches:
        rows = []
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            for longest in (len(w), len(w) + 1):
                for low, high in _stretches(longest):
                    tail = longest - high
                    rows.append((_key(longest, low, high, w[:low], w[len(w) - tail :]), w, n, low, tail, low, high, longest))
        yield _frame(rows)


def _post_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per place of the stretch of a row."""
    for b in batches:
        rows = []
        for w, n, low, high, longest in zip(*(b.column(c).to_pylist() for c in ("word", "n", "low", "high", "longest"))):
            for at in range(low, high):
                tail = longest - 1 - at
                rows.append((_key(longest, at, at + 1, w[:at], w[len(w) - tail :]), w, n, at, tail, low, high, longest))
        yield _frame(rows)


def near_entries(codes: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), a < b, of entries of one group within exactly one edit.

    Entry ``k`` is ``codes[start[k] : start[k] + size[k]]``; entries are sorted by group, then as strings, and those of a group differ.
    """
    n = len(start)
    codes = np.append(codes, 0)
    stop = len(codes) - 1

    def at(entry: np.ndarray, place: np.ndarray) -> np.ndarray:
        return codes[np.minimum(start[entry] + np.maximum(place, 0), stop)]

    lcp = np.full(n, -1, np.int64)
    open_ = np.flatnonzero(np.append(False, group[1:] == group[:-1])) if n else np.zeros(0, np.int64)
    lcp[open_], depth = 0, 0
    while len(open_):
        open_ = open_[(size[open_] > depth) & (size[open_ - 1] > depth)]
        open_ = open_[at(open_, np.full(len(open_), depth)) == at(open_ - 1, np.full(len(open_), depth))]
        depth += 1
        lcp[open_] = depth
    heads = np.append(np.flatnonzero(lcp < 0), n)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    of = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    edges: list[np.ndarray] = []  # by depth: where a prefix of that length and one more begins
    for first in range(0, n, LANES):
        q = np.arange(first, min(n, first + LANES))
        lo, hi = heads[of[q]], heads[of[q] + 1]
        keep = hi > q + 1
        q, lo, hi = q[keep], lo[keep], hi[keep]
        left, mid, right = np.full(len(q), _FAR), np.zeros(len(q), np.int8), np.where(size[q] > 0, 1, _FAR).astype(np.int8)
        d = 0
        while len(q):
            # the entry that ends here comes first in its range
            ended = size[lo] == d
            gap = size[q] - d
            here = ended & (lo > q) & (np.abs(gap) <= 1)
            value = np.where(gap < 0, left, np.where(gap == 0, mid, right))
            hit = here & (value == 1)
            out_a.append(q[hit])
            out_b.append(lo[hit])
            lo = lo + ended
            if len(edges) <= d:
                edges.append(np.append(np.flatnonzero(lcp <= d), n))
            s, e = np.searchsorted(edges[d], lo), np.searchsorted(edges[d], hi)
            count = np.maximum(e - s, 0)
            lane = np.repeat(np.arange(len(q)), count)
            child = np.repeat(s - (np.cumsum(count) - count), count) + np.arange(count.sum())
            c_lo, c_hi = edges[d][child], edges[d][child + 1]
            later = c_hi > q[lane] + 1
            lane, c_lo, c_hi = lane[later], c_lo[later], c_hi[later]
            q, letter = q[lane], codes[np.minimum(start[c_lo] + d, stop)]
            long_, l0, m0, r0 = size[q], left[lane], mid[lane], right[lane]
            left = np.where(d <= long_, np.minimum(m0 + 1, l0 + ((letter != at(q, np.full(len(q), d - 1))) | (d < 1))), _FAR)
            mid = np.where(d + 1 <= long_, np.minimum(np.minimum(r0, left) + 1, m0 + (letter != at(q, np.full(len(q), d)))), _FAR)
            right = np.where(d + 2 <= long_, np.minimum(mid + 1, r0 + (letter != at(q, np.full(len(q), d + 1)))), _FAR)
            near = np.minimum(np.minimum(left, mid), right) <= 1
            q, lo, hi = q[near], c_lo[near], c_hi[near]
            left, mid, right = (x[near].astype(np.int8) for x in (left, mid, right))
            d += 1
    return np.concatenate(out_a), np.concatenate(out_b)


def _first_key(a: str, b: str, longest: int, low: int, high: int, at: int | None) -> bool:
    """Whether the pair meets under no earlier key than that of this stretch (and place)."""
    short = min(len(a), len(b))
    p = 0
    while p < short and a[p] == b[p]:
        p += 1
    s = 0
    while s < short and a[-1 - s] == b[-1 - s]:
        s += 1
    if next((x for x in _stretches(longest) if p >= x[0] and s >= longest - x[1]), None) != (low, high):
        return False
    return at is None or next(x for x in range(low, high) if p >= x and s >= longest - 1 - x) == at


def _cell(group: pa.Table) -> pa.Table:
    words = group.column("word").combine_chunks()
    text = words.to_pylist()
    head, tail, size = (group.column(c).to_numpy() for c in ("head", "tail", "longest"))
    middle = pa.array([w[h : len(w) - t] for w, h, t in zip(text, head.tolist(), tail.tolist())], pa.string())
    order = pc.sort_indices(pa.table({"key": group.column("key"), "middle": middle}), [("key", "ascending"), ("middle", "ascending")]).to_numpy()
    entries = [middle[k].as_py() for k in order.tolist()]
    sizes = np.fromiter(map(len, entries), np.int64, len(entries))
    codes = np.frombuffer("".join(entries).encode("utf-32-le"), np.uint32)
    key = group.column("key").to_numpy()[order]
    a, b = near_entries(codes, np.cumsum(sizes) - sizes, sizes, key)
    low, high, n = (group.column(c).to_numpy() for c in ("low", "high", "n"))
    out = []
    for i, j in zip(order[a].tolist(), order[b].tolist()):
        u, v, m, h, t = text[i], text[j], int(size[i]), int(head[i]), int(tail[i])
        # keys are hashes; a pair of two shorter words has keys of its own
        if max(len(u), len(v)) == m and u[:h] == v[:h] and u[len(u) - t :] == v[len(v) - t :]:
            place = h if (h, m - t) != (int(low[i]), int(high[i])) else None
            if _first_key(u, v, m, int(low[i]), int(high[i]), place):
                out += [(u, int(n[i]), v, int(n[j])), (v, int(n[j]), u, int(n[i]))]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["word", "n", "near", "near_n"])


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n`` of all pairs of ``words`` (``word``, ``n``, distinct) within one edit, both ways round."""
    posts = stage(words.select("word", "n").mapInArrow(_post, _POST), "posts")
    sizes = posts.groupBy("key").count()
    crowded = stage(sizes.filter(F.col("count") > hot).select("key"), "hot-keys")
    shared = posts.join(sizes.filter(f"count > 1 and count <= {hot}").select("key"), "key", "left_semi")
    places = posts.join(crowded, "key", "left_semi").mapInArrow(_post_places, _POST)
    rows = stage(shared.unionByName(places), "spelling-rows")
    cells = max(fan_out(words.sparkSession), rows.count() // CELL_ROWS)
    placed = rows.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
    return placed.groupBy("cell").applyInArrow(_cell, "word string, n long, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """``word``, ``root`` for ``links`` (``word``, ``form``; one row per word, no cycles): the last of each chain."""
    now = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        if now.join(up, "root", "left_semi").isEmpty():
            return now
        now = stage(now.join(up, "root", "left").select("word", F.coalesce("higher", "root").alias("root")), "roots")


def variants(words: DataFrame, factor: int = FACTOR, hot: int = HOT) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of each of ``words`` (``word``, ``n``)."""
    near = near_words(words, hot).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    fits = form_n >= F.lit(factor) * F.col("n")
    found = near.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, form_n).alias("form_n"))
    found = stage(found, "forms")
    last = roots(found.filter("form is not null"))
    out = words.join(found, "word", "left").join(last, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))

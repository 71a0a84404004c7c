"""Byte-level BPE encoding by tree concatenation, and decoding.

A text no longer than one leaf is encoded at once. A longer text is halved until no part exceeds a
leaf; the leaves are rows, dealt over all tasks and encoded in parallel. The parts of a text then meet
again (a group is one text, which was one row before) and are joined pairwise up the tree: around each
join a window of tokens is encoded anew and widened until its outer tokens are those of both sides.
From there on nothing can differ: a run of tokens is the encoding of its bytes if every two neighbours
are neighbours in some encoding, and the pieces into which the pattern cuts a text depend on no more
than ``MARGIN`` bytes behind them.

Ids are packed as little-endian unsigned 32-bit integers, the layout of token shards. The vocabulary
file is that of the tokenizers library and its path a parameter. Strings of special tokens in a text
become special tokens, as that library does by default.

Cases: a null text counts as empty and has no ids; repeated rows, null ids and other columns keep
their rows; columns named like the new one are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookheat.llm.common import chunks, fan_out, lean, other_columns, row_of, unpacked, with_row
from bookheat.session import stage

#: Longest part, in characters, that is encoded without a join.
LEAF_CHARS = 1 << 15
#: Bytes by which a token must be away from the end of a part to be certain (a special token has 13).
MARGIN = 16
#: Tokens on each side of a join in the first window.
FIRST_WINDOW = 8
# Fixed value: the pattern that cuts texts into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Vocabulary, encoder and byte table of one tokenizer file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._encoding = tiktoken.Encoding(sha256(path.encode()).hexdigest(), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.specials = tuple(special)
        self.bytes = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for b, i in ranks.items():
            self.bytes[i] = b
        for t, i in special.items():
            self.bytes[i] = t.encode()
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._encoding.encode(text, allowed_special="all"), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", errors="replace")

    def leaves(self, text: str, most: int) -> list[str]:
        """Halves of halves, none over ``most`` characters; no cut falls into a special token."""
        if len(text) <= most:
            return [text]
        cut = len(text) // 2
        for s in self.specials:
            at = text.find(s, max(0, cut - len(s) + 1), cut + len(s) - 1)
            if 0 <= at < cut:
                cut = at
        if cut == 0:
            return [text]
        return self.leaves(text[:cut], most) + self.leaves(text[cut:], most)

    def join(self, left: np.ndarray, right: np.ndarray, data: bytes, start: int, at: int) -> np.ndarray:
        """Encoding of ``data[start:]``'s parts ``left`` (up to ``at``) and ``right`` as one text."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        ends = start + np.concatenate([[0], np.cumsum(self.sizes[left])])
        heads = at + np.concatenate([[0], np.cumsum(self.sizes[right])])

        def inside(pos: int) -> bool:
            return pos < len(data) and data[pos] & 0xC0 == 0x80

        wide = FIRST_WINDOW
        while True:
            i, r = max(0, len(left) - wide), min(len(right), wide)
            while i > 0 and (ends[i] > at - MARGIN or inside(ends[i])):
                i -= 1
            while r < len(right) and (heads[r] < at + MARGIN or inside(heads[r])):
                r += 1
            window = self.encode(data[ends[i] : heads[r]].decode("utf-8"))
            q = int(np.searchsorted(heads[: r + 1], heads[r] - MARGIN, "right")) - 1
            same_left = i == 0 or np.array_equal(window[:2], left[i : i + 2])
            same_right = r == len(right) or (q >= 0 and np.array_equal(window[-(r - q) :], right[q:r]))
            if same_left and same_right:
                return np.concatenate([left[:i], window, right[r:]])
            wide *= 2

    def join_all(self, parts: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
        """Join neighbouring parts, then neighbouring pairs, up to the whole text."""
        data = b"".join(texts)
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()
        nodes = [(parts[k], cuts[k], cuts[k + 1]) for k in range(len(parts))]
        while len(nodes) > 1:
            up = []
            for k in range(0, len(nodes) - 1, 2):
                (a, lo, mid), (b, _, hi) = nodes[k], nodes[k + 1]
                up.append((self.join(a, b, data[:hi], lo, mid), lo, hi))
            nodes = up + nodes[len(up) * 2 :]
        return nodes[0][0]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def pack(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def unpack(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


def _replace(batch: pa.RecordBatch, drop: str, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, name])


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The other columns of ``docs`` and ``into``, the packed ids of each whole text."""
    others = other_columns(docs, text, into)
    rows = docs.select(row_of(others).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in chunks(batches, "_text"):
            yield _replace(b, "_text", "_ids", pa.array([pack(c.encode(t)) for t in b.column("_text").to_pylist()], pa.binary()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in chunks(batches, "_text"):
            for no, t in zip(b.column("_no").to_pylist(), b.column("_text").to_pylist()):
                parts = c.leaves(t, leaf_chars)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([no] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["_no", "_leaf", "_part"]
                )

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in chunks(batches, "_part"):
            ids = pa.array([pack(c.encode(t)) for t in b.column("_part").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "_ids"])

    def meet(group: pa.Table) -> pa.Table:
        c = codec(path)
        group = group.sort_by("_leaf")
        ids = c.join_all([unpack(x) for x in group.column("_ids").to_pylist()], [t.encode() for t in group.column("_part").to_pylist()])
        return pa.table({"_no": group.column("_no").slice(0, 1), "_ids": pa.array([pack(ids)], pa.binary())})

    short = rows.filter(F.length("_text") <= leaf_chars).mapInArrow(lean(whole), with_row(docs, others, "_ids binary", "_row"))
    # numbered once and written, so that a row's number is the same for its leaves and its columns
    long = stage(rows.filter(F.length("_text") > leaf_chars).withColumn("_no", F.monotonically_increasing_id()), "long-texts")
    spread = fan_out(docs.sparkSession)
    leaves = long.select("_no", "_text").mapInArrow(lean(split), "_no long, _leaf int, _part string").repartition(spread, "_no", "_leaf")
    coded = leaves.mapInArrow(lean(leaf), "_no long, _leaf int, _part string, _ids binary")
    met = coded.groupBy("_no").applyInArrow(meet, "_no long, _ids binary")
    out = short.unionByName(long.select("_row", "_no").join(met, "_no").select("_row", "_ids"))
    return out.select(*unpacked(others, "_row"), F.col("_ids").alias(into))


def decode(coded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``coded`` with ``into``, the text of its packed ids."""
    others = other_columns(coded, into)
    rows = coded.select(row_of(others).alias("_row"), F.coalesce(F.col(ids), F.lit(b"")).alias("_ids"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in chunks(batches, "_ids"):
            yield _replace(b, "_ids", "_out", pa.array([c.decode(unpack(x)) for x in b.column("_ids").to_pylist()], pa.string()))

    out = rows.mapInArrow(lean(back), with_row(coded, others, "_out string", "_row"))
    return out.select(*unpacked(others, "_row"), F.col("_out").alias(into))

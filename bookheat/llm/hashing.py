"""Word hashes, range hashes and a fixed-size membership filter."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most words that a task remembers, and most bytes of one: some 40 MB.
MEMORY_WORDS, MEMORY_BYTES = 200_000, 64
FILTER_BITS = 25
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; forgets all when it grows too large, keeps no long words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMORY_BYTES:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive words."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Ranges:
    """Hashes of arbitrary ranges of one array of word hashes."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        powers, self.back = _powers(_BASE, n), _powers(_BACK, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(1)) * powers[:n])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def text_key(text: Column) -> list[Column]:
    """128 bits, as two longs, that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def membership(keys: DataFrame, col: str) -> np.ndarray:
    """Filter of ``2 ** FILTER_BITS`` bits over hash values, as 64-bit words; its size never grows.

    It may say yes for others, never no for a member; with very many keys it says yes to all.
    """
    top = (1 << FILTER_BITS) - 1
    bits = F.explode(F.array(F.col(col).bitwiseAND(F.lit(top)), F.shiftrightunsigned(col, FILTER_BITS).bitwiseAND(F.lit(top))))
    words = keys.select(bits.alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy()
    return out.view(np.uint64)


def member(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be a member."""
    top, out = np.uint64((1 << FILTER_BITS) - 1), np.ones(len(h), bool)
    for bit in (h & top, (h >> np.uint64(FILTER_BITS)) & top):
        out &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out

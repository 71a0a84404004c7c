"""Signature trees: sets in hierarchical nodes with OR-combined token bitmaps and size ranges.

Pure numpy on a bounded group of sets. A leaf node has ``LEAF`` neighbouring sets, an inner node ``LEAF``
nodes. A dual traversal descends pairs of nodes and drops a pair when the largest overlap its bitmaps
and sizes allow is below the least overlap that its smallest sizes demand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 8
#: Pairs of nodes that are looked at together, and words of their bitmaps: what they descend to is LEAF * LEAF as many.
FRONT_PAIRS, FRONT_WORDS = 16_384, 262_144
MIN_BITS = 64
BITS_PER_TOKEN = 2


def signature(tokens: np.ndarray) -> bytes:
    """Bitmap of a set of hashed tokens; its length is a power of two of about two bits per token."""
    bits = max(MIN_BITS, 1 << int(np.ceil(np.log2(max(1, BITS_PER_TOKEN * len(tokens))))))
    flags = np.zeros(bits, np.uint8)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def common(sigs: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, the longer ones folded to the shortest."""
    width = min(len(s) for s in sigs)
    out = np.zeros((len(sigs), width // 8), np.uint64)
    for k, s in enumerate(sigs):
        out[k] = np.bitwise_or.reduce(np.frombuffer(s, "<u8").reshape(-1, width // 8), 0)
    return out


def demanded(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of two sets with so many tokens together, for a Jaccard similarity of num / den."""
    return -(-num * sizes // (num + den))


class Tree:
    """Levels from the sets up to one node; a level has bitmaps, size range, largest excess, class range."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, label: np.ndarray):
        excess = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, n, n, excess, label, label)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, ex, first, last = self.levels[-1]
            at = np.arange(0, len(b), LEAF)
            self.levels.append(
                (np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at))
            )

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, slack) of sets a < b of different classes that may be similar; slack is bound less demand."""
        yield from self._descend(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), num, den)

    def _descend(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        bits, lo, hi, ex, first, last = self.levels[level]
        step = max(1, min(FRONT_PAIRS, FRONT_WORDS // bits.shape[1]))
        for k in range(0, len(a), step):
            p, q = a[k : k + step], b[k : k + step]
            settled = (first[p] == last[p]) & (first[q] == last[q]) & (first[p] == first[q])
            keep = ~settled & (den * hi[p] >= num * lo[q]) & (den * hi[q] >= num * lo[p])
            p, q = p[keep], q[keep]
            most = np.bitwise_count(bits[p] & bits[q]).sum(1, dtype=np.int64) + np.minimum(ex[p], ex[q])
            slack = np.minimum(most, np.minimum(hi[p], hi[q])) - demanded(lo[p] + lo[q], num, den)
            keep = slack >= 0
            p, q, slack = p[keep], q[keep], slack[keep]
            if level == 0:
                if len(p):
                    yield p, q, slack
                continue
            below = len(self.levels[level - 1][0])
            x = (p[:, None] * LEAF + np.arange(LEAF))[:, :, None] + np.zeros((1, 1, LEAF), np.int64)
            y = (q[:, None] * LEAF + np.arange(LEAF))[:, None, :] + np.zeros((1, LEAF, 1), np.int64)
            x, y = x.ravel(), y.ravel()
            fit = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
            yield from self._descend(level - 1, x[fit], y[fit], num, den)

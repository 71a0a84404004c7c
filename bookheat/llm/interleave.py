"""Burrows-Wheeler transforms of shards and their merge by iterative interleave refinement.

Pure numpy on a bounded collection of byte strings. A symbol is ``width`` bytes, so the suffix at byte ``i``
is followed by the one at ``i + width`` and a string has ``width`` end suffixes without symbols. Symbols are
compared through 64-bit hashes; their order is that of the hashes, which serves for equality as well as
the order of the bytes.

``transforms`` sorts the suffixes of each shard. ``merge`` never sorts suffixes: it keeps an array with
the shard of each place of the merged order, at first shard after shard, and refines it. One round
deals the places, in order, by the symbol before their suffix (the step of the merged transform), which gives
the order by one more symbol; a boundary that appears in round ``j`` between two places says that their
suffixes have ``j - 1`` symbols in common.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from bookheat.llm.hashing import mix

_STEPS = [np.uint64(v) for v in (0x100000001B3, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_JOIN = np.uint64(0xA0761D6478BD642F)


def byte_grams(b: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive bytes, put together from powers of two."""
    if len(b) < width:
        return np.zeros(0, np.uint64)
    n, h, have, out, at = len(b) - width + 1, b.astype(np.uint64), 1, None, 0
    for k in range(width.bit_length()):
        if width >> k & 1:
            out = h[at : at + n].copy() if out is None else out * _JOIN + h[at : at + n]
            at += have
        if width >> (k + 1):
            h = h[: len(h) - have] * _STEPS[k % len(_STEPS)] + h[have:]
            have *= 2
    return mix(out)


def stable_order(c: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0, by radix passes over 16 bits."""
    order = np.argsort((c & 0xFFFF).astype(np.uint16), kind="stable")
    top = int(c.max(initial=0)) >> 16
    if top:
        order = order[np.argsort((c[order] >> 16).astype(np.uint8 if top < 256 else np.uint16), kind="stable")]
    return order


class Shards(NamedTuple):
    sizes: np.ndarray  # suffixes of each shard
    ends: np.ndarray  # of them, without symbols
    suffix: np.ndarray  # shard after shard in order: number of the suffix
    before: np.ndarray  # the symbol before each, 0 if there is none


def transforms(b: np.ndarray, sizes: np.ndarray, shard: np.ndarray, width: int) -> Shards:
    """Transform of each shard. ``b`` are the strings laid end to end, ``sizes`` their lengths, ``shard`` (ascending) theirs.

    Suffixes are numbered string after string, ``size + 1`` in each.
    """
    of = np.repeat(np.arange(len(sizes)), sizes + 1)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    place = np.arange(len(of)) - base[of]
    h = byte_grams(b, width)
    full = place + width <= sizes[of]
    symbol = np.zeros(len(of), np.int64)
    symbol[full] = np.unique(h[np.arange(len(of))[full] - of[full]], return_inverse=True)[1] + 1
    home = shard[of].astype(np.uint8 if shard.max(initial=0) < 256 else np.uint16)
    empty, follows = np.flatnonzero(~full), place >= width
    order = np.arange(len(of))
    for _ in range(int(-(-(sizes.max(initial=0) + 1) // width))):
        earlier = order[follows[order]] - width
        earlier = np.concatenate([empty, earlier[stable_order(symbol[earlier])]])
        order = earlier[np.argsort(home[earlier], kind="stable")]
    before = np.zeros(len(of), np.int64)
    has = follows[order]
    before[has] = symbol[order[has] - width]
    shards = int(shard.max(initial=-1)) + 1
    return Shards(np.bincount(home, minlength=shards), np.bincount(home[empty], minlength=shards), order, before)


def merge(x: Shards, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each suffix of ``x.suffix`` in the merged order, symbols in common of each place and the one before).

    Common symbols are counted up to ``rounds``.
    """
    kind = np.uint8 if len(x.sizes) < 256 else np.uint16
    z = np.repeat(np.arange(len(x.sizes)), x.sizes).astype(kind)
    first = np.repeat(np.arange(len(x.sizes)), x.ends).astype(kind)
    lcp = np.full(len(z), rounds, np.int64)
    lcp[:1] = 0
    group = np.zeros(len(z), np.int64)
    for done in range(rounds):
        symbol = np.empty(len(z), np.int64)
        symbol[np.argsort(z, kind="stable")] = x.before
        at = np.flatnonzero(symbol)
        at = at[stable_order(symbol[at])]
        c, g = symbol[at], group[at]
        new = np.concatenate([np.arange(len(first)) == 0, np.ones(min(1, len(at)), bool), (c[1:] != c[:-1]) | (g[1:] != g[:-1])])
        lcp[new & (lcp == rounds)] = done
        z, group = np.concatenate([first, z[at]]), np.cumsum(new)
    return np.argsort(z, kind="stable"), lcp


def repeated(x: Shards, rounds: int) -> np.ndarray:
    """Whether each suffix, by its number, has ``rounds`` symbols in common with another one.

    Meaningful for suffixes of so many symbols; shorter ones meet others that end alike.
    """
    places, lcp = merge(x, rounds)
    close = lcp >= rounds
    twice = close | np.append(close[1:], False)
    out = np.zeros(len(places), bool)
    out[x.suffix] = twice[places]
    return out

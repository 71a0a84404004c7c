"""Quality by supervised subword embeddings.

Features of a text are its words, the character 3- and 4-grams of each word with its borders, and pairs
of neighbouring words (a word repeated at once gives one feature whatever the word). Each is hashed to a
learned vector; the vectors are averaged over all occurrences in the document and a softmax layer turns
the mean into two class probabilities. Vectors and layer are learned together by stochastic gradient
descent in numpy on a bounded sample of labelled documents (``labelled``). The layer is linear, so for
scoring each feature is reduced to one number, the difference of its two logits: the model that travels
with the tasks is one array of ``2 ** HASH_BITS`` numbers. Every whole text is scored where it is read;
nothing is shuffled.

Cases: as in ``toxicity``: texts without words get the score of the bias alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from bookheat.llm.common import chunks, lean
from bookheat.llm.labelled import scored, training

HASH_BITS = 17
WIDTH = 12
EPOCHS = 5
BATCH = 16
RATE = 2.0
GRAMS = (3, 4)
#: Most labelled documents that the model is fitted on.
FIT_ROWS = 4000
THRESHOLD = 0.3
MEMORY_WORDS = 200_000
_TOP = (1 << HASH_BITS) - 1
_SAME = xxhash.xxh32_intdigest(b"\0same") & _TOP


class Model(NamedTuple):
    bias: float
    logit: np.ndarray  # difference of the logits, by feature


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word; word (by place) and feature of all their words and character n-grams."""
    h = np.fromiter((xxhash.xxh32_intdigest(w.encode()) for w in words), np.int64, len(words))
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the word's end
    owner, feature = [np.arange(len(words))], [h & _TOP]
    for n in GRAMS:
        if len(codes) < n:
            continue
        g = np.zeros(len(codes) - n + 1, np.uint64)
        for j in range(n):
            g = g * np.uint64(0xD6E8FEB86659FD93) + codes[j : j + len(g)] + np.uint64(n)
        g = (g ^ (g >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        at = np.flatnonzero(left[: len(g)] >= n)
        owner.append(of[at])
        feature.append((g[at] >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    return h, np.concatenate(owner), np.concatenate(feature)


class Words(dict):
    """Word to its number; by number the word's hash and the sum and count of its features' logits."""

    def __init__(self, logit: np.ndarray):
        self.logit = logit
        self.hash, self.sum, self.count = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the words of each text."""
        split = [t.split() for t in texts]
        if len(self) >= MEMORY_WORDS:
            self.clear()
            self.hash, self.sum, self.count = self.hash[:0], self.sum[:0], self.count[:0]
        new = list(set().union(*split).difference(self))
        if new:
            h, owner, feature = word_features(new)
            self.update(zip(new, range(len(self.hash), len(self.hash) + len(new))))
            self.hash = np.concatenate([self.hash, h])
            self.sum = np.concatenate([self.sum, np.bincount(owner, self.logit[feature], len(new))])
            self.count = np.concatenate([self.count, np.bincount(owner, minlength=len(new))])
        return [np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in split]


def pair_features(h: np.ndarray) -> np.ndarray:
    """Features of neighbouring words from the words' hashes."""
    a, b = h[:-1].astype(np.uint64), h[1:].astype(np.uint64)
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - HASH_BITS)
    return np.where(a == b, _SAME, mixed.astype(np.int64))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        feats, shares = [], []
        for t in b.column("text").to_pylist():
            words = t.split()
            own = sorted(set(words))
            place = {w: k for k, w in enumerate(own)}
            n = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            h, owner, feature = word_features(own)
            f = np.concatenate([feature, pair_features(h[n])])
            c = np.concatenate([np.bincount(n, minlength=len(own))[owner], np.ones(max(0, len(n) - 1), np.int64)])
            f, back = np.unique(f, return_inverse=True)
            feats.append(f.astype(np.int32))
            shares.append((np.bincount(back, c, len(f)) / max(1, c.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("y"), pa.array(feats, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
            ["doc_id", "y", "features", "shares"],
        )


def fit_rows(feats: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Model(float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), np.zeros(_TOP + 1))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (_TOP + 1, WIDTH)).astype(np.float32)
    seen = np.zeros(_TOP + 1, bool)
    for f in feats:
        seen[f] = True
    table[~seen] = 0
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            rate = np.float32(RATE * (1 - done / steps))
            done += len(pick)
            mean = np.stack([shares[i] @ table[feats[i]] for i in pick])
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick].astype(int)] -= 1
            back = p @ layer.T
            for k, i in enumerate(pick):
                table[feats[i]] -= rate * shares[i][:, None] * back[k]
            layer -= rate * mean.T @ p / len(pick)
            bias -= rate * 0.1 * p.mean(0)
    return Model(float(bias[1] - bias[0]), (table @ (layer[:, 1] - layer[:, 0])).astype(np.float64))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    flat = column.combine_chunks()
    values, ends = flat.values.to_numpy(), flat.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Model of ``label`` from a bounded sample; ``labels`` has ``doc_id`` and ``label``."""
    sample = training(docs, labels, label, rows)
    kind = dict(sample.dtypes)["doc_id"]
    got = sample.mapInArrow(lean(_extract), f"doc_id {kind}, y int, features array<int>, shares array<float>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    return fit_rows(_lists(got.column("features")), _lists(got.column("shares")), got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``, the probability of label 1 of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.logit)
        for b in chunks(batches, "text"):
            raws = []
            for n in words.numbers([t or "" for t in b.column("text").to_pylist()]):
                pairs = pair_features(words.hash[n])
                total = words.sum[n].sum() + model.logit[pairs].sum()
                raws.append(model.bias + total / max(1.0, words.count[n].sum() + len(pairs)))
            p = 1 / (1 + np.exp(-np.clip(np.array(raws), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], ["row", "text", "p"])

    return scored(docs, run, text, into)

"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-case words and their first four and five letters, hashed. A
second-order factorization machine scores them: a weight for each term and, through the inner product
of term vectors, one for each pair (an insult beside a mention of a group), which additive weights
miss. It is fitted by AdaGrad in numpy on a bounded sample of labelled documents (``labelled``), over
the terms of the sample with the highest chi-square; the model is at most ``TERMS`` rows of
``FACTORS + 1`` numbers and travels with the tasks. Every whole text is scored where it is read; nothing
is shuffled.

Cases: null and empty texts get the score of a text without terms; repeated rows and null ids are
scored like others; ties do not matter; without labels of both kinds the score is the share of label 1 (one half without
any label); an empty table gives no rows; other columns of the input pass through, one named like a new
column, in either case of letters, is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from bookheat.llm.common import chunks, lean
from bookheat.llm.labelled import FIT_ROWS, scored, training

HASH_BITS = 22
TERMS = 1024
FACTORS = 8
LEAST_DOCS = 5
EPOCHS = 12
BATCH = 32
RATE = 0.2
DECAY = 1e-4
THRESHOLD = 0.5
#: Most words that a task remembers, and most characters of one: some 30 MB.
MEMORY_WORDS, MEMORY_CHARS = 200_000, 40
_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    bias: float
    terms: np.ndarray  # hashed terms, ascending
    weight: np.ndarray
    vectors: np.ndarray


def terms_of(word: str) -> list[int]:
    top = (1 << HASH_BITS) - 1
    parts = {word, *(word[:n] + "*" for n in (4, 5) if len(word) > n)}
    return [xxhash.xxh32_intdigest(p.encode()) & top for p in parts]


def text_terms(text: str) -> np.ndarray:
    return np.unique(np.fromiter((t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)), np.int32))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        terms = pa.array([text_terms(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), terms], ["doc_id", "y", "terms"])


def _pick(docs: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """Terms of enough documents with the highest chi-square against the label."""
    # counts only of terms that occur in enough documents: arrays over all hashes would take hundreds of megabytes of the driver
    none = [np.zeros(0, np.int32)]
    seen, total = np.unique(np.concatenate([*docs, *none]), return_counts=True)
    seen, total = (v[total >= LEAST_DOCS] for v in (seen, total.astype(float)))
    ones, count = np.unique(np.concatenate([*(d for d, label in zip(docs, y) if label), *none]), return_counts=True)
    _, at, of = np.intersect1d(seen, ones, assume_unique=True, return_indices=True)
    pos = np.zeros(len(seen))
    pos[at] = count[of]
    n, p = len(y), y.sum()
    gap = pos * n - total * p
    spread = total * (n - total) * p * (n - p)
    chi = np.where(spread > 0, n * gap**2 / np.maximum(spread, 1), 0.0)
    order = np.lexsort((seen, -chi))[:most]
    return np.sort(seen[order[chi[order] > 0]]).astype(np.int32)


def _raw(model: Model, at: np.ndarray) -> float:
    v = model.vectors[at]
    return float(model.bias + model.weight[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))


def fit_rows(docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """Fit on distinct terms per document; the order of the rows given is the order of learning."""
    share = float(y.mean()) if len(y) else 0.5
    none = Model(float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    if len(y) == 0 or share in (0.0, 1.0):
        return none
    terms = _pick(docs, y, TERMS)
    if not len(terms):
        return none
    rows = [np.flatnonzero(np.isin(terms, d, assume_unique=True)) for d in docs]
    rng = np.random.default_rng(seed)
    b, w = none.bias, np.zeros(len(terms))
    v = rng.normal(0, 0.01, (len(terms), FACTORS))
    gb, gw, gv = 1.0, np.full(len(terms), 1e-2), np.full_like(v, 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            used, sb = [], 0.0
            dw, dv = np.zeros(len(terms)), np.zeros_like(v)
            for i in order[lo : lo + BATCH]:
                at = rows[i]
                vec = v[at]
                total = vec.sum(0)
                raw = b + w[at].sum() + 0.5 * ((total**2).sum() - (vec**2).sum())
                err = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[i]
                sb += err
                dw[at] += err
                dv[at] += err * (total - vec)
                used.append(at)
            at = np.unique(np.concatenate(used)) if used else np.zeros(0, int)
            dw_, dv_ = dw[at] + DECAY * w[at], dv[at] + DECAY * v[at]
            gb += sb**2
            gw[at] += dw_**2
            gv[at] += dv_**2
            b -= RATE * sb / np.sqrt(gb)
            w[at] -= RATE * dw_ / np.sqrt(gw[at])
            v[at] -= 0.1 * RATE * dv_ / np.sqrt(gv[at])
    return Model(float(b), terms, w, v)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Model of ``label`` from a bounded sample; ``labels`` has ``doc_id`` and ``label``."""
    sample = training(docs, labels, label, rows)
    kind = dict(sample.dtypes)["doc_id"]
    got = sample.mapInArrow(lean(_extract), f"doc_id {kind}, y int, terms array<int>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    flat = got.column("terms").combine_chunks()
    values, ends = flat.values.to_numpy(), flat.offsets.to_numpy()
    return fit_rows([values[a:b] for a, b in zip(ends, ends[1:])], got.column("y").to_numpy().astype(float))


class _Memory(dict):
    """Word to the places of its terms in the model; forgets all when it grows too large, keeps no long words."""

    def __init__(self, model: Model):
        self.place = dict(zip(model.terms.tolist(), range(len(model.terms))))

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        got = tuple(self.place[t] for t in terms_of(word) if t in self.place)
        if len(word) <= MEMORY_CHARS:
            self[word] = got
        return got


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``, the probability of label 1 of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(model)
        for b in chunks(batches, "text"):
            raws = []
            for t in b.column("text").to_pylist():
                at = {p for w in set(_WORD.findall((t or "").lower())) for p in memory[w]}
                raws.append(_raw(model, np.array(sorted(at), int)))
            p = 1 / (1 + np.exp(-np.clip(np.array(raws), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], ["row", "text", "p"])

    return scored(docs, run, text, into)

"""Substring deduplication against all windows, on hostile texts and on the given documents."""

import random
import re
from collections import Counter
from hashlib import sha256

import pytest

from bookheat.llm.common import table
from bookheat.llm.substrings import deduplicate
from bookheat.llm.substrings_queries import op5_substring_dedup


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/sf{sf}"
    docs = table(spark, d, "documents").select("doc_id", "text").collect()
    want = {r.doc_id: (n, k, sha256(t.encode()).hexdigest()) for r, (n, k, t) in zip(docs, brute([r.text for r in docs], 35))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op5_substring_dedup(spark, d).collect()}
    assert got == want
    assert sum(k for _, k, _ in want.values()) > 0


@pytest.mark.parametrize("seed", range(3))
def test_hostile(spark, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 40)}" for _ in range(900)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 800)
            parts += base[a : a + rng.randint(1, 70)] if rng.random() < 0.7 else [f"u{rng.random()}" for _ in range(rng.randint(1, 30))]
        texts.append(rng.choice([" ", "\n", "\t\x0b "]).join(parts))
    texts += ["x " * 700, "x " * 40, "a b " * 300, "", None, " \n ", "é ü " * 50, "one\x1ctwo\x85three " * 40, texts[0], texts[0]]
    rows = [(i if i % 9 else None, t, i, "old") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, kept string")
    got = sorted((r.n, r.text, r.n_words, r.n_removed, r.kept) for r in deduplicate(docs, window=12).select("n", "text", "n_words", "n_removed", "kept").collect() if r.text is not None)
    want = sorted((i, t, *b) for i, (t, b) in enumerate(zip(texts, brute(texts, 12))) if t is not None)
    assert got == want
    assert deduplicate(docs, window=12).filter("text is null and n_words = 0 and kept = ''").count() == 1
    assert deduplicate(docs.limit(0)).count() == 0

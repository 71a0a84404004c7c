"""Jaccard join against all pairs, on families of near copies and on the given documents."""

import random
import re

import numpy as np
import pytest

from bookheat.llm.common import table
from bookheat.llm.jaccard import join_components
from bookheat.llm.jaccard_queries import op9_jaccard_join
from bookheat.llm.signature_trees import Tree, common, signature


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(docs, n, num, den):
    sets = [shingles(t, n) for _, t in docs]
    ids = [i for i, _ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    low = {}
    for k, i in enumerate(ids):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)]) for k, i in enumerate(ids))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/sf{sf}"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op9_jaccard_join(spark, d).collect())
    want = brute(docs, 3, 90, 100)
    assert got == want
    assert any(i != c for i, _, c in want)


@pytest.mark.parametrize("num", [80, 90])
def test_families(spark, num):
    rng = random.Random(num)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([5, 40, 150, 400]))]
        for _ in range(rng.choice([1, 3, 25])):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            docs.append(copy + (passage if rng.random() < 0.3 else []))
    docs += [passage + [word() for _ in range(k)] for k in range(0, 60)]
    docs = [(100 + k, " ".join(d)) for k, d in enumerate(docs)]
    docs += [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "one two"), (7, "É two"), (8, "é two")]
    rows = [(i, t, 0) for i, t in docs] + [(None, docs[0][1], 0), (docs[0][0], docs[0][1], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = [(r.id, r.n_shingles, r.component_id) for r in join_components(df, 3, num, 100).collect()]
    want = brute(docs, 3, num, 100)
    assert sorted(set(x for x in got if x[0] is not None)) == want
    assert len(got) == len(rows) and [x[2] for x in got if x[0] is None] == [None]
    assert join_components(df.limit(0), 3, num, 100).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64)
        for _ in range(rng.integers(1, 6)):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.04], rng.integers(0, 1 << 62, 3).astype(np.uint64)])))
    sets.sort(key=len)
    n, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    found = {(a, b) for p, q, _ in Tree(common([signature(s) for s in sets]), n, label).pairs(90, 100) for a, b in zip(p, q)}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 90 * (n[a] + n[b] - both):
                assert (a, b) in found
    assert len(found) < len(sets) ** 2 / 4


def test_trees_that_leave_many_pairs_are_asked_again(spark, monkeypatch):
    from bookheat.llm import jaccard

    monkeypatch.setattr(jaccard, "FEW", 0)
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
    docs = [(k, " ".join(w if rng.random() > 0.012 else f"x{rng.randint(0, 99)}" for w in base)) for k in range(50)]
    got = sorted((r.id, r.n_shingles, r.component_id) for r in join_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90, 100).collect())
    assert got == brute(docs, 3, 90, 100)

"""Held-out accuracy of the classifiers, the pairs of the factorization machine, and the defined cases."""

import zlib

import numpy as np
import pytest

from bookheat.llm import quality, toxicity
from bookheat.llm.classify_queries import op1_quality, op3_toxicity
from bookheat.llm.common import table

SF = "/root/testdata/sf0.1"


def auc(y, s):
    rank = np.argsort(np.argsort(s))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


@pytest.mark.parametrize("job, label, least", [(op1_quality, "quality", 0.97), (op3_toxicity, "toxic", 0.95)])
def test_held_out(spark, job, label, least):
    got = job(spark, SF).toPandas()
    labels = table(spark, SF, "labels").toPandas()
    assert len(got) == table(spark, SF, "documents").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    both = got.merge(labels, on="doc_id")
    out = both[both.held_out]
    assert auc(out[label].values, out.score.values) >= least
    assert (out.predicted == out[label]).mean() >= 0.95


def test_repeats(spark):
    d = "/root/testdata/sf0.001"
    for job in (op1_quality, op3_toxicity):
        assert sorted(job(spark, d).collect()) == sorted(job(spark, d).collect())


def test_pairs_that_weights_miss():
    """Label 1 only where two terms meet: no additive weights can tell."""
    rng = np.random.default_rng(0)
    insult, group = toxicity.terms_of("insult")[0], toxicity.terms_of("group")[0]
    docs, y = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        other = toxicity.text_terms(" ".join(f"word{w}" for w in "abcdefgh" if rng.random() < 0.5))
        docs.append(np.unique(np.concatenate([other, [insult] * int(a), [group] * int(b)]).astype(np.int32)))
        y.append(float(a == b))
    model = toxicity.fit_rows(docs[:900], np.array(y[:900]))
    at = [np.flatnonzero(np.isin(model.terms, d)) for d in docs[900:]]
    assert {insult, group} <= set(model.terms.tolist())
    assert auc(np.array(y[900:]), np.array([toxicity._raw(model, a) for a in at])) > 0.9


@pytest.mark.parametrize("kind, label", [(quality, "quality"), (toxicity, "toxic")])
def test_cases(spark, kind, label):
    rows = [(i, "good words here" if i % 2 else "BAD!! BAD!!", 0.5) for i in range(1, 60)] + [(None, None, 1.0), (2, "BAD!! BAD!!", None), (70, "", 0.0), (71, "z" * 300000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(None, 1), (3, None), (4, 0)], f"doc_id long, {label} int")
    model = kind.fit(docs, labels)
    got = kind.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    for some in (labels.limit(0), labels.filter(f"{label} = 1")):
        assert all(0 <= r.score <= 1 for r in kind.score(docs, kind.fit(docs, some)).collect())
    assert kind.score(docs.limit(0), model).count() == 0
    assert kind.score(docs, kind.fit(docs.limit(0), labels)).count() == len(rows)


def plain_quality(model, text):
    """Score of one text, feature by feature."""
    import xxhash

    big, top, words, total, count = 1 << 64, (1 << quality.HASH_BITS) - 1, text.split(), 0.0, 0
    h = [xxhash.xxh32_intdigest(w.encode()) for w in words]
    for w, own in zip(words, h):
        found = [own & top]
        codes = [ord(c) for c in f"<{w}>"]
        for n in quality.GRAMS:
            for i in range(len(codes) - n + 1):
                g = 0
                for c in codes[i : i + n]:
                    g = (g * 0xD6E8FEB86659FD93 + c + n) % big
                found.append((g ^ (g >> 32)) * 0x9E3779B97F4A7C15 % big >> (64 - quality.HASH_BITS))
        total, count = total + sum(float(model.logit[f]) for f in found), count + len(found)
    for a, b in zip(h, h[1:]):
        f = quality._SAME if a == b else (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % big >> (64 - quality.HASH_BITS)
        total, count = total + float(model.logit[f]), count + 1
    return 1 / (1 + np.exp(-(model.bias + total / max(1, count))))


def plain_toxicity(model, text):
    """Score of one text: the weights of its terms and the products of every two term vectors."""
    import re

    import xxhash

    terms = set()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for part in {w, *(w[:n] + "*" for n in (4, 5) if len(w) > n)}:
            terms.add(xxhash.xxh32_intdigest(part.encode()) & (1 << toxicity.HASH_BITS) - 1)
    at = [k for k, t in enumerate(model.terms.tolist()) if t in terms]
    raw = model.bias + sum(float(model.weight[k]) for k in at)
    for n, i in enumerate(at):
        for j in at[n + 1 :]:
            raw += sum(float(a) * float(b) for a, b in zip(model.vectors[i], model.vectors[j]))
    return 1 / (1 + np.exp(-raw))


@pytest.mark.parametrize("kind, label, plain", [(quality, "quality", plain_quality), (toxicity, "toxic", plain_toxicity)])
def test_scores_equal_the_plain_version(spark, kind, label, plain):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = kind.fit(docs, table(spark, d, "labels"))
    some = [r for r in docs.orderBy("doc_id").collect() if len(r.text or "") < 4000][::12]
    odd = [(-1, None), (-2, ""), (-3, "same same same a"), (-4, "Ünïcödé 𝔘𝔫𝔦 a"), (-5, "x" * 300), (-6, "\x85   b")]
    given = spark.createDataFrame([*map(tuple, some), *odd], "doc_id long, text string")
    got = {r.doc_id: r.score for r in kind.score(given, model).collect()}
    assert len(got) == len(some) + len(odd) > 60
    worst = max(abs(got[i] - plain(model, t or "")) for i, t in [*map(tuple, some), *odd])
    assert worst < 1e-9


def test_terms_are_picked_with_memory_for_those_that_occur():
    """The chi-square of every term, without arrays over all hashes in the driver."""
    import tracemalloc

    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, 1 << toxicity.HASH_BITS, 40) % 300 * 9973).astype(np.int32) for _ in range(200)]
    y = (rng.random(200) < 0.3).astype(float)
    n, p, want = len(y), y.sum(), {}
    for t in set(np.concatenate(docs).tolist()):
        has = np.array([t in d for d in docs])
        total, pos = has.sum(), y[has].sum()
        if total >= toxicity.LEAST_DOCS and total < n:
            want[t] = n * (pos * n - total * p) ** 2 / (total * (n - total) * p * (n - p))
    tracemalloc.start()
    got = toxicity._pick(docs, y, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best = sorted((t for t in want if want[t] > 0), key=lambda t: (-want[t], t))[:50]
    assert got.tolist() == sorted(best) and peak < 8e6
    assert toxicity._pick([np.zeros(0, np.int32)] * 3, np.array([0.0, 1.0, 0.0]), 50).tolist() == []

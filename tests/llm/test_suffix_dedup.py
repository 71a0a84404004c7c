import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookheat.llm import suffix_dedup
from bookheat.llm.interleave import merge, repeated, transforms
from bookheat.llm.suffix_dedup import deduplicate


def brute(texts, window):
    """(n_bytes, n_removed, n_spans, kept) of each text, by counting every window."""
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if times[d[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def texts_of(seed, n, size):
    """Random texts over few letters with shared passages, copies, runs of one letter and odd ones."""
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    passages = [some(rng.randint(20, 90)) for _ in range(6)]
    out = []
    for _ in range(n):
        t = some(rng.randint(0, size))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice(passages)[rng.randint(0, 5) :] + t[at:]
        out.append(t)
    return [*out, *out[:5], None, "", "x" * 500, "x" * 300, "ab" * 200, passages[0] * 3]


def rows(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()}


@pytest.mark.parametrize("window, hot", [(20, 2048), (24, 2), (13, 3), (30, 0)])
def test_brute_force(spark, window, hot):
    texts = texts_of(window, 60, 200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert rows(deduplicate(docs, window=window, hot=hot)) == dict(enumerate(brute(texts, window)))


def test_segments_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh") for _ in range(150))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(40)) + passage + "".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(deduplicate(docs, window=25, hot=4)) == dict(enumerate(brute(texts, 25)))


def test_cases(spark):
    schema = "doc_id long, text string, Kept int, row string, chunk long, blob string, `a b` int, seed string, pos int, spans string"
    given = [(None, "z" * 50, 1, "r", 2, "b", 3, "s", 4, "t"), (1, None, None, None, None, None, None, None, None, None), (1, "q", 1, "r", 2, "b", 3, "s", 4, "t")]
    out = deduplicate(spark.createDataFrame(given, schema), window=20)
    assert out.columns == ["doc_id", "row", "chunk", "blob", "a b", "seed", "pos", "spans", "n_bytes", "n_removed", "n_spans", "kept"]
    assert Counter((r["n_bytes"], r["n_removed"], r["row"]) for r in out.collect()) == Counter([(50, 50, "r"), (0, 0, None), (1, 0, "r")])
    assert deduplicate(spark.createDataFrame([], schema)).collect() == []
    only = deduplicate(spark.createDataFrame([("y" * 30,)], "text string"), window=20)
    assert only.columns == ["n_bytes", "n_removed", "n_spans", "kept"] and only.first()["n_removed"] == 30


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    got = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(got, brute([r["text"] for r in got], 200))}
    frame = spark.createDataFrame(got, "doc_id long, text string").withColumn("doc_id", F.col("doc_id"))
    assert rows(deduplicate(frame)) == want


def test_merge_gives_the_sorted_order():
    rng = np.random.default_rng(1)
    for _ in range(60):
        width, rounds = int(rng.integers(1, 4)), int(rng.integers(1, 5))
        strings = [rng.integers(97, 99, rng.integers(0, 20)).astype(np.uint8).tobytes() for _ in range(rng.integers(1, 9))]
        sizes = np.array([len(s) for s in strings])
        x = transforms(np.frombuffer(b"".join(strings), np.uint8), sizes, np.arange(len(sizes)) // 3, width)
        places, lcp = merge(x, rounds)
        assert sorted(places.tolist()) == list(range(len(places)))
        of = {}
        for s in strings:
            for i in range(len(s) + 1):
                of[len(of)] = s[i : i + (len(s) - i) // width * width]
        order = [of[k] for k in x.suffix[np.argsort(places)].tolist()]

        def common(a, b):
            k = 0
            while k < rounds and len(a) > k * width and a[k * width : (k + 1) * width] == b[k * width : (k + 1) * width]:
                k += 1
            # two ended suffixes are alike to any depth
            return rounds if a == b else k

        assert lcp[1:].tolist() == [common(a, b) for a, b in zip(order, order[1:])]
        flags = repeated(x, rounds)
        starts = [k for k, s in of.items() if len(s) >= rounds * width]
        times = Counter(of[k][: rounds * width] for k in starts)
        assert all(flags[k] == (times[of[k][: rounds * width]] > 1) for k in starts)


def test_kept_digest_of_query(spark):
    from bookheat.llm.suffix_queries import op13_suffix_dedup

    got = {r["doc_id"]: r for r in op13_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = dict(zip(texts, brute(list(texts.values()), 200)))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == {k: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for k, w in want.items()}

"""Each stage of the pipeline against a plain version, on the given documents and on odd rows."""

import re
from collections import Counter
from hashlib import sha256

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from bookheat.llm import secrets, toxicity
from bookheat.llm.bpe_queries import vocabulary
from bookheat.llm.common import table
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.01"
ODD = [
    (1, None, None, None, None, "x"),
    (2, "", "en", "a", 0, None),
    (3, "one two three four five six seven", "en", "a", 33, "x"),
    (4, "one two three four five six seven", "en", "b", 33, "x"),
    (3, "one two three four five six seven", "en", "a", 33, "x"),
    (None, "alone password: hunter2hunter2", "en", None, 30, "x"),
    (5, "api_key=ABCDEFGH12345 and " + "word " * 3000, "en", "a", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def rows(df):
    return df.select("doc_id", "text", "lang", "source", "n_chars").collect()


@pytest.fixture(scope="module")
def steps(spark):
    from bookheat.session import stage

    docs, out = table(spark, SF, "documents"), []
    for name, step in P.STAGES:
        after = stage(step(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def test_toxicity(spark, steps):
    before, after = steps[0]
    model = toxicity.fit(before, table(spark, SF, "labels"))
    import numpy as np

    def raw(t):
        return toxicity._raw(model, np.flatnonzero(np.isin(model.terms, toxicity.text_terms(t or ""))))

    want = {r.doc_id for r in rows(before) if raw(r.text) < 0}
    assert {r.doc_id for r in rows(after)} == want and after.columns == before.columns
    clean = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 0").collect()}
    assert len(clean - want) <= 0.01 * len(clean)


def test_near_duplicates(steps):
    before, after = steps[1]
    docs = [(r.doc_id, r.text) for r in rows(before)]
    want = {i for i, _, c in brute(docs, P.WORDS, P.NUM, P.DEN) if i == c}
    assert sorted(r.doc_id for r in rows(after)) == sorted(want) and len(want) < len(docs)


def test_secrets(steps):
    before, after = steps[2]
    got = {r.doc_id: r for r in rows(after)}
    hit = 0
    for r in rows(before):
        spans = secrets.find(r.text or "")
        hit += bool(spans)
        assert bool(spans) == (got[r.doc_id].text != r.text)
        assert not [s for s in secrets.find(got[r.doc_id].text or "") if s[1] < 3] or spans
        assert got[r.doc_id].n_chars == (len(got[r.doc_id].text) if spans else r.n_chars)
    assert hit and len(got) == before.count()


def test_mixing(steps):
    before, after = steps[3]
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows(before)}
    source = {r.doc_id: r.source for r in rows(before)}
    sizes, took = Counter(), Counter()
    for i, n in words.items():
        sizes[source[i]] += n
    times = Counter(r.doc_id for r in rows(after))
    for i, k in times.items():
        took[source[i]] += k * words[i]
    assert max(times.values()) <= 2
    left, goal, weights = dict(zip(sorted(sizes), [3, 1, 2] * len(sizes))), {}, None
    rest = 1.5 * sum(sizes.values())
    while True:
        weights = sum(left.values())
        full = [s for s, w in left.items() if w * rest / weights >= 2 * sizes[s]]
        if not full:
            break
        for s in full:
            goal[s] = 2 * sizes[s]
            rest -= goal[s]
            del left[s]
    goal |= {s: w * rest / weights for s, w in left.items()}
    for s in sizes:
        longest = max(words[i] for i in words if source[i] == s)
        assert goal[s] - 1 <= took[s] <= goal[s] + longest


def test_encoding(steps):
    before, after = steps[4]
    library = Tokenizer.from_file(vocabulary())
    want = Counter((r.doc_id, sha256((r.text or "").encode()).hexdigest()) for r in rows(before))
    assert Counter((r.doc_id, r.decoded_sha256) for r in after.collect()) == want
    some = {r.doc_id: r.n_tokens for r in after.collect()}
    for r in rows(before)[::25]:
        assert some[r.doc_id] == len(library.encode(r.text or "", add_special_tokens=False).ids)


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    out = [docs]
    for _, step in P.STAGES:
        out.append(step(spark, out[-1], SF))
    assert all(x.columns == docs.columns for x in out[1:-1])
    assert out[1].count() == 7
    kept = sorted((r.doc_id or 0) for r in out[2].collect())
    assert kept == [0, 1, 2, 3, 5]
    redacted = {r.doc_id: r for r in out[3].collect()}
    assert redacted[None].text == "alone [ASSIGN]" and redacted[5].text.startswith("[ASSIGN] and word") and redacted[5].score == "x"
    assert out[5].count() == out[4].count()
    empty = docs.limit(0)
    for _, step in P.STAGES:
        empty = step(spark, empty, SF)
        assert empty.count() == 0


def test_run(spark, steps):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0


def test_one_id_with_different_texts_is_several_documents(spark):
    words = [f"w{i}" for i in range(200)]
    b, near = " ".join(words), " ".join([*words[:-1], "other"])
    docs = [(1, "an own text of one two three four words", "en", "a", 1, "x"), (1, b, "en", "a", 2, "x"), (7, near, "en", "a", 3, "x"), (7, near, "en", "a", 3, "x"), (8, None, "en", "a", 0, "x"), (8, "", "en", "a", 0, "x")]
    for order in (docs, docs[::-1]):
        got = P.drop_near_duplicates(spark, spark.createDataFrame(order, SCHEMA).repartition(3), SF).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, docs[0][1]), (1, b), (8, None), (8, "")])

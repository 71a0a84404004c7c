import random
import re
import zlib
from collections import Counter

import pytest

from bookheat.llm import spelling
from bookheat.llm.spelling import near_words, roots, variants, vocabulary


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :]


def brute_words(rows, least_chars, least_times, slip):
    total = Counter()
    for i, t in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_chars:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= least_times}


def brute(words, factor=10):
    out = {}
    for w, n in words.items():
        near = sorted((-words[v], v) for v in words if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= factor * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    for w in words:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] = (*out[w][:4], root)
    return out


def found(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def some_words(seed, n, letters="abé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)}
    return {w: rng.choice([1, 2, 5, 60, 700, 9000]) for w in words}


@pytest.mark.parametrize("seed, hot", [(1, 1024), (2, 3), (3, 1), (4, 20)])
def test_brute_force(spark, seed, hot):
    words = some_words(seed, 250)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert found(variants(frame, hot=hot)) == brute(words)
    pairs = near_words(frame, hot).count()
    assert pairs == sum(v[1] for v in brute(words).values())


def test_common_beginnings_and_ends(spark):
    rng = random.Random(9)
    stems = ["understanding" + "".join(rng.choice("abc") for _ in range(3)) for _ in range(40)] + ["".join(rng.choice("xyz") for _ in range(3)) + "ification" for _ in range(40)]
    words = {w: rng.choice([2, 3, 50, 4000]) for w in stems} | {"x" * 300: 5, "x" * 299: 70, "x" * 299 + "y": 800}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    for hot in (1024, 4):
        assert found(variants(frame, hot=hot)) == brute(words)


@pytest.mark.parametrize("slip", [None, 3])
def test_vocabulary(spark, slip):
    texts = ["Grosse GROSSE grosse straßen Straßen", "Éclairs éclairs eclairs aéroport-aéroport", None, "", "a" * 40000 + " 1abcdefg2abcdefg", "abcdefg " * 50, "İstanbul ſeven naïveté×naïveté"]
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(texts * 2)]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    got = {r["word"]: r["n"] for r in vocabulary(docs, least_chars=3, slip=slip).collect()}
    assert got == brute_words(rows, 3, 2, slip)
    assert vocabulary(docs.limit(0)).collect() == []


def test_empty_and_chain(spark):
    assert variants(spark.createDataFrame([], "word string, n long")).collect() == []
    links = [(f"w{k}", f"w{k + 1}") for k in range(13)] + [("v", "w5")]
    got = {r["word"]: r["root"] for r in roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "w13" for w, _ in links}


def test_query(spark):
    from bookheat.llm.spelling_queries import SLIP, op12_spelling_variants

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = brute_words(rows, spelling.LEAST_CHARS, spelling.LEAST_TIMES, SLIP)
    got = found(op12_spelling_variants(spark, sf))
    assert {w: v[0] for w, v in got.items()} == words
    # near words of some hundred words, by comparing each with all
    want = {w: sorted((-words[v], v) for v in words if one_edit(w, v)) for w in sorted(words)[::25]}
    for w, near in want.items():
        n, n_near, form, form_n, _ = got[w]
        assert n_near == len(near)
        assert (form, form_n) == ((near[0][1], -near[0][0]) if near and -near[0][0] >= 10 * n else (None, None))

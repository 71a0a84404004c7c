"""Further columns that are named like columns the operators use inside, in either case of letters."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from bookheat.llm import bpe, mixing, quality, secrets, substrings, suffix_dedup, toxicity
from bookheat.llm.bpe_queries import vocabulary

SF = "/root/testdata/sf0.001"
INSIDE = (
    "_n _key _source _null _size _range _target _w _cap _row _text _ids _out _no _leaf _kept _h _before _blob "
    "row others before id h p blob spans rule_version chunk pos seed content k1 k2 n word key "
    "Label y tok s first sig copies_ pass_ ROW2"
).split()
CLASH = ["Score2", *INSIDE, *(c.swapcase() + "_" for c in INSIDE), "a b", "with.dot"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i} of some words with password: hunter2hunter{i} " + "and more " * (i % 7), "en", f"s{i % 3}", 9) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(c).alias(c) for c in CLASH])


def untouched(df):
    got = df.select(*[F.col(f"`{c}`") for c in CLASH]).distinct().collect()
    assert len(got) == 1 and list(got[0]) == CLASH


@pytest.mark.parametrize("name, stage", P.STAGES[:-1])
def test_stages(spark, docs, name, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    untouched(out)


def test_operators(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    path = vocabulary()
    for kind in (quality, toxicity):
        given = docs.withColumn("SCORE", F.lit("old"))
        out = kind.score(given, kind.fit(docs, labels))
        assert [c for c in out.columns if c.lower() == "score"] == ["score"]
        untouched(out)
    coded = bpe.encode(docs.withColumn("IDS", F.lit(1)), path)
    assert [c for c in coded.columns if c.lower() == "ids"] == ["ids"]
    untouched(bpe.decode(coded.withColumn("Decoded", F.lit(1)), path))
    untouched(substrings.deduplicate(docs.withColumn("N_Words", F.lit(1)), window=12))
    untouched(suffix_dedup.deduplicate(docs.withColumn("N_Bytes", F.lit(1)), window=20))
    untouched(mixing.mix(docs.withColumn("TAKEN", F.lit(1))))
    untouched(secrets.redact(docs))


def test_key_blocks():
    body = "\n".join(["MIIEowIBAAKCAQEA" * 4] * 2000)
    good = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{body}\n-----END RSA PRIVATE KEY-----"
    assert (2, 3, 2 + len(good)) in secrets.find("x " + good + " y")
    for bad in (
        "-----BEGIN PRIVATE KEY-----\nSome prose, and more of it.\n-----END RSA PRIVATE KEY-----",
        "-----BEGIN PRIVATE KEY-----\nSome prose, and more of it.\n-----END PRIVATE KEY-----",
        "-----BEGIN PRIVATE KEY-----\nabcd\n-----END RSA PRIVATE KEY-----",
        "-----BEGIN PRIVATE KEY----------END PRIVATE KEY-----",
    ):
        assert not [s for s in secrets.find(bad) if s[1] == 3]
    twice = "-----BEGIN PRIVATE KEY-----\nlost\n" + "-----BEGIN PRIVATE KEY-----\nabcd\n-----END PRIVATE KEY-----"
    assert [s for s in secrets.find(twice) if s[1] == 3] == [(33, 3, len(twice))]

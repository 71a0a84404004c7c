"""The mix against its SQL, and the defined cases."""

import pytest

from bookheat.llm.common import table, word_count
from bookheat.llm.mixing import mix
from bookheat.llm.mixing_queries import SQL, op10_mix_sources
from tests.compare import connect, rows_of

SCHEMA = "doc_id long, text string, source string, size string"


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/sf{sf}"
    df = op10_mix_sources(spark, d)
    rel = connect(d).execute(SQL)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([x[0] for x in rel.description], rel.fetchall())


def test_only_dataframe_functions(spark):
    df = op10_mix_sources(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert df.exceptAll(op10_mix_sources(spark, "/root/testdata/sf0.001")).isEmpty()


def test_cases(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", None), (3, "one two  three", "b", "x"), (3, "one two  three", "b", "x"), (None, "\tfour\n", None, "x"), (4, " ", "c", "x"), (5, "é ü" * 50000, "b", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert by["a"][0].source_size == 0 and by["a"][0].target == 0 and by["a"][0].taken == 0 and by["a"][0].copies == 1
    for source, part in by.items():
        target = part[0].target
        assert sum(r.taken for r in part) == int(target) and target <= 2 * part[0].source_size
        assert all(0 <= r.taken <= 2 * r["size"] for r in part)
    assert mix(docs.limit(0)).count() == 0
    assert all(r.taken == 2 * r["size"] for r in mix(docs, share=2.0).collect())


def test_words(spark):
    texts = ["", " ", "a", " a", "a ", "\x0b\x0ca\rb\t", "a\x1cb", "a b", "x " * 1000, "\n" * 50]
    got = spark.createDataFrame([(t, len(t.encode().split())) for t in texts], "t string, n long")
    assert got.filter(word_count(got["t"]) != got["n"]).count() == 0


def test_hot_source_is_cut(spark):
    df = mix(table(spark, "/root/testdata/sf0.01", "documents"))
    assert "_range" in df._jdf.queryExecution().toString()

"""Recall of the tree search against brute force, exact scores, and the defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookheat.llm import ann
from bookheat.llm.common import table
from bookheat.llm.vector_queries import op6_nearest_neighbours


def exact(rows, query_ids, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in query_ids:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        out[q] = [(ids[n], d[n]) for n in np.lexsort((ids, d)) if ids[n] != q][:k]
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall(spark, sf):
    d = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding) for r in table(spark, d, "embeddings").collect()]
    want = exact(rows, [i for i, _ in rows if i % 100 == 0])
    got = {}
    for r in op6_nearest_neighbours(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    x = {i: np.array(v, float) for i, v in rows}
    assert all(abs(np.sqrt(((x[q] - x[i]) ** 2).sum()) - s) < 1e-12 for q, found in got.items() for i, s in found)


def test_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), "x") for i in range(1, 30)]
    rows += [(100 + i, [1.0] * 6, "x") for i in range(25)] + [(100, [1.0] * 6, "x")]
    rows += [(500, None, "x"), (501, [0.0] * 6, "x"), (502, [None] * 6, "x"), (503, [float("nan")] * 6, "x"), (504, [1.0], "x"), (None, [1.0] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    index = ann.build(df, width=6)
    got = ann.search(index, index.rows.filter("id = 100").select("id", "vec")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(101, 111)) and all(r.score == 0 for r in got)
    few = ann.build(df.filter("vec_id < 5"))
    assert ann.search(few, few.rows.select("id", "vec")).count() == 4 * 3
    assert ann.build(df.limit(0)) is None


def test_shards_hold_all_leaves_and_cut_large_ones():
    counts = np.array([5, 5, 900, 0, 3, 40, 40, 40])
    first, parts = ann.shards(counts, 10)
    most = -(-counts.sum() // 10)
    assert parts[2] == -(-900 // most) and (np.diff(first) >= 0).all()
    load = {}
    for leaf, n in enumerate(counts):
        for s in range(first[leaf], first[leaf] + parts[leaf]):
            load[s] = load.get(s, 0) + n / parts[leaf]
    assert max(load.values()) <= most


def test_each_length_is_a_space(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(400)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(302)] + [(2000, [1.0]), (2001, [])]
    got = {}
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = total = 0
    for part in (rows[:400], rows[400:702]):
        part = [(i, np.float32(v).tolist()) for i, v in part]
        want = exact(part, [i for i, _ in part if i % 100 == 0])
        for q, near in want.items():
            assert len(got[q]) == 10
            hits, total = hits + len(set(got[q]) & {i for i, _ in near}), total + 10
    assert hits / total >= 0.9 and set(got) == {0, 100, 200, 300, 1000, 1100, 1200, 1300}
    with pytest.raises(ValueError):
        ann.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))

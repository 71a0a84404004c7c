"""Near-duplicate vectors against all pairs, and the defined cases."""

import numpy as np
import pytest

from bookheat.llm.common import table
from bookheat.llm.components import components
from bookheat.llm.vector_dups import near_duplicates
from bookheat.llm.vector_queries import op7_vector_near_dups

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in ok]
    x = np.stack([v / np.linalg.norm(v) for _, v in ok])
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    comp = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for p, q in zip(*np.nonzero(close)):
            low = min(comp[ids[p]], comp[ids[q]])
            if comp[ids[p]] != low or comp[ids[q]] != low:
                comp[ids[p]] = comp[ids[q]] = low
                moved = True
    return {i: (int(close[k].sum()), comp[i]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/sf{sf}"
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op7_vector_near_dups(spark, d).collect()}
    rows = [(r.vec_id, r.embedding) for r in table(spark, d, "embeddings").collect()]
    want = brute(rows)
    assert len(got) == len(rows)
    assert {i: g[:2] for i, g in got.items()} == want
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def test_cases(spark):
    rng = np.random.default_rng(3)
    near = [(100 + i, (np.ones(8) + rng.normal(0, 0.05, 8)).tolist()) for i in range(40)]
    copies = [(200 + i, [1.0, -1.0] * 4) for i in range(30)]
    odd = [(1, None), (2, []), (3, [0.0] * 8), (4, [1.0, None] * 4), (5, [float("nan")] + [1.0] * 7), (6, [float("inf")] + [1.0] * 7), (7, [1.0, 2.0]), (None, [1.0] * 8)]
    rows = near + copies + odd + copies[:1]
    got = near_duplicates(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    want = brute(near)
    assert all((by[i].n_links, by[i].component_id) == want[i] for i, _ in near)
    assert all(by[i].n_links == 30 and by[i].component_id == 200 for i, _ in copies)
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (1, 2, 3, 4, 5, 6, 7))
    assert by[None].component_id is None and not by[None].kept
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i + 1, i) for i in range(1, 60)]
    star = [(1000 + i, 1000) for i in range(1, 50)]
    edges = spark.createDataFrame(path + star + [(5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 61)} | {1000 + i: 1000 for i in range(50)}


def test_each_length_is_a_space(spark):
    rng = np.random.default_rng(8)
    some = lambda first, n, d: [(first + i, np.float32(np.ones(d) + rng.normal(0, 0.12, d)).tolist()) for i in range(n)]
    long, short = some(1, 60, 8), some(500, 40, 3) + [(600, [2.0, 0.0, 0.0]), (601, [2.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame([*long, *short, (700, [1.0])], "vec_id long, embedding array<float>")).collect()}
    assert got == brute(long) | brute(short) | {700: (0, 700)}
    assert got[601] == (1, 600)

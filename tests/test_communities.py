"""Communities by joins against the small dense search, and calm windows against a plain history."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookheat.operators import graph as G
from bookheat.operators import heat as H
from bookheat.operators import panel as P
from bookheat.operators import signals as S
from bookheat.operators.communities import communities_by_rounds, held_edges

EDGE = "book_id string, src string, dst string, weight double"


def modularity_of(edges, label):
    """By the definition, for one graph."""
    total = sum(w for *_, w in edges)
    degree, inside = {}, {}
    for a, b, w in edges:
        for v in (a, b):
            degree[label[v]] = degree.get(label[v], 0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + w
    return sum(inside.get(c, 0) / total - (d / (2 * total)) ** 2 for c, d in degree.items())


def planted(seed, groups, size, p_in, p_out):
    rng = random.Random(seed)
    names = [f"n{g:02d}{k:02d}" for g in range(groups) for k in range(size)]
    return names, [(a, b, rng.uniform(0.5, 1)) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < (p_in if a[:3] == b[:3] else p_out)]


def found(spark, graphs):
    nodes = spark.createDataFrame([(k, s) for k, (names, _) in graphs.items() for s in names], "book_id string, symbol string")
    edges = spark.createDataFrame([(k, *e) for k, (_, es) in graphs.items() for e in es], EDGE)
    out = {}
    for r in communities_by_rounds(nodes, edges).collect():
        out.setdefault(r.book_id, {})[r.symbol] = r.cluster_id
    return out, nodes, edges


def test_rounds_find_what_the_dense_search_finds(spark):
    graphs = {"clear": planted(1, 4, 8, 0.9, 0.02), "loose": planted(2, 3, 10, 0.5, 0.15), "random": planted(3, 1, 25, 0.3, 0.3)}
    graphs["star"] = (["hub", *"abcdef", "alone"], [("hub", s, 1.0) for s in "abcdef"])
    graphs["none"] = (["x", "y"], [])
    got, nodes, edges = found(spark, graphs)
    dense = {}
    for r in G.communities(nodes, edges).collect():
        dense.setdefault(r.book_id, {})[r.symbol] = r.cluster_id
    for k, (names, es) in graphs.items():
        assert set(got[k]) == set(names)
        ids = sorted(set(got[k].values()))
        assert ids == list(range(len(ids)))
        if es:
            # not below the dense search, up to a hair on graphs without communities
            assert modularity_of(es, got[k]) >= modularity_of(es, dense[k]) - (0.02 if k == "random" else 1e-9)
    clear = got["clear"]
    assert len({(a[:3], c) for a, c in clear.items()}) == 4
    assert got["none"] == {"x": 0, "y": 1} and got["star"]["alone"] not in {got["star"][s] for s in "abcdef"}
    again, *_ = found(spark, {"clear": graphs["clear"]})
    assert again["clear"] == clear


def test_no_single_move_would_raise_modularity(spark):
    names, es = planted(7, 3, 7, 0.6, 0.2)
    got, *_ = found(spark, {"g": (names, es)})
    # communities of the last level are stable: no two of them gain by merging
    label, best = got["g"], modularity_of(es, got["g"])
    for a in set(label.values()):
        for b in set(label.values()):
            if a < b:
                assert modularity_of(es, {s: (a if c == b else c) for s, c in label.items()}) <= best + 1e-12


def test_held_edges(spark):
    books = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "C"), (3, "D")], "book_id int, symbol string")
    edges = spark.createDataFrame([("A", "B", -0.5), ("A", "C", 0.3), ("B", "C", 0.9)], "a string, b string, z double")
    assert sorted(map(tuple, held_edges(books, edges).collect())) == [(1, "A", "B", 0.5), (2, "A", "C", 0.3)]


def inputs(spark, days):
    rng = np.random.default_rng(4)
    names = ["S0", "S1", "S2", "F0"]
    rows = [(t, dt.date(2021, 1, 1) + dt.timedelta(days=t), n, float(v), float(v)) for t in range(days) for n, v in zip(names, rng.normal(0, 0.01, 4))]
    returns = spark.createDataFrame(rows, "t int, date date, symbol string, ret double, simple double")
    books = spark.createDataFrame([("p", "S0", 0.5), ("p", "S1", 0.5), ("q", "S2", 0.4), ("q", "S1", 0.6)], "book_id string, symbol string, weight double")
    return returns, books, spark.createDataFrame([("F0", "market")], "symbol string, factor string")


@pytest.mark.parametrize("days, span", [(230, (40, 75)), (140, (10, 60))])
def test_calm_windows(spark, days, span):
    returns, books, factors = inputs(spark, days)
    day = lambda k: dt.date(2021, 1, 1) + dt.timedelta(days=k)
    crises = spark.createDataFrame([("c", day(span[0]), day(span[1] - 1))], "crisis string, start date, end date")
    calm = S.calm_returns(returns, crises)
    kept = [k for k in range(days) if not span[0] <= k < span[1]]
    assert sorted({(r.t, r.date) for r in calm.select("t", "date").collect()}) == [(n, day(k)) for n, k in enumerate(kept)]
    scored = H.own_history(books, calm, factors, window=20)
    got = {r.book_id: (r.windows, r.false_positive_rate) for r in S.false_positive_windows(scored, len(kept), books, warm=0.5).collect()}
    if len(kept) < 120:
        assert got == {"p": (0, 0.0), "q": (0, 0.0)}
        return
    # the same days as a panel of their own, scored one joined window per day
    twin = H.blend(H.components(books, P.windows(calm, "simple", 20, include_current=False), factors))
    want = {r.book_id: (r.n, r.share) for r in twin.groupBy("book_id").agg(F.count("*").alias("n"), F.avg((F.col("score") >= 0.5).cast("double")).alias("share")).collect()}
    assert set(got) == set(want) == {"p", "q"}
    assert all(got[b][0] == want[b][0] == len(kept) - 20 and abs(got[b][1] - want[b][1]) < 1e-12 for b in got)

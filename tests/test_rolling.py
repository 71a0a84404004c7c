"""Prefix-sum regressions, permutations without sorting, risk parity from the spanning tree: against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.functions import linalg as L
from bookheat.operators import causal as CA
from bookheat.operators import factors as X
from bookheat.operators import graph as G
from bookheat.operators import panel as P


def panel(spark, days, symbols, factors, seed=3, missing=()):
    rng = np.random.default_rng(seed)
    lead = rng.normal(0, 0.02, (days, factors))
    own = lead @ rng.normal(0, 1, (factors, symbols)) + rng.normal(0, 0.01, (days, symbols)) + 5.0
    names = [f"F{k}" for k in range(factors)] + [f"S{k}" for k in range(symbols)]
    rows = [(t, n, float(v)) for t in range(days) for n, v in zip(names, [*lead[t], *own[t]]) if (t, n) not in missing]
    returns = spark.createDataFrame(rows, "t int, symbol string, v double").withColumn("date", F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("t")))
    return returns, spark.createDataFrame([(f"F{k}", f"f{k}") for k in range(factors)], "symbol string, factor string")


def table_of(df):
    return {(r.t, r.symbol, r.factor): (r.beta, r.t_stat, r.r_squared) for r in df.collect()}


@pytest.mark.parametrize("block, shard", [(256, 2048), (25, 2048), (40, 3)])
def test_rolling_regressions_equal_one_fit_per_window(spark, monkeypatch, block, shard):
    monkeypatch.setattr(X, "SHARD_SYMBOLS", shard)
    returns, factors = panel(spark, 130, 7, 3)
    want = table_of(X.factor_exposures(P.windows(returns, "v", 25, include_current=False), factors))
    got = table_of(X.rolling_exposures(returns, factors, "v", 25, block))
    assert got.keys() == want.keys() and len(want) == 105 * 7 * 3
    worst = max(abs(a - b) / max(1, abs(b)) for k in want for a, b in zip(got[k], want[k]))
    assert worst < 1e-7


def test_rolling_regressions_with_gaps(spark):
    gaps = {(40, "S1"), (60, "F0"), (3, "S0")}
    returns, factors = panel(spark, 90, 3, 2, missing=gaps)
    got = table_of(X.rolling_exposures(returns, factors, "v", 20, 32))
    days = {s: {t for t, n, _ in got if n == s} for s in ("S0", "S1", "S2")}
    held = lambda t, s: not any((u, n) in gaps for n in (s, "F0", "F1") for u in range(t - 20, t)) and (t, s) not in gaps
    assert days == {s: {t for t in range(20, 90) if held(t, s)} for s in days}
    assert X.rolling_exposures(returns.limit(0), factors, "v", 20).collect() == []


def test_a_row_is_copied_few_times(spark):
    """Rows that reach the tasks, against a window's copy per day."""
    returns, factors = panel(spark, 600, 4, 2)
    plan = X.rolling_exposures(returns, factors, "v", 60)._jdf.queryExecution().optimizedPlan()
    assert "collect_list" not in plan.toString()
    block = 256
    copies = returns.withColumn("k", F.when(F.col("t") % block >= block - 60, 2).otherwise(1)).agg(F.sum("k")).first()[0]
    assert copies < 1.25 * returns.count()


def test_large_levels_do_not_cost_digits():
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 1e-3, (2, 300)), rng.normal(0, 1e-3, (3, 300)) + 1000
    beta, t, r2 = X.rolling_fits(x + 50, y, 40)
    for k in (0, 100, 260):
        for j in range(3):
            b, s, q = L.ols(y[j, k : k + 40] - 1000, x[:, k : k + 40])
            assert np.allclose(beta[k, :, j], b, rtol=1e-6) and np.allclose(t[k, :, j], s, rtol=1e-5) and np.isclose(r2[k, j], q, atol=1e-7)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 97, 2500])
def test_rows_are_permuted(n):
    row, size = np.arange(n), np.full(n, n)
    orders = [CA.shuffled_rows(row, size, np.full(n, k, np.uint64)) for k in range(40)]
    assert all((np.sort(o) == row).all() for o in orders)
    if n > 50:
        # every place about equally likely, neighbours not kept together
        first = np.array([o[0] for o in (CA.shuffled_rows(row[:1], size[:1], np.full(1, k, np.uint64)) for k in range(4000))])
        assert abs(first.mean() / (n - 1) - 0.5) < 0.02
        assert np.mean([np.mean(np.diff(o) == 1) for o in orders]) < 5 / n + 0.01


def causal_table(spark, n, seed=5, books=("b",)):
    rng = np.random.default_rng(seed)
    rows = []
    for book in books:
        x = rng.normal(0, 1, (n, len(CA.VARIABLES)))
        for t in range(n):
            rows.append((book, t, *map(float, x[t])))
    return spark.createDataFrame(rows, "book_id string, t int, " + ", ".join(f"{v} double" for v in CA.VARIABLES))


def test_permutation_p_is_that_of_the_shuffled_correlation(spark):
    from pyspark.sql import Window

    table = causal_table(spark, 90, books=("a", "b"))
    numbered = table.withColumn("row", F.row_number().over(Window.partitionBy("book_id").orderBy("t")) - 1).withColumn("rows", F.lit(90))
    edges = C.CAUSAL_EDGES
    point = spark.createDataFrame([(b, s, t, 0.02 * k) for b in "ab" for k, (s, t) in enumerate(edges)], "book_id string, source string, target string, effect double")
    got = {(r.book_id, r.source, r.target): r.p_value for r in CA.permutation_p(numbered, point, edges, replicates=50).collect()}
    places = CA.permuted(numbered, 50, 42).toPandas()
    values = table.toPandas()
    for b in "ab":
        own = values[values.book_id == b].sort_values("t")
        for k, (s, t) in enumerate(edges):
            hits = 0
            for rep in range(1, 51):
                place = places[(places.book_id == b) & (places.rep == rep)].sort_values("row").place.values
                assert (np.sort(place) == np.arange(90)).all()
                moved = np.empty(90)
                moved[place] = own[s].values
                hits += abs(np.corrcoef(moved, own[t].values)[0, 1]) >= abs(0.02 * k)
            assert np.isclose(got[b, s, t], max(hits / 50, 1 / 51))
    again = {(r.book_id, r.source, r.target): r.p_value for r in CA.permutation_p(numbered.repartition(7), point, edges, replicates=50).collect()}
    assert got == again


def slow_order(d):
    """Single linkage by searching all pairs of clusters."""
    clusters = {i: [i] for i in range(len(d))}
    while len(clusters) > 1:
        i, j = min(((a, b) for a in clusters for b in clusters if a < b), key=lambda p: min(d[x, y] for x in clusters[p[0]] for y in clusters[p[1]]))
        clusters[i] = clusters[i] + clusters.pop(j)
    return clusters[0]


def test_leaf_order_from_the_tree():
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 9, 14):
        for _ in range(5):
            x = rng.normal(size=(n, 3))
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
            assert G._single_linkage_order(d) == slow_order(d)


def test_risk_parity_with_given_covariances(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 80))
    windowed = spark.createDataFrame([(1, s, x[k].tolist()) for k, s in enumerate("ABCD")], "t int, symbol string, x array<double>")
    rows = [("one", "A", 1.0), ("two", "A", 0.5), ("two", "B", 0.5), ("own", "A", 0.4), ("own", "B", 0.3), ("own", "C", 0.3), ("flat", "A", 0.5), ("flat", "D", 0.5)]
    books = spark.createDataFrame(rows, "book_id string, symbol string, weight double")
    cov = np.array([[4.0, 1.0, 0.0], [1.0, 2.0, 0.5], [0.0, 0.5, 1.0]])
    given = [("own", a, b, float(cov[i, j])) for i, a in enumerate("ABC") for j, b in enumerate("ABC") if i <= j] + [("flat", "A", "A", 0.0), ("flat", "D", "D", 0.0)]
    got = {(r.book_id, r.symbol): r.weight for r in G.hrp_weights(books, windowed, spark.createDataFrame(given, "book_id string, a string, b string, cov double")).collect()}
    assert got["one", "A"] == 1.0 and got["flat", "A"] == got["flat", "D"] == 0.5
    assert np.allclose([got["own", s] for s in "ABC"], G.risk_parity(cov))
    assert np.allclose([got["two", s] for s in "AB"], G.risk_parity(np.cov(x[:2])))
    assert len(got) == len(rows)
    plain = G.hrp_weights(books, windowed).groupBy("book_id").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 1) < 1e-12 for r in plain) and len(plain) == 4

"""Books as packed rows: vectors go with the function, what the symbols alone decide is computed once for equal sets."""

import datetime as dt

import numpy as np
import pytest

from bookheat import constants as C
from bookheat.operators import actions as ACT
from bookheat.operators import graph as G
from bookheat.operators import heat as H
from bookheat.operators import metrics as M

DAYS, WINDOW = 70, 60


@pytest.fixture(scope="module")
def returns(spark):
    x = np.random.default_rng(3).normal(0, 0.02, (6, DAYS))
    day = dt.date(2020, 1, 1)
    rows = [(t, day + dt.timedelta(days=t), f"S{i}", float(x[i, t])) for i in range(6) for t in range(DAYS)]
    return spark.createDataFrame(rows, "t int, date date, symbol string, simple double").persist()


@pytest.fixture(scope="module")
def books(spark):
    rng = np.random.default_rng(4)
    # twelve books hold the same four symbols, one of them unknown besides; the others differ
    rows = [(k, f"S{i}", float(v)) for k in range(12) for i, v in enumerate(rng.dirichlet(np.ones(4)))]
    rows += [(3, "unknown", 0.1), (20, "S5", 1.0), (21, "S4", 0.5), (21, "S5", 0.5), (22, "unknown", 1.0)]
    return spark.createDataFrame(rows, "book_id int, symbol string, weight double").persist()


@pytest.fixture(scope="module")
def factors(spark):
    return spark.createDataFrame([("S0", C.FACTORS[0]), ("S5", C.FACTORS[1])], "symbol string, factor string")


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    for k, row in got.items():
        for c, v in row.items():
            assert v == (pytest.approx(want[k][c], abs=1e-9) if isinstance(v, (float, list)) else want[k][c]), (k, c)


def test_asked_days_are_rows_of_the_whole_history(books, returns, factors, spark):
    whole = rows(H.own_history(books, returns, factors), "book_id", "t")
    first = dt.date(2020, 1, 1)
    asked = [(0, first), (1, first + dt.timedelta(days=62)), (20, first + dt.timedelta(days=400)), (21, first + dt.timedelta(days=60)), (99, first)]
    got = rows(H.own_history(books, returns, factors, asked=spark.createDataFrame(asked, "book_id int, date date")), "book_id", "t")
    want = {(k, DAYS - 1) for k in [*range(12), 20, 21]} | {(1, 62), (21, 60)}
    same(got, {k: whole[k] for k in want})


def test_lists_hold_every_value(books, returns, factors):
    whole = ACT.component_history(H.own_history(books, returns, factors))
    order = lambda df: {k: {c: sorted(v) if isinstance(v, list) else v for c, v in r.items()} for k, r in rows(df, "book_id").items()}
    same(order(H.own_component_lists(books, returns, factors)), order(whole))


def test_large_universes_are_joined(books, returns, factors, spark, monkeypatch):
    asked = spark.createDataFrame([(1, dt.date(2020, 3, 3))], "book_id int, date date")
    run = lambda: [
        rows(H.own_history(books, returns, factors), "book_id", "t"),
        rows(H.own_history(books, returns, factors, asked=asked), "book_id", "t"),
        rows(G.hrp_weights(books, returns.groupBy("symbol").agg(H.F.collect_list("simple").alias("x"))), "book_id", "symbol"),
    ]
    shipped = run()
    monkeypatch.setattr(M, "MAX_SHIPPED_NUMBERS", 0)
    for got, want in zip(shipped, run()):
        same(got, want)


def test_only_symbols_and_weights_are_shuffled(books, returns):
    vectors = returns.groupBy("symbol").agg(H.F.collect_list("simple").alias("x"))
    made = M.map_books(books, vectors, ["x"], lambda rec: [(float(rec["weight"] @ rec["x"].sum(axis=1)),)], "total double")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "simple" not in plan
    assert made.count() == 14


def test_sets_take_their_days_from_the_moments_of_all_symbols(monkeypatch):
    rng = np.random.default_rng(5)
    x, fac, names = rng.normal(0, 0.02, (7, 90)), rng.normal(0, 0.02, (2, 90)), ["f", "g"]
    x[6] = 0.01  # a symbol that never moves
    sets = [np.array(s) for s in ([0], [1, 4], [0, 2, 3, 6], [1, 2, 3, 4, 5], range(7))]
    plain, slopes = np.array([True, True, False, True, True, True, True]), H._slopes(fac, WINDOW)
    ask = lambda own, **kw: H._set_history(x[own], plain[own], WINDOW, 20, names, slopes, [f"S{i}" for i in own], **kw)
    w = [rng.dirichlet(np.ones(len(at)), 3) for at in sets]
    want = [ask(at)(v) for at, v in zip(sets, w)]
    moments = H._day_moments(x, WINDOW)
    monkeypatch.setattr(M, "moments_by_day", None)
    for at, v, one in zip(sets, w, want):
        got = ask(at, moments=moments, at=at)(v)
        assert set(got) == set(one)
        for c, values in one.items():
            assert (got[c] == values).all() if values.dtype == object else np.allclose(got[c], values, rtol=0, atol=1e-9), c
    assert H._day_moments(rng.normal(0, 0.02, (300, 90)), WINDOW) is None


def test_what_if_ranks_in_the_history_of_the_book(spark, monkeypatch):
    x = np.random.default_rng(6).normal(0, 0.02, (5, WINDOW))
    windowed = spark.createDataFrame([(0, f"S{i}", x[i].tolist()) for i in range(5)], "t int, symbol string, x array<double>")
    vectors = spark.createDataFrame([(0, f"S{i}", [0.1 * i, 1.0]) for i in range(5)], "t int, symbol string, betas array<double>")
    held = [(b, s, 0.5) for b in (1, 2, 3) for s in ("S0", "S1")] + [(1, "unknown", 0.1)]
    own = spark.createDataFrame(held, "book_id int, symbol string, weight double")
    asked = spark.createDataFrame([(b, s, 0.05) for b in (1, 2, 3) for s in ("S1", "S3", "unknown")], own.schema)
    lists = ", ".join(f"{c} array<double>" for c in ("h_ar", "h_turb", "h_dr", "h_hhi", "h_corr"))
    history = spark.createDataFrame([(1, *[[-9.0] * 3] * 5), (2, *[[1e9] * 3] * 5)], f"book_id int, {lists}")
    clusters = spark.createDataFrame([("S0", 0), ("S1", 0)], "symbol string, cluster_id int")
    made = [rows(ACT.pretrade_impact(own, asked, vectors, windowed, history, clusters), "book_id", "candidate")]
    monkeypatch.setattr(M, "MAX_SHIPPED_NUMBERS", 0)
    made.append(rows(ACT.pretrade_impact(own, asked, vectors, windowed, history, clusters), "book_id", "candidate"))
    same(made[0], made[1])
    assert {k: (r["heat_before"], r["heat_after"]) for k, r in made[0].items()} == {
        (b, s): (pytest.approx(v), pytest.approx(v)) for b, v in ((1, 1.0), (2, 0.25), (3, 1.0)) for s in ("S1", "S3")
    }


def test_betas_of_candidates_are_not_shuffled_one_by_one(spark):
    asked = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.1), (2, "b", 0.5), (2, "none", 0.5)], "book_id int, symbol string, weight double")
    betas = [("a", "f", -2.0, 1.0), ("a", "g", 2.0, 3.0), ("b", "f", 1.0, 1.0)]
    made = ACT.factor_impact(asked, spark.createDataFrame(betas, "symbol string, factor string, beta double, t_stat double"))
    got = rows(made, "book_id", "symbol")
    assert set(got) == {(1, "a"), (2, "b")} and got[1, "a"]["dominant_factor"] == "g"
    assert [tuple(e) for e in got[1, "a"]["factor_betas"]] == [("f", -2.0, 1.0, -1.0), ("f", -2.0, 1.0, -0.2), ("g", 2.0, 3.0, 0.2), ("g", 2.0, 3.0, 1.0)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [book_id" in line and "factor" in line]


def test_many_books_are_ranked_at_once_like_one_by_one():
    rng = np.random.default_rng(7)
    v = rng.integers(0, 40, (140, 600)).astype(float)
    v[3, 50] = v[139, 0] = np.nan
    want = np.array([H.L.pct_rank_incl(one, 504) for one in v])
    assert (H.L.pct_ranks_incl(v, 504) == want).all() and (H.L.pct_ranks_incl(v[:2], 30)[1] == H.L.pct_rank_incl(v[1], 30)).all()
    row, day = np.array([3, 3, 139, 139, 7]), np.array([50, 599, 0, 520, 503])
    assert (H.L.pct_ranks_at(v, row, day, 504) == want[row, day]).all()


def test_window_variances_keep_their_digits():
    v = np.random.default_rng(8).normal(0, 0.02, (4, 200))
    v[1] += 1e3  # squares alone would lose the variance
    v[2] = 0.5
    v[3, 70] = np.nan
    for window in (2, 20, 60):
        want = np.var(np.lib.stride_tricks.sliding_window_view(v, window, axis=1), axis=2, ddof=1)
        np.testing.assert_allclose(M.window_variances(v, window), want, rtol=1e-9, atol=1e-20)


def test_days_without_names_are_the_same_days(books, returns, factors):
    whole = rows(H.own_history(books, returns, factors), "book_id", "t")
    bare = rows(H.own_history(books, returns, factors, named=False), "book_id", "t")
    same(bare, {k: {c: v for c, v in r.items() if c not in ("dominant_factor", "top_pair", "top_corr")} for k, r in whole.items()})


def test_books_with_the_same_symbols_are_solved_once(books, returns, spark, monkeypatch):
    vectors = returns.groupBy("symbol").agg(H.F.collect_list("simple").alias("x"))
    want = rows(G.hrp_weights(books, vectors), "book_id", "symbol")
    calls, solve = spark.sparkContext.accumulator(0), G.parity_or_equal

    def counted(cov):
        calls.add(1)
        return solve(cov)

    monkeypatch.setattr(G, "parity_or_equal", counted)
    same(rows(G.hrp_weights(books, vectors), "book_id", "symbol"), want)
    # four symbols, the same with an unknown one, and two more sets
    assert calls.value == 4 and {k for k, _ in want} == {*range(12), 20, 21}

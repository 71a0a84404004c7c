import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookheat.operators import books as B
from bookheat.operators import heat as H
from bookheat.operators import metrics as M
from bookheat.operators import moments as MM
from bookheat.operators import panel as P


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def panel(spark, x):
    """Returns (t, date, symbol, ret, simple) from a matrix (symbols, days)."""
    rows = [
        (t, day(t), f"S{i:03d}", float(x[i, t]), float(x[i, t])) for i in range(x.shape[0]) for t in range(x.shape[1])
    ]
    return spark.createDataFrame(rows, "t int, date date, symbol string, ret double, simple double")


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(3)
    base = rng.normal(size=80)
    return rng.normal(size=(23, 80)) * 0.01 + 0.006 * base


def test_null_price_voids_two_days(spark):
    rows = [(day(i), s, p) for s, ps in {"A": [1.0, 2.0, 4.0, 8.0, 16.0], "B": [1.0, 1.0, None, 1.0, 1.0]}.items() for i, p in enumerate(ps)]
    out = P.log_returns(spark.createDataFrame(rows, "date date, symbol string, close double")).collect()
    assert sorted({r.date for r in out}) == [day(1), day(4)]
    filled = P.log_returns(spark.createDataFrame(rows, "date date, symbol string, close double"), fill="ffill").collect()
    assert len({r.date for r in filled}) == 4


def test_pairs_over_many_blocks_equal_one_matrix(spark, x):
    v = MM.ewma_vectors(MM.series(panel(spark, x), "ret"))
    want = pytest.importorskip("bookheat.functions.linalg").ewma_correlation(x, 60)
    got = {(r.a, r.b): r.z for r in MM.pair_values(v, [], ["z"], block=5).collect()}
    assert len(got) == 23 * 22 // 2
    for i in range(23):
        for j in range(i + 1, 23):
            assert got[(f"S{i:03d}", f"S{j:03d}")] == pytest.approx(want[i, j], abs=1e-10)
    top = MM.pair_values(v, [], ["z"], keep="top", block=5).collect()
    off = np.abs(want - np.eye(23))
    assert len(top) == 1 and abs(top[0].z) == pytest.approx(off.max())
    mean = MM.avg_pairwise(v.withColumn("k", F.lit(1)), ["k"]).collect()[0].avg_corr
    assert mean == pytest.approx((want.sum() - 23) / (23 * 22))


def test_window_metrics_match_the_expression_forms(spark, x):
    w = P.windows(panel(spark, x), "simple", 60, include_current=False)
    books = spark.createDataFrame([(1, f"S{i:03d}", 0.1) for i in range(10)] + [(2, "S000", 1.0)], "book_id long, symbol string, weight double")
    one = {(r.book_id, r.t): r for r in M.window_metrics(M.members(books, w)).collect()}
    dr = {(r.book_id, r.t): r.div_ratio for r in M.diversification_ratio(books, w).collect()}
    ac = {(r.book_id, r.t): r.avg_corr for r in M.average_correlation(books, w).collect()}
    assert len(one) == 40 and set(one) == set(dr) == set(ac)
    for k, r in one.items():
        assert r.div_ratio == pytest.approx(dr[k]) and r.avg_corr == pytest.approx(ac[k])
        assert 0 <= r.absorption_ratio <= 1 and r.turbulence >= 0
    assert one[(2, 60)].absorption_ratio == 0.5 and one[(2, 60)].div_ratio == 1.0


def test_absorption_and_turbulence_by_definition(spark, x):
    from bookheat.functions import linalg as L

    cov = np.cov(x)
    eig = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert L.absorption_ratio(x) == pytest.approx(min(eig[:4].sum() / np.var(x, axis=1).sum(), 1))
    h = x[:, :-1]
    d = x[:, -1] - h.mean(axis=1)
    assert L.turbulence(x) == pytest.approx(d @ np.linalg.inv(np.cov(h) + 1e-8 * np.eye(23)) @ d)


def test_first_score_ranks_at_one(spark):
    rows = [(1, day(i), i, 0.3 - i * 0.01, 1.0, 1.5, 0.2, 0.1) for i in range(3)]
    parts = spark.createDataFrame(
        rows, "book_id int, date date, t int, absorption_ratio double, turbulence double, div_ratio double, factor_hhi double, avg_corr double"
    )
    got = H.blend(parts).orderBy("date").collect()
    assert got[0].score == pytest.approx(1.0) and got[0].level == "emergency"
    assert got[1].ar_pct == pytest.approx(0.5)
    more = H.blend(parts.filter("t = 2"), parts.filter("t < 2")).collect()
    assert more[0].score == pytest.approx(got[2].score)


def test_book_rules(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.5), (2, "A", 0.5), (2, "a ", 0.5), (3, "a", 1.2), (3, "b", -0.2), (4, "a", 0.5), (5, " ", 1.0)]
    got = {r.book_id: r.reason for r in B.validate_books(spark.createDataFrame(rows, "book_id int, symbol string, weight double")).collect()}
    assert got == {
        1: None, 2: "duplicate symbols", 3: "a position has non-positive weight", 4: "weights do not sum to one",
        5: "a position has an empty symbol",
    }
    cur = spark.createDataFrame([(1, "z", 1.0), (3, "z", 1.0), (9, "z", 1.0)], "book_id int, symbol string, weight double")
    cand = spark.createDataFrame(rows, "book_id int, symbol string, weight double")
    out = {(r.book_id, r.symbol) for r in B.apply_book_updates(cur, cand).collect()}
    assert out == {(1, "a"), (1, "b"), (3, "z"), (9, "z")}


def test_what_if_equals_scoring_the_grown_book(x):
    from bookheat.functions import linalg as L
    from bookheat.operators.actions import what_if

    rng = np.random.default_rng(1)
    x = x[:, :60]
    betas = rng.normal(size=(23, 9))
    names = [f"S{i:03d}" for i in range(23)] + ["S002"]
    xs, bs = np.vstack([x, x[2]]), np.vstack([betas, betas[2]])
    held = np.r_[np.full(12, 0.08), np.full(12, np.nan)]
    wanted = np.r_[np.full(12, np.nan), np.full(12, 0.05)]

    def five(rows, w):
        c = L.ewma_correlation(x[rows], 60)
        n = len(rows)
        e = np.abs(w @ betas[rows])
        return [
            L.absorption_ratio(x[rows]), L.turbulence(x[rows]), 1 / L.diversification_ratio(x[rows], w),
            ((e / e.sum()) ** 2).sum(), (c.sum() - n) / (n * (n - 1)),
        ]

    got = what_if(names, xs, bs, held, wanted, 60)
    assert len(got) == 12
    for name, _, before, after, near, corr in got:
        assert before == pytest.approx(five(list(range(12)), np.full(12, 0.08)))
        k = int(name[1:])
        rows = [i for i in range(12) if i != k] + [k]
        assert after == pytest.approx(five(rows, np.r_[np.full(len(rows) - 1, 0.08), 0.05]))
        others = [i for i in range(12) if i != k]
        cs = {f"S{i:03d}": np.corrcoef(x[i], x[k])[0, 1] for i in others}
        assert near == max(cs, key=lambda s: abs(cs[s])) and corr == pytest.approx(cs[near])


def test_customer_books_are_ranked_in_their_own_history(spark):
    from bookheat import constants as C
    from bookheat.plans import heat_queries as HQ

    got = HQ.book_heat(spark, "/root/testdata/sf0.01").toPandas().sort_values(["book_id", "date"])
    got["inv_dr"] = 1 / got["div_ratio"].clip(lower=0.01)
    parts = {"ar": "absorption_ratio", "turb": "turbulence", "dr": "inv_dr", "hhi": "factor_hhi", "corr": "avg_corr"}
    assert got["book_id"].nunique() > 50
    for _, own in got.groupby("book_id"):
        for k in range(len(own)):
            rank = {n: (own[c].values[: k + 1] <= own[c].values[k]).mean() for n, c in parts.items()}
            want = sum(C.HEAT_WEIGHTS[n] * rank[n] for n in parts)
            assert abs(own["score"].values[k] - min(max(want, 0), 1)) < 1e-9


def test_every_day_of_a_book_is_scored_and_equals_the_rolling_replay(spark, x):
    from bookheat import constants as C

    returns = panel(spark, x)
    rng = np.random.default_rng(4)
    rows = [(k, f"S{i:03d}", float(v)) for k, n in enumerate((1, 2, 3, 23)) for i, v in zip(rng.permutation(23)[:n], rng.dirichlet(np.ones(n)))]
    rows += [(9, "S000", 0.4), (9, "S001", 0.6)]
    books = spark.createDataFrame(rows, "book_id int, symbol string, weight double")
    factors = spark.createDataFrame([("S000", C.FACTORS[0]), ("S001", C.FACTORS[1])], "symbol string, factor string")
    want = {(r.book_id, r.t): r for r in H.rolling_heat(books, returns, factors).collect()}
    got = {(r.book_id, r.t): r for r in H.own_history(books, returns, factors).collect()}
    assert set(got) == set(want) == {(k, t) for k in (0, 1, 2, 3, 9) for t in range(60, 80)}
    for k, r in got.items():
        own = want[k].asDict()
        assert set(own) == set(r.asDict())
        for c, v in r.asDict().items():
            assert v == (pytest.approx(own[c], abs=1e-8) if isinstance(v, float) else own[c]), (k, c)


def test_ranks_reach_back_504_rows():
    from bookheat.functions import linalg as L

    v = np.random.default_rng(5).integers(0, 50, 5000).astype(float)
    got = L.pct_rank_incl(v, 504)
    for k in (0, 1, 502, 503, 504, 600, 4095, 4096, 4999):
        own = v[max(0, k - 503) : k + 1]
        assert got[k] == (own <= v[k]).mean()


def test_customer_books_are_scored_on_every_row_day(spark):
    from bookheat.plans import heat_queries as HQ
    from bookheat.sources import tables as T

    sf = "/root/testdata/sf0.01"
    days = T.returns(spark, sf).filter("t >= 60").select("t").distinct().count()
    per = HQ.book_heat(spark, sf).groupBy("book_id").count().select("count").distinct().collect()
    assert [r[0] for r in per] == [days] and T.books(spark, sf).select("book_id").distinct().count() > 50

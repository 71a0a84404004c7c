import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.functions import fits
from bookheat.operators import causal as CA
from bookheat.operators import graph as G
from bookheat.operators import models as MO
from bookheat.operators import moments as MM
from tests.test_panels import day, panel


def test_garch_recovers_persistence():
    rng = np.random.default_rng(1)
    y, s = np.empty(3000), 1.0
    for t in range(3000):
        y[t] = math.sqrt(s) * rng.normal()
        s = 0.05 + 0.1 * y[t] ** 2 + 0.85 * s
    _, a, b, v = fits.fit_garch(y)
    assert a == pytest.approx(0.1, abs=0.04) and b == pytest.approx(0.85, abs=0.08)
    assert np.std(y / np.sqrt(v)) == pytest.approx(1, abs=0.05)


def test_garch_fallback_for_short_series(spark):
    x = np.random.default_rng(0).normal(size=(2, 40)) * 0.01
    got = MO.garch(panel(spark, x)).collect()
    assert {(r.omega, r.alpha, r.beta) for r in got} == {(0.0, 0.05, 0.94)}
    assert len(got) == 2 * 39


def test_dcc_finds_constant_correlation(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(3, 150))
    z = np.vstack([e[0], 0.8 * e[0] + 0.6 * e[1], e[2]])
    df = panel(spark, z).select("t", "symbol", F.col("ret").alias("z"))
    books = spark.createDataFrame([("b", f"S{i:03d}") for i in range(3)], "book_id string, symbol string")
    got = {(r.a, r.b): r for r in MO.dcc(books, df).collect()}
    assert got[("S000", "S001")].correlation == pytest.approx(0.8, abs=0.15)
    assert all(r.a_param > 0 and r.a_param + r.b_param < 1 for r in got.values())


def test_dcc_meets_on_common_days(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(2, 200))
    z = np.vstack([e[0], 0.8 * e[0] + 0.6 * e[1]])
    df = panel(spark, z).select("t", "symbol", F.col("ret").alias("z"))
    books = spark.createDataFrame([("b", f"S{i:03d}") for i in range(2)], "book_id string, symbol string")
    full = MO.dcc(books, df).collect()[0].correlation
    holes = df.filter("not (symbol = 'S000' and t in (0, 1, 77))")
    got = MO.dcc(books, holes).collect()[0]
    assert got.correlation == pytest.approx(full, abs=0.03)
    again = MO.dcc(books, holes.repartition(7, "t")).collect()[0]
    assert again == got
    few = MO.dcc(books, df.filter("t < 20")).collect()[0]
    assert few.a_param is None and -1 <= few.correlation <= 1


def test_ragged_series_are_refused():
    import pyarrow as pa

    from bookheat.functions import linalg as L

    with pytest.raises(ValueError):
        L._slice(pa.array([[1.0, 2.0], [3.0]]), 0, 2)


def test_hmm_orders_states_by_variance(spark):
    rng = np.random.default_rng(42)
    vol = np.repeat([0.005, 0.01, 0.03], 100)
    rows = [
        ("b", day(i), float(rng.normal() * v), float(v * (1 + 0.1 * rng.normal())), float(rng.normal() * 0.1), float(0.3 + v * 10 + 0.01 * rng.normal()), float(0.3 + v * 15 + 0.01 * rng.normal()))
        for i, v in enumerate(vol)
    ]
    names = ["rolling_return", "realized_vol", "return_skew", "avg_correlation", "heat_score"]
    df = spark.createDataFrame(rows, "book_id string, date date, " + ", ".join(f"{n} double" for n in names))
    r = MO.regimes(df).collect()[0]
    assert r.is_fitted and sum(r.probabilities.values()) == pytest.approx(1)
    assert set(r.probabilities) == set(C.REGIMES)
    few = MO.regimes(df.limit(20)).collect()[0]
    assert few.regime == "unknown" and few.confidence == 0.34


def test_change_point_between_regimes():
    rng = np.random.default_rng(42)
    y = np.concatenate([rng.normal(0, 0.01, 100), rng.normal(0.2, 0.05, 100)])
    found = fits.change_points(y)
    assert len(found) == 1 and abs(found[0] - 100) <= 5
    assert fits.change_points(y[:30]) == []


def test_student_p_values():
    for t, df, p in [(2.0, 10, 0.07338803), (1.96, 1000, 0.05027318), (0.0, 5, 1.0)]:
        assert fits.t_two_sided(t, df) == pytest.approx(p, abs=1e-6)
    for t in (0.3, 2.0, 12.0):  # closed form for three degrees of freedom
        a = math.atan(t / math.sqrt(3))
        assert fits.t_two_sided(t, 3) == pytest.approx(1 - 2 / math.pi * (a + math.sin(a) * math.cos(a)), abs=1e-12)


def test_pc_finds_a_collider():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 3000))
    c = a + b + 0.5 * rng.normal(size=3000)
    assert set(fits.pc_edges(np.corrcoef([a, b, c]), 3000, 0.01)) == {(0, 2), (1, 2)}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 150
    d = {f: rng.normal(size=n) for f in C.FACTORS}
    d["credit"] = 0.5 * d["rates"] + rng.normal(size=n)
    d["market"] = 0.3 * d["rates"] + rng.normal(size=n)
    d[C.PORTFOLIO_NODE] = 0.9 * d["market"] + 0.4 * d["ai_tech"] + 0.3 * rng.normal(size=n)
    rows = [("b", t, *[float(d[v][t]) for v in CA.VARIABLES]) for t in range(n)]
    return spark.createDataFrame(rows, "book_id string, t int, " + ", ".join(f"{v} double" for v in CA.VARIABLES)).cache()


def test_effects_intervals_and_shock(spark, table):
    got = {(r.source, r.target): r for r in CA.intervals(table, bootstraps=60, replicates=30).collect()}
    m = got[("market", C.PORTFOLIO_NODE)]
    assert m.effect == pytest.approx(0.9, abs=0.1) and m.ci_lower < m.effect < m.ci_upper and m.p_value < 0.05
    assert got[("low_vol", C.PORTFOLIO_NODE)].p_value > 0.05 or abs(got[("low_vol", C.PORTFOLIO_NODE)].effect) < 0.1
    again = {(r.source, r.target): r.ci_lower for r in CA.intervals(table.repartition(5), bootstraps=60, replicates=30).collect()}
    assert again[("rates", "credit")] == pytest.approx(got[("rates", "credit")].ci_lower)
    sig = {r.source for r in CA.significant(CA.regression_effects(table)).filter(F.col("target") == C.PORTFOLIO_NODE).collect()}
    assert {"market", "ai_tech"} <= sig
    shock = CA.intervene(
        CA.effects(table), spark.createDataFrame([("b", "rates", 1.0)], "book_id string, factor string, std double"),
        spark.createDataFrame([("b", "rates", 2.0), ("b", "odd", 1.0)], "book_id string, factor string, k double"),
    ).collect()
    r = {x.factor: x for x in shock}
    e = {k: v.effect for k, v in got.items()}
    via = sum(e[("rates", mid)] * e[(mid, C.PORTFOLIO_NODE)] for mid in ("credit", "market", "value"))
    assert r["rates"].indirect_impact == pytest.approx(2 * via, abs=1e-9)
    assert r["odd"].shock == 0.01 and r["odd"].total_impact == 0


def test_tree_over_blocks_equals_one_block(spark):
    x = np.random.default_rng(8).normal(size=(17, 60))
    v = MM.ewma_vectors(MM.series(panel(spark, x), "ret")).withColumn("book_id", F.lit("b")).select("book_id", "symbol", "z")
    one = {(r.source, r.target) for r in G.minimum_spanning_tree(v, ["book_id"]).collect()}
    many = {(r.source, r.target) for r in G.minimum_spanning_tree(v, ["book_id"], block=4).collect()}
    assert one == many and len(one) == 16


def test_communities_and_modularity(spark):
    e = [("b", a, b, 0.9) for g in ("ACD", "EFG") for a in g for b in g if a < b] + [("b", "A", "E", 0.3)]
    edges = spark.createDataFrame(e, "book_id string, src string, dst string, weight double")
    nodes = spark.createDataFrame([("b", s) for s in "ACDEFGZ"] + [("c", "Q")], "book_id string, symbol string")
    got = {(r.book_id, r.symbol): r.cluster_id for r in G.communities(nodes, edges).collect()}
    assert got[("b", "A")] == got[("b", "C")] == got[("b", "D")] != got[("b", "E")] == got[("b", "G")]
    assert len({c for (b, _), c in got.items() if b == "b"}) == 3 and ("c", "Q") in got
    q = {r.book_id: r.modularity for r in G.modularity(edges, G.communities(nodes, edges)).collect()}
    assert 0.3 < q["b"] < 0.6 and q["c"] == 0


def test_risk_parity_prefers_low_variance():
    w = G.risk_parity(np.diag([1.0, 4.0, 0.25, 1.0]))
    assert w.sum() == pytest.approx(1) and w.argmax() == 2 and (w > 0).all()


def test_migrations_keep_newest(spark):
    snaps = [(1, "AB|CD"), (2, "AC|BD"), (3, "AB|CD")]
    rows = [("b", t, s, k) for t, p in snaps for k, g in enumerate(p.split("|")) for s in g]
    df = spark.createDataFrame(rows, "book_id string, snapshot int, symbol string, cluster_id int")
    m = {r.symbol: r.compared_to for r in G.migrations(df).collect()}
    assert m == {"A": 2, "B": 2, "C": 2, "D": 2}
    assert G.migration_risk(df, G.migrations(df)).collect()[0].migration_risk == 1.0

"""Steps over many books at once: attribution by one matrix per batch, communities once per set of symbols."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookheat.operators import attribution as ATT
from bookheat.operators import graph as G

S = 7
RNG = np.random.default_rng(8)
Z, CV, B = RNG.normal(0, 1, (S, 30)), RNG.normal(0, 0.02, (S, 30)), RNG.normal(0, 1, (S, 3))
Z /= np.linalg.norm(Z, axis=1, keepdims=True)
CV[6] = B[6] = 0.0


def _one(symbols, w):
    """Contributions and heat share of one book, position by position."""
    n, w = len(symbols), np.array(w)
    at = np.array(symbols)
    z, c, b = Z[at], CV[at], B[at]
    equal = np.full(n, 1.0 / n)
    corr, risk, factor = np.ones(n), equal, equal
    if n >= 2:
        corr = np.array([w[i] * sum(abs(z[i] @ z[j]) * w[j] for j in range(n) if j != i) for i in range(n)])
        corr = corr / corr.sum() if corr.sum() > 0 else corr
        sw = c @ (w @ c) + 1e-10 * w
        if w @ sw > 0:
            risk = np.abs(w * sw) / np.abs(w * sw).sum()
    total = np.abs(w @ b)
    if total.sum() > 0:
        factor = np.abs(w[:, None] * b) @ (total / total.sum())
        factor = factor / factor.sum() if factor.sum() > 0 else factor
    raw = 0.35 * corr + 0.30 * factor + 0.35 * risk
    return corr, factor, risk, raw / raw.sum() if raw.sum() > 0 else equal


@pytest.mark.parametrize("dense", [512, 0])
def test_contributions_of_many_books(spark, monkeypatch, dense):
    monkeypatch.setattr(ATT, "MAX_DENSE_SYMBOLS", dense)
    monkeypatch.setattr(ATT.M, "CHUNK_NUMBERS", 3 * S)
    books = {k: (sorted(RNG.choice(S, RNG.integers(1, S + 1), replace=False).tolist()), None) for k in range(40)}
    books = {k: (s, RNG.dirichlet(np.ones(len(s))).tolist()) for k, (s, _) in books.items()}
    books |= {100: ([6], [1.0]), 101: ([2, 2, 4], [0.2, 0.3, 0.5]), 102: ([0, 1], [0.0, 0.0]), 103: ([3, 5], [1.5, -0.5])}
    rows = [(k, f"S{i}", float(x)) for k, (s, w) in books.items() for i, x in zip(s, w)] + [(5, "unknown", 0.4), (104, "unknown", 1.0)]
    df = spark.createDataFrame(rows, "book_id int, symbol string, weight double")
    vectors = spark.createDataFrame(
        [(f"S{i}", Z[i].tolist(), CV[i].tolist(), B[i].tolist(), f"f{i}", float(i)) for i in range(S)],
        "symbol string, z array<double>, c array<double>, betas array<double>, dominant_factor string, dominant_beta double",
    )
    heat = spark.createDataFrame([(k, None if k == 7 else k / 200) for k in [*books, 104, 999] if k != 9], "book_id int, score double")
    got = {}
    for r in ATT.contributions(df, vectors, heat).collect():
        got.setdefault(r.book_id, []).append(r)
    assert set(got) == set(books) - {9}
    for k, found in got.items():
        found = sorted(found, key=lambda r: (r.symbol, r.weight))
        s, w = zip(*sorted(zip(*books[k])))
        assert [(r.symbol, r.weight) for r in found] == [(f"S{i}", x) for i, x in zip(s, w)]
        assert all(r.score == (None if k == 7 else k / 200) and r.dominant_factor == f"f{i}" and r.dominant_beta == i for r, i in zip(found, s))
        made = zip(*[(r.corr_contribution, r.factor_contribution, r.risk_contribution, r.heat_share) for r in found])
        for a, b in zip(made, _one(s, w)):
            assert list(a) == pytest.approx(b.tolist(), abs=1e-12), k


def test_communities_are_found_once_per_set(spark):
    """A hundred books of three sets: the function that finds communities gets three of them."""
    sets = [["a", "b", "c"], ["a", "b"], ["c", "unknown"]]
    books = spark.createDataFrame([(k, s) for k in range(100) for s in sets[k % 3]], "book_id int, symbol string")
    links = spark.createDataFrame([("a", [0.0, 0.9, 0.1]), ("b", [0.9, 0.0, 0.0]), ("c", [0.1, 0.0, 0.0])], "symbol string, w array<double>")
    calls = spark.sparkContext.accumulator(0)

    def one(rec):
        calls.add(1)
        return [(rec["symbol"],)]

    made = G._once_per_set(books, links, ["w"], one, "symbol array<string>").collect()
    assert calls.value == 3 and len(made) == 100 and all(r.symbol == [s for s in sets[r.book_id % 3] if s != "unknown"] for r in made)
    got = G.book_communities(books, links).groupBy("book_id").agg(F.count("*").alias("n"), F.max("cluster_id").alias("c")).collect()
    assert {(r.book_id, r.n) for r in got} == {(k, (3, 2, 1)[k % 3]) for k in range(100)}


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_weights_shuffle_their_rows_once(spark):
    from bookheat.sources.tables import _weights

    rows = [(k, f"S{i}", s, float(k + i + 1), 2.0) for k in range(5) for i in range(3) for s in "FO"]
    h = spark.createDataFrame(rows, "book_id int, symbol string, status string, spend double, shares double")
    got = _weights(h.withColumn("updated_at", F.current_timestamp()))
    assert _exchanges(got) == 1
    assert {(r.book_id, r.symbol): (r.weight, r.shares) for r in got.collect()} == {
        (k, f"S{i}"): (pytest.approx((k + i + 1) / (3 * k + 6)), 4.0) for k in range(5) for i in range(3)
    }


def test_equal_targets_need_no_join(spark):
    """Without targets weights should be equal; positions that give no action do not change the others."""
    from bookheat.operators import actions as ACT

    part = "symbol string, weight double, heat_share double, score double, recommendation string, reason string, dominant_factor string"
    rows = [
        (1, 4, "a", 0.4, 0.5, 0.9, "reduce", "why", ""), (1, 4, "b", 0.3, 0.2, 0.9, "monitor", "", ""), (1, 4, "c", 0.2, 0.2, 0.9, "monitor", "", ""),
        (1, 4, "d", 0.1, 0.1, 0.9, "monitor", "", ""), (2, 2, "a", 0.9, 0.9, 0.1, "hold", "", ""), (2, 2, "b", 0.1, 0.1, 0.1, "hold", "", ""),
        (3, 2, "a", 0.9, 0.9, None, None, None, ""), (3, 2, "b", 0.1, 0.1, None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, f"book_id int, positions int, {part}")
    targets = df.select("book_id", "symbol", (1.0 / F.col("positions")).alias("weight"))
    want, got = ACT.recommendations(df, targets), ACT.recommendations(df)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and got.count() == 2
    assert _exchanges(got) == 1


def test_weights_are_not_folded_into_one_task(spark):
    """Whatever few bytes are shuffled, books lie in as many partitions as there are."""
    from bookheat.sources.tables import _weights

    h = spark.range(400).selectExpr("id AS book_id", "'a' AS symbol", "1.0D AS spend", "1.0D AS shares", "current_timestamp() AS updated_at")
    assert _weights(h).select(F.spark_partition_id()).distinct().count() == 8

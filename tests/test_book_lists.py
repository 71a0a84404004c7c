"""Lists of a book made from its packed row equal those made from rows; sets of symbols are solved once and met by their symbols."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bookheat.operators import actions as ACT
from bookheat.operators import factors as X
from bookheat.operators import graph as G
from bookheat.operators import heat as H
from bookheat.operators import metrics as M
from bookheat.operators.snapshot import portfolio_states
from bookheat.session import stage
from tests.test_packed_books import books, factors, returns, rows, same  # noqa: F401


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line for line in plan.splitlines())


def test_exposure_lists_equal_the_rows(spark):
    betas = [("a", "value", 1.0), ("a", "market", -2.0), ("b", "value", 0.0), ("b", "market", 2.0)]
    held = [(1, "a", 0.5), (1, "b", 0.5), (2, "b", 1.0), (2, "none", 0.4), (3, "none", 1.0), (4, "a", 0.0)]
    own = spark.createDataFrame(held, "book_id int, symbol string, weight double")
    for more in ([], [("c", "value", 3.0)], [("c", "value", None), ("c", "market", 1.0)]):
        exposures = spark.createDataFrame([(0, *b) for b in betas + more], "t int, symbol string, factor string, beta double")
        want = {(r.book_id, r.factor): (r.total_exposure, r.exposure_share) for r in X.aggregate_exposures(exposures, own).collect()}
        for frame in (own, M.packed_books(own)):
            got = X.exposure_lists(exposures, frame).select("book_id", F.inline("factor_exposures")).collect()
            assert {(r.book_id, r.factor): (r.total_exposure, r.exposure_share) for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    plain = X.exposure_lists(exposures.filter("symbol <> 'c'"), stage(M.packed_books(own), "packed"))
    assert _exchanges(plain) == 0


def test_targets_as_lists_equal_targets_as_rows(spark):
    part = "symbol string, weight double, heat_share double, score double, recommendation string, reason string, dominant_factor string"
    made = [
        (1, 3, "a", 0.5, 0.5, 0.9, "reduce", "why", ""), (1, 3, "b", 0.4, 0.3, 0.9, "monitor", "", ""), (1, 3, "c", 0.1, 0.2, 0.9, "monitor", "", ""),
        (2, 2, "a", 0.9, 0.9, 0.7, "monitor", "", ""), (2, 2, "b", 0.1, 0.1, 0.7, "monitor", "", ""), (3, 1, "a", 1.0, 1.0, 0.9, "reduce", "why", ""),
    ]
    df = spark.createDataFrame(made, f"book_id int, positions int, {part}")
    targets = spark.createDataFrame([(1, "a", 0.4), (1, "b", 0.1), (2, "a", 0.2)], "book_id int, symbol string, weight double")
    lists = targets.groupBy("book_id").agg(F.collect_list("symbol").alias("symbol"), F.collect_list("weight").alias("weight"))
    want, got = ACT.recommendations(df, targets), ACT.recommendations(df, lists)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and got.count() == 4
    placed = ACT.recommendations(df.repartition(5, "book_id"), stage(lists, "targets").repartition(5, "book_id").hint("shuffle_hash"))
    assert _exchanges(placed) == 2  # those asked for: neither the join nor the order of actions shuffles again


def test_packed_books_are_solved_without_a_shuffle_of_books(books, returns, spark):  # noqa: F811
    vectors = returns.groupBy("symbol").agg(F.collect_list("simple").alias("x"))
    want = rows(G.hrp_weights(books, vectors), "book_id", "symbol")
    made = G.hrp_lists(stage(M.packed_books(books), "packed"), vectors)
    assert _exchanges(made) == 0
    same(rows(made.select("book_id", F.inline(F.arrays_zip("symbol", "weight"))), "book_id", "symbol"), want)


def test_dates_asked_for_may_follow_from_the_book(books, returns, factors, spark, monkeypatch):  # noqa: F811
    packed = M.packed_books(books)
    first = dt.date(2020, 1, 1)
    asked = books.select("book_id").distinct().select("book_id", F.date_add(F.lit(first), 60 + F.col("book_id") % 5).alias("date"))
    column = F.array(F.date_add(F.lit(first), 60 + F.col("book_id") % 5))
    want = rows(H.own_history(books, returns, factors, asked=asked), "book_id", "t")
    same(rows(H.own_history(packed, returns, factors, asked=column), "book_id", "t"), want)
    monkeypatch.setattr(M, "MAX_SHIPPED_NUMBERS", 0)
    same(rows(H.own_history(packed, returns, factors, asked=column), "book_id", "t"), want)


def test_states_take_lists_and_placed_frames(spark):
    day = dt.date(2024, 1, 1)
    heat = spark.createDataFrame([(1, day, 0.2, "cool", 0.1)], "book_id int, date date, score double, level string, avg_corr double")
    own = spark.createDataFrame([(1, "A", 0.3), (1, "B", 0.7), (2, "C", 0.5), (2, "A", 0.5)], "book_id int, symbol string, weight double")
    clusters = spark.createDataFrame([(1, "B", 0), (1, "A", 1)], "book_id int, symbol string, cluster_id int")
    want = portfolio_states(heat, positions=own, clusters=clusters)
    place = lambda df: df.repartition(3, "book_id")
    listed = clusters.groupBy("book_id").agg(F.collect_list(F.struct("symbol", "cluster_id")).alias("clusters"))
    packed = M.packed_books(own).withColumnRenamed("items", "positions")
    got = portfolio_states(place(heat), positions=place(packed), clusters=place(listed))
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and got.count() == 2


def test_positions_without_a_weight_add_nothing(spark):
    exposures = spark.createDataFrame([(0, "a", "f", 2.0), (0, "b", "f", 1.0)], "t int, symbol string, factor string, beta double")
    held = [(1, "a", 0.5), (1, "b", None), (2, "a", 0.25)]
    got = X.exposure_lists(exposures, spark.createDataFrame(held, "book_id int, symbol string, weight double")).collect()
    assert {r.book_id: [tuple(e) for e in r.factor_exposures] for r in got} == {1: [("f", 1.0, 1.0)], 2: [("f", 0.5, 1.0)]}

"""Base tables and the report of the books' heat: shuffled once, in partitions that grow with the input, without shuffle files left behind."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookheat import session as S
from bookheat.functions import linalg as L
from bookheat.operators import heat as H
from bookheat.operators import metrics as M
from bookheat.sources import tables as T
from tests.test_packed_books import books, factors, returns  # noqa: F401

SF = "/root/testdata/sf0.01"


def test_partitions_grow_with_the_source(spark, monkeypatch):
    assert S.parts_of(spark, f"{SF}/orders.parquet") == S.least_parts(spark)
    monkeypatch.setattr(S, "PARTITION_BYTES", 10_000)
    size = Path(f"{SF}/orders.parquet").stat().st_size
    assert S.parts_of(spark, f"{SF}/orders.parquet") == -(-size // 10_000) > S.least_parts(spark)


def test_large_tables_meet_in_as_many_partitions(spark, monkeypatch):
    """Lines, parts and orders of any size give the same books."""
    bought = lambda: {tuple(r) for r in T._bought(spark, SF).groupBy("book_id", "symbol", "status").agg(F.count("*"), F.sum("shares")).collect()}
    want = bought()
    monkeypatch.setattr(S, "PARTITION_BYTES", 20_000)
    monkeypatch.setattr(T, "MAX_BROADCAST_PARTS", 0)
    assert bought() == want
    assert T._line_parts(spark, SF) > 20 and T._bought(spark, SF).rdd.getNumPartitions() == T._line_parts(spark, SF)


def test_books_hold_what_customers_spent(spark):
    part, lines, orders = (T.table(spark, SF, t) for t in ("part", "lineitem", "orders"))
    spend = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    flat = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    per = flat.groupBy("o_custkey", "p_brand").agg(spend.alias("s"), F.sum("l_quantity").alias("q"), F.max("o_orderdate").cast("timestamp").alias("u")).collect()
    total = {}
    for r in per:
        total[r.o_custkey] = total.get(r.o_custkey, 0.0) + r.s
    got = {(r.book_id, r.symbol): r for r in T.books(spark, SF).collect()}
    assert T.books(spark, SF).columns == ["book_id", "symbol", "weight", "shares", "updated_at"] and len(got) == len(per) == T.books(spark, SF).count()
    for r in per:
        own = got[r.o_custkey, r.p_brand]
        assert (own.weight, own.shares, own.updated_at) == (pytest.approx(r.s / total[r.o_custkey], rel=1e-12), r.q, r.u)
    assert T.packed_books(spark, SF).select("book_id").distinct().count() == T.packed_books(spark, SF).count() == len(total)


def test_staging_leaves_no_shuffle_files(spark):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    made = S.stage(spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "clean")
    assert made.count() == 7 and spark.conf.get(S.CLEAN_UP, "false") == "false"
    staged = lambda: [f for f in files() - before if f.stat().st_size > 1000]
    for _ in range(50):
        if not staged():
            return
        time.sleep(0.2)
    raise AssertionError(staged())


def test_numbers_are_rounded_as_by_spark(spark):
    rng = np.random.default_rng(1)
    v = [0.5e-6, 1.5e-6, 0.1234565, 1.0000005, 2.5e-6, -0.1234565, -1e-9, 0.0, -0.0, 1e22, 123456789012.3456785, float("inf"), float("-inf"), 0.285, 1.005]
    v = np.array([*v, *rng.normal(0, 5, 500), *rng.integers(0, 2_000_001, 500) / 2e6, *rng.integers(0, 10**9, 200) * 5e-7])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for digits in (0, 2, 4, 6, 10):
        want = [r[0] for r in df.select(S.rounded("v", digits)).collect()]
        got = L.rounded(v, digits)
        assert got.tolist() == want and not np.signbit(got[got == 0]).any()
    assert np.isnan(L.rounded(np.array([np.nan]), 3)).all()


def test_reported_days_are_the_rounded_days(books, returns, factors, monkeypatch):  # noqa: F811
    digits = {"absorption_ratio": 6, "turbulence": 4, "div_ratio": 6, "factor_hhi": 6, "avg_corr": 6, "score": 10}
    days = H.own_history(books, returns, factors, named=False)
    want = days.select("book_id", F.col("date").cast("string").alias("date"), *[S.rounded(c, d).alias(c) for c, d in digits.items()], "level")
    rows = sorted(map(tuple, want.collect()))
    made = H.reported_history(books, returns, factors, digits)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.dtypes == want.dtypes and sorted(map(tuple, made.collect())) == rows and len({r[-1] for r in rows}) > 1
    packed = M.packed_books(books)
    assert sorted(map(tuple, H.reported_history(packed, returns, factors, digits).collect())) == rows
    monkeypatch.setattr(M, "MAX_SHIPPED_NUMBERS", 0)
    joined = sorted(map(tuple, H.reported_history(packed, returns, factors, digits).collect()))
    assert [r[:2] for r in joined] == [r[:2] for r in rows]
    assert np.allclose([r[2:8] for r in joined], [r[2:8] for r in rows], atol=1e-5)

"""Rounded texts and figures go by one exact rule on both sides."""

import datetime as dt

from bookheat.functions import rules as R
from bookheat.operators import ledger as LG
from bookheat.plans import io_queries as IQ
from bookheat.plans import ledger_queries as LQ
from bookheat.plans.catalog import CHECKS
from pyspark.sql import functions as F
from tests.compare import TABLES, rows_of


def test_texts_round_the_binary_value(spark):
    values = [0.865, 0.875, 0.885, 0.125, 0.375, 0.7, 0.995, 0.0005, -0.0005, -0.1, 0.0, 1.0, 0.6049999999999999, 1e-9, 2.675, 31.995]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", R.fixed(F.col("x"), 2).alias("two"), R.fixed(F.col("x"), 3, plus=True).alias("three")).collect()
    assert [(r.two, r.three) for r in got] == [(f"{r.x:.2f}", f"{r.x:+.3f}") for r in got]


def sides(spark, tmp_path, name, job, rows, schema):
    """Rows of a query and of its SQL over a table of events."""
    import duckdb

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = job(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    rel = con.execute(CHECKS[name])
    assert "events" in TABLES
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of([d[0] for d in rel.description], rel.fetchall())


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def test_half_a_tenth_of_a_minute(spark, tmp_path):
    day = dt.datetime(2024, 1, 30, 22, 0)
    rows = [(k, day + dt.timedelta(seconds=3 * k), k, "purchase", 1.0) for k in range(600)]
    got, want = sides(spark, tmp_path, "cooldown_status", LQ.cooldown_status, rows, EVENTS)
    assert len(got) == 600 and got == want


def test_a_zero_of_either_field_is_dropped(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(k, day, 1, kind, float(v)) for k, (kind, v) in enumerate((t, v) for t in ("error", "view", "click", "purchase") for v in (0, 0, 0, 2))]
    got, want = sides(spark, tmp_path, "parse_heat_history", IQ.parse_heat_history, rows, EVENTS)
    assert got == want and got and all("2" in r for r in got)


def test_a_channel_never_seen_by_the_server_counts_zero(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, 12, 0)
    rows = [(11 * k, day, 1, "purchase", 1.0) for k in range(3)] + [(k, day, 2, "signup", 1.0) for k in range(1, 14)]
    got, want = sides(spark, tmp_path, "corroboration", LQ.corroboration, rows, EVENTS)
    assert len(got) == 2 and got == want

"""Ledgers, feedback and chat messages derived from events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat.functions import rules as R
from bookheat.session import staged
from bookheat.sources.tables import table

TIERS = {
    "purchase": "daily_summary",
    "signup": "weekly_scorecard",
    "view": "alert_level_change",
    "error": "alert_emergency",
}


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery records: one per event that is not a click, channel = user. Staged."""
    return staged(spark, sf, "ledger", lambda: _ledger(spark, sf))


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    utc = F.col("ts").cast("timestamp")
    symbol = lambda k: F.concat(F.lit("Brand#"), ((eid + k) % 9 + 1).cast("string"))
    positions = F.when(eid % 5 != 0, F.array(symbol(0), symbol(3)))
    return (
        table(spark, sf, "events")
        .filter("event_type <> 'click'")
        .select(
            F.col("user_id").alias("channel"),
            R.lookup(F.col("event_type"), TIERS).alias("tier"),
            R.market_day(utc).alias("et_date"),
            R.market_time(utc).alias("et_time"),
            utc.alias("utc"),
            (eid % 3 != 0).alias("scheduled"),
            eid.alias("message_id"),
            F.when(eid % 11 != 0, utc + F.make_interval(mins=(eid % 7) * 5)).alias("server_ts"),
            F.least(F.col("value") / 100, F.lit(1.0)).alias("heat_score"),
            positions.alias("positions"),
            F.when(
                eid % 5 != 0, F.array(F.struct(symbol(0).alias("symbol"), F.lit(0.6).alias("share")))
            ).alias("top_attributions"),
            F.when(eid % 13 != 0, "HOLD").otherwise(" ").alias("action"),
        )
    )


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Taps: one per click event."""
    return (
        table(spark, sf, "events")
        .filter("event_type = 'click'")
        .select(
            F.col("user_id").alias("channel"),
            F.when(F.col("value") > 20, "yes").otherwise("no").alias("vote"),
            F.col("ts").cast("timestamp").alias("tapped_at"),
            F.lit("api").alias("source"),
        )
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chat messages in reply form around the whole conversation text: (session_id, idx, role, content, ts, topic, day)."""
    n, who, body = F.length("text") % 6, F.concat(F.lit("["), F.col("role"), F.lit("] ")), F.col("text")
    content = (
        F.when(n == 0, F.concat(who, F.lit('[Replying to: "'), body, F.lit('"]\n\nYes.')))
        .when(n == 1, F.concat(who, F.lit("no "), body))
        .when(n == 2, F.concat(who, F.lit('[Replying to: "'), body, F.lit(' [x]"]\n\n👍🏽')))
        .when(n == 3, F.concat(F.lit('[other] [Replying to: "'), body, F.lit('"] NO!')))
        .when(n == 4, F.concat(who, F.lit('[Replying to: "'), body, F.lit('"] yes '), body))
        .otherwise(body)
    )
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("conv_id") % 30).cast("int"))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("idx"),
        "role",
        content.alias("content"),
        (F.col("conv_id") % 10).alias("topic"),
        day.alias("day"),
        day.cast("timestamp").alias("ts"),
    )

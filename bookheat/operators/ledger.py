"""Delivery and feedback ledgers per channel: streaks, corroboration, verdicts, cooldowns.

Ledger rows: (channel, tier, et_date, et_time, utc, scheduled, message_id, server_ts, heat_score,
positions, top_attributions, action). Feedback rows: (channel, vote, tapped_at, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.functions import rules as R


def _scheduled(ledger: DataFrame, tier: str) -> DataFrame:
    return ledger.filter((F.col("tier") == tier) & F.col("scheduled") & F.col("et_date").isNotNull())


def has_scheduled_summary(ledger: DataFrame, days: DataFrame) -> DataFrame:
    """The (channel, et_date) rows of ``days`` on which a scheduled summary went out."""
    return days.join(_scheduled(ledger, C.SUMMARY_TIER), ["channel", "et_date"], "left_semi")


def _runs(ledger: DataFrame, scheduled_only: bool = True) -> DataFrame:
    """Distinct delivered days with their island; the last record of a day gives its id."""
    rows = ledger.filter((F.col("tier") == C.SUMMARY_TIER) & F.col("et_date").isNotNull())
    if scheduled_only:
        rows = rows.filter("scheduled")
    days = rows.groupBy("channel", "et_date").agg(F.max_by("message_id", F.struct("utc", "message_id")).alias("message_id"))
    w = Window.partitionBy("channel").orderBy("et_date")
    return days.withColumn("island", F.date_sub("et_date", F.row_number().over(w))).withColumn(
        "last_island", F.max("island").over(Window.partitionBy("channel"))
    )


def daily_streak(ledger: DataFrame, today: Column, scheduled_only: bool = True) -> DataFrame:
    """Length of the newest run of consecutive delivered days; live if it ended no earlier than yesterday."""
    last = F.col("island") == F.col("last_island")
    return (
        _runs(ledger, scheduled_only)
        .groupBy("channel")
        .agg(
            F.count_if(last).alias("streak"),
            F.max("et_date").alias("last_date"),
            F.count("*").alias("delivered_days"),
            F.min(F.when(last, F.col("et_date"))).alias("first_date"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.when(last, F.struct("et_date", "message_id")))),
                    lambda e: e["message_id"].cast("string"),
                ),
                ",",
            ).alias("message_ids"),
        )
        .withColumn("live", F.col("last_date") >= F.date_sub(today, 1))
    )


def corroborate(ledger: DataFrame) -> DataFrame:
    """Recorded day against the day derived from the server clock, per (channel, tier)."""
    server_day = R.market_day(F.col("server_ts"))
    seen = F.col("server_ts").isNotNull()
    match = seen & (server_day == F.col("et_date"))
    return ledger.groupBy("channel", "tier").agg(
        F.count_if(seen).alias("checked"),
        F.count_if(match).alias("corroborated"),
        F.count_if(seen & ~F.coalesce(match, F.lit(False))).alias("mismatched"),
        F.count_if(~seen).alias("missing"),
    )


def clock_mismatches(ledger: DataFrame) -> DataFrame:
    """The records whose day disagrees with the server clock."""
    return ledger.withColumn("server_date", R.market_day(F.col("server_ts"))).filter("server_date <> et_date")


def _reasons(*pairs: tuple[Column, Column]) -> Column:
    return F.concat_ws("; ", *[F.when(cond, msg) for cond, msg in pairs])


def streak_verdict(ledger: DataFrame, today: Column, required: int = C.REQUIRED_STREAK_DAYS) -> DataFrame:
    """Is the streak long enough, live and free of clock mismatches? With reasons and evidence."""
    checks = corroborate(ledger.filter(F.col("tier") == C.SUMMARY_TIER)).drop("tier")
    channels = ledger.select("channel").distinct()
    s = channels.join(daily_streak(ledger, today), "channel", "left").join(checks, "channel", "left")
    s = s.withColumn("streak", F.coalesce("streak", F.lit(0))).withColumn("live", F.coalesce("live", F.lit(False)))
    for c in ("corroborated", "missing", "mismatched"):
        s = s.withColumn(c, F.coalesce(c, F.lit(0)))
    reasons = _reasons(
        (F.col("streak") < required, F.concat(F.lit("streak "), F.col("streak").cast("string"), F.lit(f"/{required}"))),
        (~F.col("live"), F.lit("streak not live")),
        (F.col("mismatched") > 0, F.concat(F.col("mismatched").cast("string"), F.lit(" clock mismatch(es)"))),
    )
    evidence = F.concat(
        F.col("first_date").cast("string"), F.lit(".."), F.col("last_date").cast("string"), F.lit(" messages "),
        F.col("message_ids"), F.lit("; corroborated="), F.col("corroborated").cast("string"), F.lit(" missing="),
        F.col("missing").cast("string"), F.lit(" mismatched="), F.col("mismatched").cast("string"),
    )
    return s.select(
        "channel",
        "streak",
        "live",
        F.greatest(F.lit(required) - F.col("streak"), F.lit(0)).alias("days_remaining"),
        reasons.alias("reasons"),
        (reasons == "").alias("met"),
        F.coalesce(evidence, F.lit("")).alias("evidence"),
    )


def weekly_verdict(ledger: DataFrame, now_local: Column, first_expected: Column) -> DataFrame:
    """Has the week that is due got its scheduled weekly post, without a clock mismatch?"""
    year, week = R.iso_week(F.col("et_date"))
    slot = R.due_monday(now_local)
    due = F.greatest(slot, first_expected)
    due_year, due_week = R.iso_week(F.col("due_monday"))
    weekly = _scheduled(ledger, C.WEEKLY_TIER)
    server_day = R.market_day(F.col("server_ts"))
    base = ledger.select("channel").distinct().withColumn("due_monday", due).withColumn("slot", slot)
    joined = base.join(weekly.drop("due_monday"), "channel", "left")
    is_due = (year == due_year) & (week == due_week)
    bad = is_due & F.col("server_ts").isNotNull() & (server_day != F.col("et_date"))
    agg = joined.groupBy("channel", "due_monday", "slot").agg(
        F.count("message_id").alias("weekly_posts"),
        F.count_if(is_due).alias("due_posts"),
        F.count_if(bad).alias("mismatched"),
        F.max_by("message_id", F.struct("et_date", "message_id")).alias("last_message_id"),
    )
    early = F.col("slot") < first_expected
    reasons = _reasons(
        (early, F.concat(F.lit("not yet due; first expected weekly post "), first_expected.cast("string"))),
        (~early & (F.col("due_posts") == 0), F.concat(F.lit("no scheduled weekly_scorecard in week of "), F.col("due_monday").cast("string"))),
        (F.col("mismatched") > 0, F.concat(F.col("mismatched").cast("string"), F.lit(" clock mismatch(es)"))),
    )
    return agg.select(
        "channel", "due_monday", "weekly_posts", (F.col("due_posts") > 0).alias("delivered"), "mismatched",
        "last_message_id", reasons.alias("reasons"), (reasons == "").alias("met"),
    )


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; ties broken by the later order columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def surfaced_feedback(summaries: DataFrame, feedback: DataFrame) -> DataFrame:
    """The newest summary sent after the last tap: a later day, or the same day and a later time."""
    fb = last_per_key(feedback, ["channel"], ["tapped_at", "vote"]).select(
        "channel", "vote", R.market_day(F.col("tapped_at")).alias("vote_day"), R.market_time(F.col("tapped_at")).alias("vote_time")
    )
    later = (F.col("et_date") > F.col("vote_day")) | (
        (F.col("et_date") == F.col("vote_day")) & (F.col("et_time") > F.col("vote_time"))
    )
    hit = fb.join(summaries.select("channel", "et_date", "et_time", "message_id"), "channel").filter(later)
    best = hit.groupBy("channel").agg(
        F.max_by("message_id", F.struct("et_date", "et_time", "message_id")).alias("surfaced_message_id")
    )
    return fb.join(best, "channel", "left")


def payload_verdict(
    ledger: DataFrame, feedback: DataFrame, first_expected: Column, expected: DataFrame | None = None
) -> DataFrame:
    """Do all scheduled summaries since ``first_expected`` carry book, attributions and action, does
    the newest book equal ``expected`` (channel, symbol), and was the last tap surfaced?"""
    rows = _scheduled(ledger, C.SUMMARY_TIER).filter(F.col("et_date") >= first_expected)
    carries = (
        (F.coalesce(F.size("positions"), F.lit(0)) > 0)
        & (F.coalesce(F.size("top_attributions"), F.lit(0)) > 0)
        & (F.trim(F.coalesce("action", F.lit(""))) != "")
    )
    rows = rows.withColumn("carries", carries)
    order = F.struct("utc", "message_id")
    book = F.array_sort(F.array_distinct(F.transform("positions", lambda s: F.upper(s))))
    agg = rows.groupBy("channel").agg(
        F.count("*").alias("expected"),
        F.count_if("carries").alias("with_payload"),
        F.max_by(book, F.when(F.col("carries"), order)).alias("newest_book"),
    )
    out = (
        ledger.select("channel").distinct()
        .join(agg, "channel", "left")
        .join(surfaced_feedback(rows.filter("carries"), feedback), "channel", "left")
        .withColumn("expected", F.coalesce("expected", F.lit(0)))
        .withColumn("with_payload", F.coalesce("with_payload", F.lit(0)))
    )
    if expected is not None:
        want = expected.groupBy("channel").agg(F.array_sort(F.collect_set(F.upper("symbol"))).alias("want"))
        out = out.join(want, "channel", "left").withColumn("book_match", F.col("newest_book") == F.col("want")).drop("want")
    else:
        out = out.withColumn("book_match", F.lit(None).cast("boolean"))
    missing = F.col("expected") - F.col("with_payload")
    reasons = _reasons(
        (F.col("expected") == 0, F.concat(F.lit("no scheduled daily summaries since "), first_expected.cast("string"), F.lit(" yet"))),
        (missing > 0, F.concat(missing.cast("string"), F.lit(" scheduled summaries missing payload"))),
        (~F.coalesce("book_match", F.lit(True)), F.lit("latest summary's scored book differs from the positions")),
        (F.col("vote").isNull(), F.lit("waiting for the first YES/NO tap")),
        (
            F.col("vote").isNotNull() & F.col("surfaced_message_id").isNull(),
            F.concat(F.lit("tap "), F.col("vote"), F.lit(" "), F.col("vote_day").cast("string"), F.lit(" not yet surfaced in a summary")),
        ),
    )
    return out.select(
        "channel", "expected", "with_payload", "book_match", "vote", "surfaced_message_id",
        reasons.alias("reasons"), (reasons == "").alias("met"),
    )


def streak_report(ledger: DataFrame, feedback: DataFrame, today: Column, now_local: Column, first_expected: Column) -> DataFrame:
    """The three verdicts and the row count per channel on one row."""
    s = streak_verdict(ledger, today).select("channel", "streak", F.col("met").alias("streak_met"))
    w = weekly_verdict(ledger, now_local, first_expected).select("channel", F.col("met").alias("weekly_met"))
    p = payload_verdict(ledger, feedback, first_expected).select("channel", F.col("met").alias("payload_met"))
    n = ledger.groupBy("channel").agg(F.count("*").alias("records"))
    return n.join(s, "channel").join(w, "channel").join(p, "channel")


def cooldown_status(ledger: DataFrame, as_of: Column, tiers: dict[str, int] | None = None) -> DataFrame:
    """Minutes left on each tier's cooldown per channel at ``as_of``; ledgers prefix alert tiers."""
    minutes = R.lookup(F.regexp_replace("tier", "^alert_", ""), {k: float(v) for k, v in (tiers or C.COOLDOWN_MINUTES).items()}, 60.0)
    last = ledger.groupBy("channel", "tier").agg(F.max("utc").alias("last_sent"))
    elapsed = (F.unix_timestamp(as_of) - F.unix_timestamp("last_sent")) / 60.0
    left = F.greatest(minutes - elapsed, F.lit(0.0))
    return last.select("channel", "tier", minutes.alias("cooldown_minutes"), left.alias("remaining_minutes"), (left > 0).alias("on_cooldown"))


def tier_counts(ledger: DataFrame) -> DataFrame:
    """Deliveries per channel, tier and day: an alert storm shows as a large count."""
    return ledger.groupBy("channel", "tier", "et_date").agg(F.count("*").alias("sent"))

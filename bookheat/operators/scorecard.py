"""Drawdown episodes and the lead time of warning signals, per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookheat.functions import rules as R
from bookheat.operators.panel import as_of_fill
from bookheat.operators.signals import moving_average


def lookback(closes: DataFrame, months: int) -> DataFrame:
    """Rows later than the symbol's last date minus ``months`` calendar months."""
    last = F.max("date").over(Window.partitionBy("symbol"))
    return closes.withColumn("_last", last).filter(F.col("date") > F.add_months("_last", -months)).drop("_last")


def drawdown_episodes(closes: DataFrame, min_depth: float = 0.05) -> DataFrame:
    """Peak-to-recovery episodes at least ``min_depth`` deep.

    Every close at or above the running peak starts a new island; a deep enough island is an
    episode and the next island's start is its recovery.
    """
    order = Window.partitionBy("symbol").orderBy("date")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    peak = F.coalesce(F.col("close") >= F.max("close").over(before), F.lit(True))
    islands = closes.withColumn("island", F.count_if(peak).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per = islands.groupBy("symbol", "island").agg(
        F.min("date").alias("peak_date"),
        F.min_by("close", "date").alias("peak_close"),
        F.min_by("date", F.struct("close", "date")).alias("trough_date"),
        F.min("close").alias("trough_close"),
    )
    depth = F.col("trough_close") / F.col("peak_close") - 1
    return (
        per.withColumn("recovery_date", F.lead("peak_date").over(Window.partitionBy("symbol").orderBy("island")))
        .withColumn("depth", F.round(depth, 6))
        .filter(depth <= -min_depth)
        .select(
            "symbol",
            "peak_date",
            "trough_date",
            "recovery_date",
            "depth",
            F.date_diff("trough_date", "peak_date").alias("days_peak_to_trough"),
        )
    )


def warning_leads(
    closes: DataFrame, vix: DataFrame, episodes: DataFrame, vix_threshold: float = 25.0, ma_window: int = 50
) -> DataFrame:
    """First fire, days active and lead to the trough of both signals inside each episode."""
    filled = as_of_fill(closes.select("date").distinct(), vix, "vix", [])
    flags = (
        closes.withColumn("ma", moving_average("close", ["symbol"], "date", ma_window))
        .join(filled, "date", "left")
        .select(
            "symbol",
            "date",
            F.coalesce(F.col("vix") > vix_threshold, F.lit(False)).alias("v"),
            F.coalesce(F.col("close") < F.col("ma"), F.lit(False)).alias("m"),
        )
        .filter(F.col("v") | F.col("m"))
    )
    e, f = episodes.alias("e"), flags.alias("f")
    inside = (F.col("e.symbol") == F.col("f.symbol")) & F.col("f.date").between(
        F.col("e.peak_date"), F.col("e.trough_date")
    )
    cols = [F.col(f"e.{c}") for c in episodes.columns]
    agg = e.join(f, inside, "left").groupBy(*cols).agg(
        F.min(F.when(F.col("f.v"), F.col("f.date"))).alias("vix_first"),
        F.count_if(F.col("f.v")).alias("vix_days"),
        F.min(F.when(F.col("f.m"), F.col("f.date"))).alias("ma_first"),
        F.count_if(F.col("f.m")).alias("ma_days"),
    )
    return agg.withColumn("vix_lead", F.date_diff("trough_date", "vix_first")).withColumn(
        "ma_lead", F.date_diff("trough_date", "ma_first")
    )


def scorecard(closes: DataFrame, warned: DataFrame) -> DataFrame:
    """Window, episode count, hits and median lead per symbol for each signal and for either."""
    window = closes.groupBy("symbol").agg(F.min("date").alias("window_start"), F.max("date").alias("window_end"))
    either = F.greatest("vix_lead", "ma_lead")
    agg = warned.groupBy("symbol").agg(
        F.count("*").alias("episodes"),
        *[
            x
            for n, c in (("vix", F.col("vix_lead")), ("ma", F.col("ma_lead")), ("either", either))
            for x in (F.count(c).alias(f"{n}_fired"), F.median(c).alias(f"{n}_median_lead"))
        ],
    )
    out = window.join(agg, "symbol", "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))
    for n in ("vix", "ma", "either"):
        out = out.withColumn(f"{n}_fired", F.coalesce(f"{n}_fired", F.lit(0))).withColumn(
            f"{n}_hit_rate", F.coalesce(F.try_divide(f"{n}_fired", "episodes"), F.lit(0.0))
        )
    return out


def scorecard_text(card: DataFrame, warned: DataFrame) -> DataFrame:
    """Report text per symbol: header, one line per episode, hit line."""
    mark = lambda lead: F.when(lead.isNull(), "MISS").otherwise(
        F.concat(F.lit("HIT +"), lead.cast("string"), F.lit("d"))
    )
    line = F.concat(
        F.lit(". "), F.col("peak_date").cast("string"), F.lit("→"), F.col("trough_date").cast("string"), F.lit(" "),
        R.percent(F.col("depth"), 1), F.lit(" ("), F.col("days_peak_to_trough").cast("string"), F.lit("d, "),
        F.when(F.col("recovery_date").isNull(), "UNRECOVERED").otherwise("recovered"), F.lit(") | VIX "),
        mark(F.col("vix_lead")), F.lit(" | MA "), mark(F.col("ma_lead")),
    )
    lines = warned.select("symbol", F.struct("peak_date", line.alias("l")).alias("s")).groupBy("symbol").agg(
        F.array_sort(F.collect_list("s")).alias("ls")
    )
    numbered = F.transform("ls", lambda s, i: F.concat((i + 1).cast("string"), s["l"]))

    def hit(name: str, label: str):
        lead = F.col(f"{name}_median_lead")
        shown = F.when(lead.isNull(), "n/a").otherwise(
            F.concat(F.regexp_replace(F.format_string("%.1f", lead), "\\.0$", ""), F.lit("d"))
        )
        return F.concat(
            F.lit(f"{label} "), F.col(f"{name}_fired").cast("string"), F.lit("/"), F.col("episodes").cast("string"),
            F.lit(" ("), R.percent(F.col(f"{name}_hit_rate")), F.lit(") lead "), shown,
        )

    head = F.concat(
        F.lit("📊 <b>WEEKLY LEAD-TIME SCORECARD</b> — "), F.col("symbol"), F.lit("\nWindow: "),
        F.col("window_start").cast("string"), F.lit(" → "), F.col("window_end").cast("string"),
    )
    body = F.concat(
        head, F.lit("\n\n<b>Drawdown episodes (≥5%): "), F.col("episodes").cast("string"), F.lit("</b>\n"),
        F.array_join(numbered, "\n"), F.lit("\n\n<b>Hits:</b> "),
        F.concat_ws(" · ", hit("vix", "VIX"), hit("ma", "MA"), hit("either", "either")),
    )
    return card.join(lines, "symbol", "left").select(
        "symbol",
        F.when(F.col("ls").isNull(), F.concat(head, F.lit("\n\nNo qualifying drawdowns in the window."))).otherwise(body).alias("text"),
    )


def stale_scorecards(card: DataFrame, today, max_days: int = 10) -> DataFrame:
    """Cards whose window ended more than ``max_days`` ago."""
    return card.withColumn("age_days", F.date_diff(today, "window_end")).withColumn(
        "stale", F.col("window_end").isNull() | (F.col("age_days") > max_days)
    )

"""Report and alert texts per book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.functions import rules as R


def _fmt(pattern: str, c: Column, digits: int) -> Column:
    return F.format_string(pattern, F.bround(c, digits))


def _by_share() -> list[Column]:
    """Largest heat share first; among equal ones in the order of their lines, which begin with the symbol and a colon."""
    return [F.col("heat_share").desc(), F.concat(F.col("symbol"), F.lit(": "))]


def _ranked_lines(df: DataFrame, order: list[Column], line: Column, n: int, out: str, number: str = "") -> DataFrame:
    """The first ``n`` lines of each book joined by newlines, headed by their number if given a format for it.

    ``order`` decides without the line itself, so only the lines that are shown are made.
    """
    w = Window.partitionBy("book_id").orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= n)
        .withColumn("_l", line)
        .groupBy("book_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_l"))), lambda s: F.format_string(f"{number}%s", s["_rn"], s["_l"]) if number else s["_l"]), "\n").alias(out))
    )


def first_action(recs: DataFrame) -> DataFrame:
    """The action line source of each book: its first non-hedge action."""
    w = Window.partitionBy("book_id").orderBy("priority")
    return recs.filter("action <> 'hedge'").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def summary_action_lines(books: DataFrame, recs: DataFrame) -> DataFrame:
    """One action line per book, the hold text where there is no action."""
    a = first_action(recs).select("book_id", "action", "instrument", "why", "urgency")
    line = R.action_line(F.col("action"), F.col("instrument"), F.col("why"), F.col("urgency"), F.lit(True))
    return books.select("book_id").distinct().join(a, "book_id", "left").select("book_id", line.alias("action_line"))


def daily_summary(
    heat: DataFrame, regime: DataFrame, attributed: DataFrame, recs: DataFrame, summary: DataFrame,
    feedback: DataFrame, stamp: Column, source: Column, age: Column,
) -> DataFrame:
    """End-of-day report per book from its newest rows of every table."""
    top = _ranked_lines(
        attributed, _by_share(),
        F.concat(F.lit("  "), F.col("symbol"), F.lit(": "), R.percent(F.col("heat_share")), F.lit(" heat share ("), F.col("recommendation"), F.lit(")")),
        3, "top",
    )
    acts = _ranked_lines(
        recs.filter("action <> 'hedge'"), [F.col("priority")],
        F.concat(F.lit("  "), F.upper("urgency"), F.lit(": "), F.col("action"), F.lit(" "), F.col("instrument"), F.lit(" ("), F.col("why"), F.lit(")")),
        3, "acts",
    )
    base = (
        heat.join(regime.select("book_id", "regime", "confidence"), "book_id", "left")
        .join(top, "book_id", "left")
        .join(acts, "book_id", "left")
        .join(summary.select("book_id", "n_actions", "heat_after"), "book_id", "left")
        .join(feedback.select("book_id", "vote", "vote_day"), "book_id", "left")
    )
    pct = lambda c: R.percent(F.col(c))
    regime_name = F.coalesce("regime", F.lit("unknown"))
    text = F.concat(
        R.lookup(F.col("level"), C.LEVEL_EMOJI, "?"), F.lit(" <b>DAILY RISK SUMMARY</b>\n"), stamp,
        F.lit("\n\n<b>Heat Score:</b> "), _fmt("%.3f", F.col("score"), 3), F.lit(" ("), F.upper("level"), F.lit(")\n<b>Regime:</b> "),
        F.upper(regime_name), F.lit(" (confidence: "), R.percent(F.coalesce("confidence", F.lit(0.0))), F.lit(")\n\n<b>Components:</b>\n  Absorption Ratio: "),
        _fmt("%.3f", F.col("absorption_ratio"), 3), F.lit("\n  Turbulence: "), _fmt("%.1f", F.col("turbulence"), 1), F.lit(" (P"), pct("turbulence_pct"),
        F.lit(")\n  Diversification: "), _fmt("%.2f", F.col("div_ratio"), 2), F.lit(" (P"), pct("div_ratio_pct"),
        F.lit(")\n  Factor HHI: "), _fmt("%.3f", F.col("factor_hhi"), 3), F.lit(" (P"), pct("factor_hhi_pct"),
        F.lit(")\n  Avg Correlation: "), _fmt("%.3f", F.col("avg_corr"), 3), F.lit(" (P"), pct("avg_corr_pct"), F.lit(")"),
        F.coalesce(F.concat(F.lit("\n\n<b>Top Contributors:</b>\n"), F.col("top")), F.lit("")),
        F.lit("\n\n<b>Recommendations:</b> "),
        F.when(F.col("n_actions").isNull(), "unavailable this cycle")
        .when(F.col("n_actions") == 0, F.concat(F.lit("No actions needed. Heat "), _fmt("%.3f", F.col("score"), 3), F.lit(" in "), regime_name, F.lit(" regime.")))
        .otherwise(
            F.concat(
                F.col("n_actions").cast("string"), F.lit(" actions recommended. Heat "), _fmt("%.3f", F.col("score"), 3), F.lit(" -> est. "),
                _fmt("%.3f", F.col("heat_after"), 3), F.lit(" ("), regime_name, F.lit(" regime)."),
            )
        ),
        F.lit("\n"),
        F.coalesce("acts", F.concat(F.lit("  "), F.when(F.col("n_actions").isNull(), C.HOLD_NO_SIGNAL).otherwise(C.HOLD_NO_CHANGE))),
        F.coalesce(
            F.concat(F.lit("\n\n<b>Last feedback:</b> "), F.when(F.col("vote") == "yes", "👍").otherwise("👎"), F.lit(" "), F.upper("vote"), F.lit(" ("), F.col("vote_day").cast("string"), F.lit(")")),
            F.lit(""),
        ),
        F.lit("\n\nWas this useful? Reply <b>YES</b> / <b>NO</b> (or 👍 / 👎) in this topic.\n\n<b>Data:</b> "),
        source, F.lit(" | Age: "), _fmt("%.0f", age, 0), F.lit("s"),
    )
    return base.select("book_id", text.alias("text"))


def level_changes(heat: DataFrame) -> DataFrame:
    """Alert text of every change of level in a heat history."""
    w = Window.partitionBy("book_id").orderBy("date")
    sev = {k: float(v) for k, v in C.SEVERITY.items()}
    df = heat.withColumn("prev", F.lag("level").over(w)).filter(F.col("level") != F.col("prev"))
    up = R.lookup(F.col("level"), sev, 0.0) > R.lookup(F.col("prev"), sev, 0.0)
    named = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "N/A").otherwise(c)
    text = F.concat(
        F.when(up, "⬆️").otherwise("⬇️"), F.lit(" <b>HEAT LEVEL CHANGE</b>\n\n"),
        R.lookup(F.col("prev"), C.LEVEL_EMOJI, "?"), F.lit(" "), F.upper("prev"), F.lit(" -> "),
        R.lookup(F.col("level"), C.LEVEL_EMOJI, "?"), F.lit(" "), F.upper("level"),
        F.lit("\n<b>Score:</b> "), _fmt("%.3f", F.col("score"), 3),
        F.lit("\n\n<b>Dominant Factor:</b> "), named(F.col("dominant_factor")),
        F.lit("\n<b>Top Correlated Pair:</b> "), named(F.col("top_pair")),
        F.lit("\n\n<b>Action:</b> "), F.col("action"),
    )
    return df.select("book_id", "date", F.when(up, "UP").otherwise("DOWN").alias("direction"), text.alias("text"))


def regime_shift(old: Column, new: Column, confidence: Column) -> Column:
    """Alert text of a change of regime."""
    block = lambda k: "".join(f"\n  - {line}" for line in C.REGIME_IMPLICATIONS[k])
    return F.concat(
        F.lit("🔄 <b>REGIME SHIFT DETECTED</b>\n\n"), R.lookup(old, C.REGIME_EMOJI, "❓"), F.lit(" "), F.upper(old), F.lit(" -> "),
        R.lookup(new, C.REGIME_EMOJI, "❓"), F.lit(" "), F.upper(new), F.lit("\n<b>Confidence:</b> "), R.percent(confidence),
        F.lit("\n\n<b>Implications:</b>"),
        F.when(new == "crisis", block("crisis")).when(new == "low_vol", block("low_vol")).otherwise(block("other")),
    )


def emergency(heat: DataFrame, attributed: DataFrame, recs: DataFrame, at: Column) -> DataFrame:
    """Emergency text per book: up to five actions (or the fixed ones), top three shares, three hedges."""
    acts = _ranked_lines(
        recs.filter("action <> 'hedge'"), [F.col("priority")],
        F.concat(
            F.upper("action"), F.lit(" "), F.col("instrument"), F.lit(": "), R.percent(F.col("current_weight")), F.lit(" -> "),
            R.percent(F.col("target_weight")), F.lit(" ("), F.col("why"), F.lit(")"),
        ),
        5, "acts", "  %d. ",
    )
    hedges = _ranked_lines(
        recs.filter("action = 'hedge'"), [F.col("priority")],
        F.concat(F.lit("  BUY "), F.col("instrument"), F.lit(" @ "), R.percent(F.col("target_weight"))), 3, "hedges",
    )
    top = _ranked_lines(
        attributed, _by_share(),
        F.concat(F.lit("  "), F.col("symbol"), F.lit(": "), R.percent(F.col("heat_share")), F.lit(" of total heat")), 3, "top",
    )
    fixed = "\n".join(f"  {i}. {a}" for i, a in enumerate(C.EMERGENCY_FALLBACK_ACTIONS, 1))
    text = F.concat(
        F.lit("⚠️⚠️ <b>EMERGENCY RISK ALERT</b> ⚠️⚠️\n\n<b>Heat Score:</b> "), _fmt("%.3f", F.col("score"), 3), F.lit(" (EMERGENCY)\n<b>Timestamp:</b> "), at,
        F.lit("\n\n<b>IMMEDIATE ACTIONS REQUIRED:</b>\n"), F.coalesce("acts", F.lit(fixed)),
        F.coalesce(F.concat(F.lit("\n\n<b>Biggest Risk Contributors:</b>\n"), F.col("top")), F.lit("")),
        F.coalesce(F.concat(F.lit("\n\n<b>Hedge Recommendations:</b>\n"), F.col("hedges")), F.lit("")),
    )
    return (
        heat.filter("level = 'emergency'")
        .join(acts, "book_id", "left").join(top, "book_id", "left").join(hedges, "book_id", "left")
        .select("book_id", text.alias("text"))
    )

"""Votes in chat replies: classification, verification and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookheat.functions import rules as R

# Fixed patterns (Java regular expressions)
ENVELOPE = r"(?s)^\[([^\]]+)\]\s*\[Replying to:(.*)\](.+)$"
PREFIX = r"(?s)^\[([^\]]+)\]\s*(.*)$"
BARE = r"(?i)^(yes|no)[\s.!]*$"
BARE_THUMB = r"^(\x{1F44D}|\x{1F44E})[\x{FE0F}\x{1F3FB}-\x{1F3FF}\s.!]*$"
LEADING = r"(?i)^((yes|no)\b|\x{1F44D}|\x{1F44E})"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def classify_replies(messages: DataFrame, content: str, sender: str) -> DataFrame:
    """Adds kind (candidate, sender_mismatch, near_miss or null), vote and observed sender.

    A bare vote of the expected sender is a candidate, of anybody else a mismatch; a leading vote
    with more words is a near miss. The envelope of a quoted reply is taken off first.
    """
    who = sender.lower()
    df = messages.withColumn("_t", strip(F.col(content)))
    df = df.withColumn("_q", F.col("_t").rlike(ENVELOPE)).withColumn(
        "_s", F.when(F.col("_q"), F.regexp_extract("_t", ENVELOPE, 1)).otherwise(F.regexp_extract("_t", PREFIX, 1))
    )
    df = df.withColumn(
        "_b", strip(F.when(F.col("_q"), F.regexp_extract("_t", ENVELOPE, 3)).otherwise(F.regexp_extract("_t", PREFIX, 2)))
    )
    bare = (F.col("_s") != "") & (F.col("_b").rlike(BARE) | F.col("_b").rlike(BARE_THUMB))
    df = df.withColumn("_bare", bare)
    exact = F.lower(F.trim("_s")) == who
    ok = F.when(F.col("_q") | F.col("_bare"), exact).otherwise(F.startswith(F.lower("_t"), F.lit(f"[{who}]")))
    raw = F.coalesce(F.nullif(F.regexp_extract("_b", BARE, 1), F.lit("")), F.regexp_extract("_b", BARE_THUMB, 1))
    df = df.withColumn("_ok", ok)
    return (
        df.withColumn(
            "kind",
            F.when(F.col("_bare") & F.col("_ok"), "candidate")
            .when(F.col("_bare"), "sender_mismatch")
            .when(F.col("_ok") & F.col("_b").rlike(LEADING), "near_miss"),
        )
        .withColumn("vote", F.when(F.col("_bare"), R.normalise_vote(raw)))
        .withColumn("observed_sender", F.when(F.col("_q") | F.col("_bare"), F.trim("_s")).otherwise(""))
        .drop("_t", "_q", "_s", "_b", "_bare", "_ok")
    )


def verify_near(candidates: DataFrame, active: DataFrame, day: str = "day") -> DataFrame:
    """Candidates whose topic was active within a day before or after (equi-join on shifted days)."""
    near = active.select("topic", F.explode(F.array(F.date_sub("day", 1), F.col("day"), F.date_add("day", 1))).alias(day))
    return candidates.join(near.distinct(), ["topic", day], "left_semi")


def reply_report(classified: DataFrame, verified: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per topic: counts by kind, the newest verified vote and whether it should be recorded.

    Nothing is recorded when the feedback log already holds a tap of the same or a later day.
    """
    counts = classified.groupBy("topic").agg(
        F.count_if(F.col("kind") == "candidate").alias("candidates"),
        F.count_if(F.col("kind") == "near_miss").alias("near_misses"),
        F.count_if(F.col("kind") == "sender_mismatch").alias("sender_mismatches"),
    )
    newest = (
        verified.groupBy("topic")
        .agg(
            F.count("*").alias("verified"),
            F.max_by(F.struct("vote", "day"), F.struct("ts", "session_id", "idx")).alias("m"),
        )
        .select("topic", "verified", "m.vote", F.col("m.day").alias("vote_day"))
    )
    last = feedback.groupBy("topic").agg(F.max("day").alias("last_day"))
    return (
        counts.join(newest, "topic", "left")
        .join(last, "topic", "left")
        .withColumn("verified", F.coalesce("verified", F.lit(0)))
        .withColumn(
            "outcome",
            F.when(F.col("candidates") == 0, "no bare vote")
            .when(F.col("verified") == 0, "none verified")
            .when(F.col("last_day") >= F.col("vote_day"), "already recorded")
            .otherwise("record"),
        )
    )

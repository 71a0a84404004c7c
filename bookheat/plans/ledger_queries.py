"""Registered queries: ledgers, feedback, replies and calendar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.functions import rules as R
from bookheat.operators import ledger as L
from bookheat.operators import replies as RP
from bookheat.plans.oracle import define, with_ctes
from bookheat.plans.panel_queries import text
from bookheat.plans.registry import query
from bookheat.session import rounded as r
from bookheat.sources import events as E
from bookheat.sources import tables as T

TODAY = "2024-01-30"
NOW = "2024-01-29 17:00:00"
FIRST = "2024-01-08"

define(
    "ledger",
    """SELECT user_id AS channel, CASE event_type WHEN 'purchase' THEN 'daily_summary' WHEN 'signup' THEN 'weekly_scorecard' WHEN 'view' THEN 'alert_level_change' ELSE 'alert_emergency' END AS tier,
       CAST(ts - INTERVAL 5 HOUR AS DATE) AS et_date, strftime(ts - INTERVAL 5 HOUR, '%H:%M:%S') AS et_time, ts AS utc, event_id % 3 <> 0 AS scheduled, event_id AS message_id,
       CASE WHEN event_id % 11 <> 0 THEN CAST(ts + (event_id % 7 * 5) * INTERVAL 1 MINUTE - INTERVAL 5 HOUR AS DATE) END AS server_day,
       event_id % 5 <> 0 AND event_id % 13 <> 0 AS carries, 'Brand#' || (event_id % 9 + 1) AS p0, 'Brand#' || ((event_id + 3) % 9 + 1) AS p1
FROM events WHERE event_type <> 'click'""",
)
define(
    "feedback",
    """SELECT user_id AS channel, CASE WHEN value > 20 THEN 'yes' ELSE 'no' END AS vote, ts AS tapped_at,
       CAST(ts - INTERVAL 5 HOUR AS DATE) AS vote_day, strftime(ts - INTERVAL 5 HOUR, '%H:%M:%S') AS vote_time FROM events WHERE event_type = 'click'""",
)
define("channels", "SELECT DISTINCT channel FROM ledger", "ledger")


@query(
    "has_scheduled_summary",
    with_ctes(
        ["ledger", "feedback"],
        """SELECT DISTINCT channel, CAST(vote_day AS VARCHAR) AS et_date FROM feedback f WHERE EXISTS (
SELECT 1 FROM ledger l WHERE l.channel = f.channel AND l.et_date = f.vote_day AND tier = 'daily_summary' AND scheduled)""",
    ),
)
def has_scheduled_summary(spark, sf):
    days = E.feedback(spark, sf).select("channel", R.market_day(F.col("tapped_at")).alias("et_date")).distinct()
    return L.has_scheduled_summary(E.ledger(spark, sf), days).select("channel", text("et_date"))


define(
    "runs",
    """SELECT channel, et_date, message_id, et_date - CAST(row_number() OVER (PARTITION BY channel ORDER BY et_date) AS INTEGER) AS island
FROM (SELECT channel, et_date, arg_max(message_id, (utc, message_id)) AS message_id FROM ledger WHERE tier = 'daily_summary' AND scheduled GROUP BY 1, 2)""",
    "ledger",
)
define(
    "streak",
    """SELECT channel, count(*) FILTER (island = li) AS streak, max(et_date) AS last_date, count(*) AS delivered_days, min(et_date) FILTER (island = li) AS first_date,
       string_agg(CAST(message_id AS VARCHAR), ',' ORDER BY et_date) FILTER (island = li) AS message_ids, max(et_date) >= DATE '2024-01-29' AS live
FROM (SELECT *, max(island) OVER (PARTITION BY channel) AS li FROM runs) GROUP BY 1""",
    "runs",
)
define(
    "corro",
    """SELECT channel, tier, count(server_day) AS checked, count(*) FILTER (server_day = et_date) AS corroborated, count(*) FILTER (server_day <> et_date) AS mismatched, count(*) FILTER (server_day IS NULL) AS missing
FROM ledger GROUP BY 1, 2""",
    "ledger",
)


@query(
    "daily_streak",
    with_ctes(
        "streak",
        "SELECT channel, streak, CAST(last_date AS VARCHAR) AS last_date, delivered_days, message_ids, live FROM streak",
    ),
)
def daily_streak(spark, sf):
    return L.daily_streak(E.ledger(spark, sf), F.to_date(F.lit(TODAY))).select(
        "channel", "streak", text("last_date"), "delivered_days", "message_ids", "live"
    )


@query(
    "corroboration",
    with_ctes(
        "corro",
        "SELECT channel, tier, checked, CAST(corroborated AS BIGINT) AS corroborated, CAST(mismatched AS BIGINT) AS mismatched, CAST(missing AS BIGINT) AS missing FROM corro",
    ),
)
def corroboration(spark, sf):
    return L.corroborate(E.ledger(spark, sf)).select("channel", "tier", "checked", "corroborated", "mismatched", "missing")


@query(
    "clock_mismatches",
    with_ctes("ledger", "SELECT channel, tier, message_id, CAST(server_day AS VARCHAR) AS server_date FROM ledger WHERE server_day <> et_date"),
)
def clock_mismatches(spark, sf):
    return L.clock_mismatches(E.ledger(spark, sf)).select("channel", "tier", "message_id", text("server_date"))


_STREAK_SQL = """, v AS (SELECT c.channel, coalesce(s.streak, 0) AS streak, coalesce(s.live, false) AS live, s.first_date, s.last_date, s.message_ids,
     coalesce(o.corroborated, 0) AS co, coalesce(o.missing, 0) AS mi, coalesce(o.mismatched, 0) AS mm
     FROM channels c LEFT JOIN streak s ON s.channel = c.channel LEFT JOIN (SELECT * FROM corro WHERE tier = 'daily_summary') o ON o.channel = c.channel),
sv AS (SELECT *, concat_ws('; ', CASE WHEN streak < 7 THEN 'streak ' || streak || '/7' END, CASE WHEN NOT live THEN 'streak not live' END, CASE WHEN mm > 0 THEN mm || ' clock mismatch(es)' END) AS reasons FROM v)"""


@query(
    "streak_verdict",
    with_ctes(
        ["channels", "streak", "corro"],
        _STREAK_SQL
        + """
SELECT channel, streak, live, greatest(7 - streak, 0) AS days_remaining, reasons, reasons = '' AS met,
       coalesce(CAST(first_date AS VARCHAR) || '..' || CAST(last_date AS VARCHAR) || ' messages ' || message_ids || '; corroborated=' || co || ' missing=' || mi || ' mismatched=' || mm, '') AS evidence FROM sv""",
    ),
)
def streak_verdict(spark, sf):
    return L.streak_verdict(E.ledger(spark, sf), F.to_date(F.lit(TODAY)))


_WEEKLY_SQL = """wv AS (SELECT *, CASE WHEN due = 0 THEN 'no scheduled weekly_scorecard in week of 2024-01-29' END AS r1, CASE WHEN mm > 0 THEN mm || ' clock mismatch(es)' END AS r2
FROM (SELECT c.channel, count(l.message_id) AS posts, count(*) FILTER (isoyear(l.et_date) = 2024 AND week(l.et_date) = 5) AS due,
             count(*) FILTER (isoyear(l.et_date) = 2024 AND week(l.et_date) = 5 AND server_day <> et_date) AS mm, arg_max(l.message_id, (l.et_date, l.message_id)) AS last_id
      FROM channels c LEFT JOIN ledger l ON l.channel = c.channel AND l.tier = 'weekly_scorecard' AND l.scheduled GROUP BY 1))"""


@query(
    "weekly_verdict",
    with_ctes(
        ["channels", "ledger"],
        ", " + _WEEKLY_SQL + """ SELECT channel, '2024-01-29' AS due_monday, posts AS weekly_posts, due > 0 AS delivered, mm AS mismatched, last_id AS last_message_id,
       concat_ws('; ', r1, r2) AS reasons, r1 IS NULL AND r2 IS NULL AS met FROM wv""",
    ),
)
def weekly_verdict(spark, sf):
    v = L.weekly_verdict(E.ledger(spark, sf), F.to_timestamp(F.lit(NOW)), F.to_date(F.lit(FIRST)))
    return v.select("channel", text("due_monday"), "weekly_posts", "delivered", "mismatched", "last_message_id", "reasons", "met")


define(
    "fb_last",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY tapped_at DESC, vote DESC) AS rn FROM feedback) WHERE rn = 1",
    "feedback",
)
define(
    "summaries",
    f"SELECT * FROM ledger WHERE tier = 'daily_summary' AND scheduled AND et_date >= DATE '{FIRST}'",
    "ledger",
)
_PAYLOAD_SQL = """, surf AS (SELECT f.channel, arg_max(s.message_id, (s.et_date, s.et_time, s.message_id)) AS mid FROM fb_last f JOIN summaries s ON s.channel = f.channel AND s.carries
     AND (s.et_date > f.vote_day OR (s.et_date = f.vote_day AND s.et_time > f.vote_time)) GROUP BY 1),
agg AS (SELECT channel, count(*) AS n, count_if(carries) AS k, arg_max(list_sort(list_distinct([upper(p0), upper(p1)])), (utc, message_id)) FILTER (carries) AS book FROM summaries GROUP BY 1),
want AS (SELECT channel, list_sort(list_distinct(list(upper(p0)))) AS w FROM ledger GROUP BY 1),
pv AS (SELECT c.channel, coalesce(a.n, 0) AS n, coalesce(a.k, 0) AS k, a.book = w.w AS bm, f.vote, f.vote_day, s.mid
       FROM channels c LEFT JOIN agg a ON a.channel = c.channel LEFT JOIN want w ON w.channel = c.channel LEFT JOIN fb_last f ON f.channel = c.channel LEFT JOIN surf s ON s.channel = c.channel)"""
_PAYLOAD_REASONS = """concat_ws('; ', CASE WHEN n = 0 THEN 'no scheduled daily summaries since 2024-01-08 yet' END, CASE WHEN n - k > 0 THEN (n - k) || ' scheduled summaries missing payload' END,
  {book} CASE WHEN vote IS NULL THEN 'waiting for the first YES/NO tap' END, CASE WHEN vote IS NOT NULL AND mid IS NULL THEN 'tap ' || vote || ' ' || vote_day || ' not yet surfaced in a summary' END)"""
_R_BOOK = _PAYLOAD_REASONS.format(
    book="CASE WHEN NOT coalesce(bm, true) THEN 'latest summary''s scored book differs from the positions' END,"
)


@query(
    "payload_verdict",
    with_ctes(
        ["channels", "summaries", "fb_last"],
        _PAYLOAD_SQL
        + f""" SELECT channel, n AS expected, CAST(k AS BIGINT) AS with_payload, bm AS book_match, vote, mid AS surfaced_message_id, {_R_BOOK} AS reasons, {_R_BOOK} = '' AS met FROM pv""",
    ),
)
def payload_verdict(spark, sf):
    led = E.ledger(spark, sf)
    # the expected book of a channel: the first symbol of all its events
    want = led.select("channel", F.concat(F.lit("Brand#"), (F.col("message_id") % 9 + 1).cast("string")).alias("symbol"))
    return L.payload_verdict(led, E.feedback(spark, sf), F.to_date(F.lit(FIRST)), want)


@query(
    "streak_report",
    with_ctes(
        ["channels", "streak", "corro", "ledger", "summaries", "fb_last"],
        _STREAK_SQL
        + ", "
        + _WEEKLY_SQL
        + _PAYLOAD_SQL
        + f""" SELECT sv.channel, sv.streak, sv.reasons = '' AS streak_met, r1 IS NULL AND r2 IS NULL AS weekly_met, {_PAYLOAD_REASONS.format(book='')} = '' AS payload_met, q.records
FROM sv JOIN wv ON wv.channel = sv.channel JOIN pv ON pv.channel = sv.channel JOIN (SELECT channel, count(*) AS records FROM ledger GROUP BY 1) q ON q.channel = sv.channel""",
    ),
)
def streak_report(spark, sf):
    return L.streak_report(
        E.ledger(spark, sf), E.feedback(spark, sf), F.to_date(F.lit(TODAY)), F.to_timestamp(F.lit(NOW)), F.to_date(F.lit(FIRST))
    )


@query(
    "last_feedback",
    with_ctes("fb_last", "SELECT channel, vote, CAST(vote_day AS VARCHAR) AS et_date FROM fb_last"),
)
def last_feedback(spark, sf):
    fb = L.last_per_key(E.feedback(spark, sf), ["channel"], ["tapped_at", "vote"])
    return fb.select("channel", "vote", R.market_day(F.col("tapped_at")).cast("string").alias("et_date"))


@query(
    "feedback_surfaced",
    with_ctes(
        ["channels", "summaries", "fb_last"],
        _PAYLOAD_SQL + " SELECT f.channel, f.vote, s.mid AS surfaced_message_id FROM fb_last f LEFT JOIN surf s ON s.channel = f.channel",
    ),
)
def feedback_surfaced(spark, sf):
    led = E.ledger(spark, sf).filter(
        (F.col("tier") == C.SUMMARY_TIER) & F.col("scheduled") & (F.col("et_date") >= F.lit(FIRST).cast("date"))
        & F.col("positions").isNotNull() & (F.trim("action") != "")
    )
    return L.surfaced_feedback(led, E.feedback(spark, sf)).select("channel", "vote", "surfaced_message_id")


@query(
    "alert_history",
    with_ctes(
        "ledger",
        """SELECT channel, message_id FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY utc DESC, message_id DESC) AS rn FROM ledger WHERE starts_with(tier, 'alert_')) WHERE rn <= 100""",
    ),
)
def alert_history(spark, sf):
    alerts = E.ledger(spark, sf).filter(F.startswith("tier", F.lit("alert_")))
    return L.last_n(alerts, ["channel"], ["utc", "message_id"], 100).select("channel", "message_id")


@query(
    "cooldown_status",
    with_ctes(
        "ledger",
        """SELECT channel, tier, m AS cooldown_minutes, floor((greatest(m * 60 - (epoch(TIMESTAMP '2024-01-30 23:59:00') - floor(epoch(u))), 0) + 3) / 6) / 10 AS remaining_minutes,
       greatest(m - (epoch(TIMESTAMP '2024-01-30 23:59:00') - floor(epoch(u))) / 60, 0) > 0 AS on_cooldown
FROM (SELECT channel, tier, max(utc) AS u, CAST(CASE tier WHEN 'daily_summary' THEN 1440 WHEN 'alert_emergency' THEN 360 WHEN 'alert_level_change' THEN 30 WHEN 'alert_regime_shift' THEN 15 ELSE 60 END AS DOUBLE) AS m FROM ledger GROUP BY 1, 2)""",
    ),
)
def cooldown_status(spark, sf):
    """Minutes left, to tenths; half a tenth goes up, on whole seconds so that no binary fraction decides."""
    return L.cooldown_status(E.ledger(spark, sf), F.to_timestamp(F.lit("2024-01-30 23:59:00"))).select(
        "channel", "tier", "cooldown_minutes", (F.floor((F.round(F.col("remaining_minutes") * 60) + 3) / 6) / 10).alias("remaining_minutes"), "on_cooldown"
    )


@query(
    "tier_counts",
    with_ctes("ledger", "SELECT channel, tier, CAST(et_date AS VARCHAR) AS et_date, count(*) AS sent FROM ledger GROUP BY ALL"),
)
def tier_counts(spark, sf):
    return L.tier_counts(E.ledger(spark, sf)).select("channel", "tier", text("et_date"), "sent")


@query(
    "calendar_rules",
    """SELECT event_id, CAST(CAST(lt AS DATE) AS VARCHAR) AS et_day, strftime(lt, '%H:%M:%S') AS et_time, CAST(isoyear(lt) AS INTEGER) AS iso_year, CAST(week(lt) AS INTEGER) AS iso_week,
       CAST(CAST(date_trunc('week', lt) AS DATE) - CASE WHEN isodow(lt) = 1 AND strftime(lt, '%H:%M') < '16:30' THEN 7 ELSE 0 END AS VARCHAR) AS due_monday, isodow(lt) = 1 AS weekly_slot
FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS lt FROM events)""",
)
def calendar_rules(spark, sf):
    ts = F.col("ts").cast("timestamp")
    local = F.from_utc_timestamp(ts, C.MARKET_ZONE)
    year, week = R.iso_week(F.to_date(local))
    return T.table(spark, sf, "events").select(
        "event_id", R.market_day(ts).cast("string").alias("et_day"), R.market_time(ts).alias("et_time"),
        year.alias("iso_year"), week.alias("iso_week"), R.due_monday(local).cast("string").alias("due_monday"),
        R.is_weekly_slot(F.to_date(local)).alias("weekly_slot"),
    )


# -- replies -------------------------------------------------------------------
_NL = "\n"
define(
    "messages",
    f"""SELECT conv_id AS session_id, turn AS idx, role, conv_id % 10 AS topic, DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS day,
  CASE length(text) % 6 WHEN 0 THEN '[' || role || '] [Replying to: "' || text || '"]{_NL}{_NL}Yes.' WHEN 1 THEN '[' || role || '] no ' || text
       WHEN 2 THEN '[' || role || '] [Replying to: "' || text || ' [x]"]{_NL}{_NL}👍🏽' WHEN 3 THEN '[other] [Replying to: "' || text || '"] NO!'
       WHEN 4 THEN '[' || role || '] [Replying to: "' || text || '"] yes ' || text ELSE text END AS content
FROM conversations""",
)
_ENV = r"(?s)^\[([^\]]+)\]\s*\[Replying to:(.*)\](.+)$"
_PRE = r"(?s)^\[([^\]]+)\]\s*(.*)$"
_BARE = r"(?i)^(yes|no)[\s.!]*$"
_THUMB = r"^(\x{1F44D}|\x{1F44E})[\x{FE0F}\x{1F3FB}-\x{1F3FF}\s.!]*$"
_LEAD = r"(?i)^((yes|no)\b|\x{1F44D}|\x{1F44E})"
define(
    "classified",
    f"""SELECT *, CASE WHEN bare AND ok THEN 'candidate' WHEN bare THEN 'sender_mismatch' WHEN ok AND regexp_matches(b, '{_LEAD}') THEN 'near_miss' END AS kind,
       CASE WHEN bare THEN CASE WHEN regexp_matches(b, '(?i)^yes|^\\x{{1F44D}}') THEN 'yes' ELSE 'no' END END AS vote, CASE WHEN q OR bare THEN trim(s) ELSE '' END AS observed_sender
FROM (SELECT *, CASE WHEN q OR bare THEN lower(trim(s)) = 'user' ELSE starts_with(lower(t), '[user]') END AS ok FROM (
  SELECT *, s <> '' AND (regexp_matches(b, '{_BARE}') OR regexp_matches(b, '{_THUMB}')) AS bare FROM (
    SELECT *, CASE WHEN q THEN regexp_extract(t, '{_ENV}', 1) ELSE regexp_extract(t, '{_PRE}', 1) END AS s,
           regexp_replace(CASE WHEN q THEN regexp_extract(t, '{_ENV}', 3) ELSE regexp_extract(t, '{_PRE}', 2) END, '^\\s+|\\s+$', '', 'g') AS b
    FROM (SELECT *, regexp_matches(t, '{_ENV}') AS q FROM (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS t FROM messages)))))""",
    "messages",
)


def classified(spark, sf):
    return RP.classify_replies(E.messages(spark, sf), "content", "user")


@query(
    "classify_replies",
    with_ctes("classified", "SELECT session_id, idx, kind, vote, observed_sender FROM classified"),
)
def classify_replies(spark, sf):
    return classified(spark, sf).select("session_id", "idx", "kind", "vote", "observed_sender")


@query(
    "normalise_vote",
    with_ctes(
        "messages",
        r"""SELECT DISTINCT v AS raw, CASE lower(v) WHEN 'yes' THEN 'yes' WHEN 'no' THEN 'no' WHEN '👍' THEN 'yes' WHEN '👍🏽' THEN 'yes' WHEN '👎' THEN 'no' END AS vote
FROM (SELECT regexp_extract(content, '(\S+?)[.!]*\s*$', 1) AS v FROM messages)""",
    ),
)
def normalise_vote(spark, sf):
    """The last word of every message, read as a vote."""
    last = E.messages(spark, sf).select(F.regexp_extract("content", r"(\S+?)[.!]*\s*$", 1).alias("raw")).distinct()
    return last.select("raw", R.normalise_vote(F.col("raw")).alias("vote"))


# topic activity: days with purchase events of ten user groups
define("activity", "SELECT DISTINCT user_id % 10 AS topic, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase' AND value > 60")
define("tapped", "SELECT user_id % 10 AS topic, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click' AND value > 150")
define(
    "verified",
    "SELECT * FROM classified c WHERE kind = 'candidate' AND EXISTS (SELECT 1 FROM activity a WHERE a.topic = c.topic AND a.day BETWEEN c.day - 1 AND c.day + 1)",
    "classified",
    "activity",
)


def _activity(spark, sf, kind, floor):
    return (
        T.table(spark, sf, "events")
        .filter((F.col("event_type") == kind) & (F.col("value") > floor))
        .select((F.col("user_id") % 10).alias("topic"), F.to_date("ts").alias("day"))
    )


def verified(spark, sf):
    cand = classified(spark, sf).filter("kind = 'candidate'")
    return RP.verify_near(cand, _activity(spark, sf, "purchase", 60).distinct())


@query("verified_replies", with_ctes("verified", "SELECT session_id, idx, vote FROM verified"))
def verified_replies(spark, sf):
    return verified(spark, sf).select("session_id", "idx", "vote")


@query(
    "reply_report",
    with_ctes(
        ["classified", "verified", "tapped"],
        """SELECT c.topic, CAST(candidates AS BIGINT) AS candidates, CAST(near_misses AS BIGINT) AS near_misses, CAST(sender_mismatches AS BIGINT) AS sender_mismatches, coalesce(v.n, 0) AS verified, v.vote,
       CASE WHEN candidates = 0 THEN 'no bare vote' WHEN coalesce(v.n, 0) = 0 THEN 'none verified' WHEN t.last_day >= v.day THEN 'already recorded' ELSE 'record' END AS outcome
FROM (SELECT topic, count_if(kind = 'candidate') AS candidates, count_if(kind = 'near_miss') AS near_misses, count_if(kind = 'sender_mismatch') AS sender_mismatches FROM classified GROUP BY 1) c
LEFT JOIN (SELECT topic, count(*) AS n, arg_max(vote, (day, session_id, idx)) AS vote, max(day) AS day FROM verified GROUP BY 1) v ON v.topic = c.topic
LEFT JOIN (SELECT topic, max(day) AS last_day FROM tapped GROUP BY 1) t ON t.topic = c.topic""",
    ),
)
def reply_report(spark, sf):
    return RP.reply_report(classified(spark, sf), verified(spark, sf), _activity(spark, sf, "click", 150)).drop("vote_day", "last_day")

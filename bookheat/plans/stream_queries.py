"""Registered queries: streaming jobs run over all available input."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bookheat.functions import rules as R
from bookheat.plans import ledger_queries  # noqa: F401  (defines the ledger CTEs)
from bookheat.plans.heat_sql import level_case
from bookheat.plans.oracle import define, with_ctes
from bookheat.plans.panel_queries import text
from bookheat.plans.registry import query
from bookheat.session import rounded as r
from bookheat.sources import events as E
from bookheat.sources import tables as T
from bookheat.streaming import book_log as L
from bookheat.streaming import jobs as J
from bookheat.streaming.refresh import heat_refresh


def tick_stream(spark, sf):
    return J.read_stream(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.lit(1.0).alias("size"), F.col("event_id").alias("seq"),
    )


@query(
    "stream_bars",
    with_ctes(
        "bars",
        """SELECT symbol, strftime(bar_start, '%Y-%m-%d') AS bar_start, open, high, low, close, CAST(volume AS DOUBLE) AS volume, round(vwap, 6) + 0.0 AS vwap FROM bars
WHERE bar_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    ),
)
def stream_bars(spark, sf):
    """Closed bars only: a window is written once, when the watermark has passed its end."""
    path = J.run_available(J.bars(tick_stream(spark, sf), "1 day", "1 hour"), "append", "bars")
    return spark.read.parquet(f"{path}/batch=*").select(
        "symbol", F.date_format("bar_start", "yyyy-MM-dd").alias("bar_start"), "open", "high", "low", "close", "volume",
        r("vwap").alias("vwap"),
    )


@query(
    "stream_trades",
    "SELECT event_type AS symbol, event_id AS seq, value AS price FROM events WHERE event_type IN ('click', 'purchase')",
)
def stream_trades(spark, sf):
    path = J.run_available(J.trades_of(tick_stream(spark, sf), ["click", "purchase"]), "append", "trades")
    return spark.read.parquet(f"{path}/batch=*").select("symbol", "seq", "price")


@query(
    "stream_first_per_day",
    "SELECT DISTINCT user_id AS book_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events",
)
def stream_first_per_day(spark, sf):
    rows = J.read_stream(spark, sf, "events").select(
        F.col("user_id").alias("book_id"), F.to_date("ts").alias("date"), F.col("value").alias("score")
    )
    path = J.run_available(J.first_per_date(rows, ["book_id"], "2 days"), "append", "first")
    return spark.read.parquet(f"{path}/batch=*").select("book_id", text("date"))


def ledger_stream(spark, sf):
    eid, utc = F.col("event_id"), F.col("ts").cast("timestamp")
    return J.read_stream(spark, sf, "events").filter("event_type <> 'click'").select(
        F.col("user_id").alias("channel"), R.lookup(F.col("event_type"), E.TIERS).alias("tier"), utc.alias("utc"),
        R.market_day(utc).alias("et_date"), (eid % 3 != 0).alias("scheduled"), eid.alias("message_id"),
    )


@query(
    "stream_one_summary",
    with_ctes(
        "ledger",
        "SELECT DISTINCT channel, CAST(et_date AS VARCHAR) AS et_date FROM ledger WHERE tier = 'daily_summary' AND scheduled",
    ),
)
def stream_one_summary(spark, sf):
    path = J.run_available(J.one_scheduled_summary(ledger_stream(spark, sf), "2 days"), "append", "slots")
    return spark.read.parquet(f"{path}/batch=*").select("channel", text("et_date"))


@query(
    "stream_tier_counts",
    with_ctes(
        "ledger",
        """SELECT channel, tier, CAST(CAST(utc AS DATE) AS VARCHAR) AS day, count(*) AS sent FROM ledger
WHERE CAST(utc AS DATE) + INTERVAL 1 DAY <= (SELECT max(utc) - INTERVAL 1 DAY FROM ledger) GROUP BY ALL""",
    ),
)
def stream_tier_counts(spark, sf):
    """Counts of the days that the watermark has closed."""
    path = J.run_available(J.tier_counts(ledger_stream(spark, sf), "1 day"), "append", "counts")
    return spark.read.parquet(f"{path}/batch=*").select("channel", "tier", F.to_date("day").cast("string").alias("day"), "sent")


# -- alerts -------------------------------------------------------------------
define(
    "readings",
    f"""SELECT user_id AS book_id, ts, event_id AS seq, {level_case('least(value / 60, 1)')} AS level,
       CASE WHEN event_type IN ('click', 'view') THEN 'normal' WHEN event_type = 'error' THEN 'crisis' WHEN event_type = 'signup' THEN 'low_vol' ELSE 'unknown' END AS regime FROM events""",
)
define(
    "alert_cand",
    """SELECT book_id, ts, seq, tier, CAST(CASE tier WHEN 'emergency' THEN 360 WHEN 'level_change' THEN 30 ELSE 15 END AS INTEGER) AS cd,
       row_number() OVER (PARTITION BY book_id, tier ORDER BY ts, seq) AS rn FROM (
  SELECT book_id, ts, seq, unnest([CASE WHEN level = 'emergency' THEN 'emergency' END, CASE WHEN level <> pl THEN 'level_change' END,
         CASE WHEN regime <> pr AND regime <> 'unknown' THEN 'regime_shift' END]) AS tier
  FROM (SELECT *, lag(level) OVER w AS pl, lag(regime) OVER w AS pr FROM readings WINDOW w AS (PARTITION BY book_id ORDER BY ts, seq))) WHERE tier IS NOT NULL""",
    "readings",
)
define(
    "alert_next",
    """SELECT a.book_id, a.tier, a.rn, min(b.rn) AS nxt FROM alert_cand a LEFT JOIN alert_cand b ON b.book_id = a.book_id AND b.tier = a.tier
AND b.rn > a.rn AND b.ts >= a.ts + a.cd * INTERVAL 1 MINUTE GROUP BY 1, 2, 3""",
    "alert_cand",
)
define(
    "alerts",
    """WITH RECURSIVE chain(book_id, tier, rn) AS (SELECT book_id, tier, CAST(1 AS BIGINT) FROM alert_next WHERE rn = 1
UNION ALL SELECT n.book_id, n.tier, n.nxt FROM chain c JOIN alert_next n ON n.book_id = c.book_id AND n.tier = c.tier AND n.rn = c.rn WHERE n.nxt IS NOT NULL)
SELECT a.book_id, a.seq, a.tier FROM chain JOIN alert_cand a USING (book_id, tier, rn)""",
    "alert_cand",
    "alert_next",
)
_ALERT_SQL = with_ctes("alerts", "SELECT book_id, seq, tier FROM alerts")
_REGIME = {"click": "normal", "view": "normal", "error": "crisis", "signup": "low_vol"}


def readings(events):
    return events.select(
        F.col("user_id").alias("book_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        R.classify_heat(F.least(F.col("value") / 60, F.lit(1.0))).alias("level"),
        R.lookup(F.col("event_type"), _REGIME, "unknown").alias("regime"),
    )


@query("alert_cooldown", _ALERT_SQL)
def alert_cooldown(spark, sf):
    return J.alert_batch(readings(T.table(spark, sf, "events"))).select("book_id", "seq", "tier")


@query(
    "stream_alerts",
    with_ctes("alerts", "SELECT a.book_id, a.seq, a.tier FROM alerts a JOIN events e ON e.event_id = a.seq WHERE e.ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"),
)
def stream_alerts(spark, sf):
    """Alerts of the readings that the watermark has passed, an hour behind the newest."""
    stream = J.alert_stream(readings(J.read_stream(spark, sf, "events")))
    path = J.run_available(stream, "append", "alerts")
    return spark.read.schema(J.ALERT_OUT).parquet(f"{path}/batch=*").select("book_id", "seq", "tier")


@query(
    "should_alert",
    with_ctes(
        "readings",
        """SELECT book_id, seq, CASE WHEN pl IS NULL THEN level <> 'cool' ELSE level <> pl END AS alert
FROM (SELECT *, lag(level) OVER (PARTITION BY book_id ORDER BY ts, seq) AS pl FROM readings)""",
    ),
)
def should_alert(spark, sf):
    return J.should_alert(readings(T.table(spark, sf, "events"))).select("book_id", "seq", "alert")


# -- stateful tables -------------------------------------------------------------
@query(
    "stream_book_updates",
    with_ctes(
        ["books_f", "books_o"],
        """, ok AS (SELECT book_id FROM books_o WHERE symbol <> 'Brand#7' GROUP BY 1 HAVING abs(sum(weight) - 1) <= 0.05)
SELECT book_id, symbol, round(weight, 6) + 0.0 AS weight FROM books_o WHERE symbol <> 'Brand#7' AND book_id IN (SELECT book_id FROM ok)
UNION ALL SELECT book_id, symbol, round(weight, 6) + 0.0 FROM books_f WHERE book_id NOT IN (SELECT book_id FROM ok)""",
    ),
)
def stream_book_updates(spark, sf):
    cand = T.books_by_status(spark, sf, "O").filter("symbol <> 'Brand#7'").select("book_id", "symbol", "weight")
    start = T.books_by_status(spark, sf, "F").select("book_id", "symbol", "weight")
    size = F.count("*").over(Window.partitionBy("book_id"))
    cand = cand.withColumn("version", F.lit(1)).withColumn("positions", size)
    # dealt by symbol, so that the rows of a book arrive in several files and micro-batches
    path = L.book_updates(J.stream_of(cand.repartition(4, "symbol"), "candidates", 1), start, buckets=4)
    return L.current_books(spark, path, start, 4).select("book_id", "symbol", r("weight").alias("weight"))


@query(
    "stream_heat_refresh",
    with_ctes("heat", "SELECT book_id, CAST(date AS VARCHAR) AS date, round(score, 10) + 0.0 AS score, level FROM heat"),
)
def stream_heat_refresh(spark, sf):
    path = heat_refresh(J.stream_of(T.closes(spark, sf), "new-closes"), T.reference_book(spark), T.factor_dim(spark))
    return spark.read.parquet(f"{path}/batch=*").select("book_id", text("date"), r("score", 10).alias("score"), "level")

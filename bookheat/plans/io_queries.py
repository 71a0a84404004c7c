"""Registered queries: readers, writers, report texts and the latest-state view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.functions import rules as R
from bookheat.operators import ledger as LG
from bookheat.operators import scorecard as K
from bookheat.operators import signals as S
from bookheat.operators import texts as TX
from bookheat.plans import action_queries as AQ
from bookheat.plans import ledger_queries  # noqa: F401  (defines the ledger CTEs)
from bookheat.plans import heat_queries as HQ
from bookheat.plans import signal_queries as SQ
from bookheat.plans.model_queries import MO
from bookheat.plans.oracle import with_ctes
from bookheat.plans.panel_queries import text
from bookheat.plans.registry import query
from bookheat.plans.signal_queries import features
from bookheat.session import rounded as r
from bookheat.session import scratch_path, staged
from bookheat.sources import events as E
from bookheat.sources import io as IO
from bookheat.sources import tables as T


@query(
    "heat_history",
    with_ctes(
        "heat",
        """SELECT CAST(date AS VARCHAR) AS date, round(score, 10) + 0.0 AS score, level FROM heat
WHERE date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' ORDER BY date DESC LIMIT 50""",
    ),
)
def heat_history(spark, sf):
    """Append heat to the day-partitioned table, then read a range newest first."""
    path = scratch_path(spark, "heat-table")
    IO.append_heat(HQ.heat(spark, sf).select("book_id", "date", "score", "level"), path)
    h = IO.heat_history(spark, path, F.to_date(F.lit("1998-01-01")), F.to_date(F.lit("2000-12-31")), 50)
    return h.select(text("date"), r("score", 10).alias("score"), "level")


@query(
    "ledger_round_trip",
    with_ctes(
        "ledger",
        """SELECT channel, tier, message_id, CAST(et_date AS VARCHAR) AS et_date, scheduled, server_day IS NOT NULL AS has_server FROM ledger
WHERE message_id % 10 <> 3""",
    ),
)
def ledger_round_trip(spark, sf):
    """Every tenth line is damaged on the way; the reader keeps exactly the whole ones."""
    path = scratch_path(spark, "ledger")
    line = F.to_json(F.struct("*"))
    broken = F.when(F.col("message_id") % 10 == 3, F.substr(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    E.ledger(spark, sf).select(broken.alias("value")).write.text(path)
    return IO.read_ledger(spark, path).select(
        "channel", "tier", "message_id", text("et_date"), "scheduled", F.col("server_ts").isNotNull().alias("has_server")
    )


@query(
    "ledger_append",
    with_ctes("ledger", "SELECT channel, count(*) * 2 AS records FROM ledger GROUP BY 1"),
)
def ledger_append(spark, sf):
    path = scratch_path(spark, "ledger")
    IO.append_ledger(E.ledger(spark, sf), path)
    IO.append_ledger(E.ledger(spark, sf), path)
    return IO.read_ledger(spark, path).groupBy("channel").agg(F.count("*").alias("records"))


@query(
    "explode_sessions",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, md5(text) AS digest
FROM conversations WHERE conv_id % 3 <> 0 AND DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) >= DATE '2024-01-10'""",
)
def explode_sessions(spark, sf):
    """Transcripts written as one JSON record per session, read back by platform and day."""
    path = scratch_path(spark, "sessions")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("conv_id") % 30).cast("int"))
    turns = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")),
    )
    (
        T.table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(turns.alias("messages"))
        .select(
            F.col("conv_id").cast("string").alias("session_id"),
            F.when(F.col("conv_id") % 3 != 0, "chat").otherwise("mail").alias("platform"),
            day.cast("timestamp").alias("session_start"),
            "messages",
        )
        .write.json(path)
    )
    m = IO.explode_sessions(spark, path, "chat", F.to_date(F.lit("2024-01-10")))
    return m.select("session_id", F.col("idx").cast("bigint").alias("idx"), "role", F.md5("content").alias("digest"))


@query(
    "load_calibration",
    with_ctes(
        "heat",
        "SELECT round(absorption_ratio, 5) + 0.0 AS ar, round(turbulence, 4) + 0.0 AS turb, round(inv_dr, 6) + 0.0 AS dr, round(factor_hhi, 6) + 0.0 AS hhi, round(avg_corr, 6) + 0.0 AS corr FROM heat",
    ),
)
def load_calibration(spark, sf):
    path = scratch_path(spark, "calibration")
    cols = ("absorption_ratio", "turbulence", "div_ratio", "factor_hhi", "avg_corr")
    HQ.heat(spark, sf).select("date", *cols).write.json(path)
    c = IO.load_calibration(spark, path, multiline=False)
    return c.select(r("ar", 5).alias("ar"), r("turb", 4).alias("turb"), *[r(n).alias(n) for n in ("dr", "hhi", "corr")])


@query(
    "parse_heat_history",
    """SELECT strftime(d, '%Y-%m-%d') AS date, v AS score FROM (
SELECT coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 1 THEN 'n/a' END AS TIMESTAMP), try_cast(CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)) AS d,
       coalesce(nullif(try_cast(CASE WHEN event_type = 'click' THEN '0.0' WHEN event_type = 'view' THEN 'bad' WHEN event_type = 'error' THEN CAST(value AS VARCHAR) END AS DOUBLE), 0), nullif(CASE WHEN event_type <> 'signup' THEN value END, 0)) AS v
FROM events) WHERE d IS NOT NULL AND v IS NOT NULL""",
)
def parse_heat_history(spark, sf):
    ts, eid, kind = F.col("ts"), F.col("event_id"), F.col("event_type")
    raw = T.table(spark, sf, "events").select(
        F.when(eid % 3 == 0, F.date_format(ts, "yyyy-MM-dd")).when(eid % 3 == 1, "n/a").alias("date"),
        F.when(eid % 7 != 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(kind == "click", "0.0").when(kind == "view", "bad").when(kind == "error", F.col("value").cast("string")).alias("score"),
        F.when(kind != "signup", F.col("value")).alias("heat_score"),
    )
    return IO.parse_heat_history(raw).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "score")


@query(
    "wide_csv_returns",
    with_ctes(
        "rets",
        "SELECT CAST(date AS VARCHAR) AS date, symbol, round(simple, 6) + 0.0 AS ret FROM rets",
    ),
)
def wide_csv_returns(spark, sf):
    path = scratch_path(spark, "wide")
    names = list(T.ALL_SYMBOLS)
    wide = T.returns(spark, sf).groupBy("date").pivot("symbol", names).agg(F.first("simple"))
    wide.write.option("header", True).csv(path)
    return IO.wide_csv_returns(spark, path, names).select(text("date"), "symbol", r("ret").alias("ret"))


def result_tables(spark, sf):
    """All result tables of the replay: daily, crisis, signal and scorecard tables."""
    heat, crises, port, sig = HQ.heat(spark, sf), T.crises(spark), SQ.portfolio(spark, sf), SQ.signals(spark, sf)
    per_crisis = S.crisis_backtest(heat, port, crises)
    return {
        "heat": heat,
        "crowding": AQ.crowding(spark, sf),
        "crisis_summary": S.crisis_summary(heat, crises, C.THRESHOLDS),
        "crisis_backtest": per_crisis,
        "overall": S.backtest_overall(per_crisis, S.false_positive_share(heat, crises)),
        "signals": sig,
        "signal_metrics": S.signal_metrics(sig),
        "signal_strategy": S.signal_strategy(sig),
        "signal_stats": S.signal_stats(heat),
        "forward_returns": S.forward_returns_by_level(heat, port),
        "scorecard": K.scorecard(SQ._cards(spark, sf)[1], SQ.warned(spark, sf)),
    }


@query(
    "backtest_tables",
    with_ctes(
        ["heat", "crowd", "signals", "crises"],
        """SELECT 'heat' AS "table", count(*) AS n FROM heat UNION ALL SELECT 'crowding', count(*) FROM crowd UNION ALL SELECT 'signals', count(*) FROM signals
UNION ALL SELECT 'signal_metrics', count(DISTINCT signal) FROM signals UNION ALL SELECT 'signal_strategy', count(DISTINCT signal) FROM signals
UNION ALL SELECT 'crisis_summary', count(DISTINCT crisis) FROM crises JOIN heat ON date BETWEEN "start" - INTERVAL 45 DAY AND "end" + INTERVAL 30 DAY
UNION ALL SELECT 'overall', 1""",
    ),
)
def backtest_tables(spark, sf):
    """The replay's result tables committed as one version, read back and counted."""
    path = scratch_path(spark, "backtest")
    IO.commit_tables(result_tables(spark, sf), path)
    read = IO.committed_tables(spark, path)
    counted = ("heat", "crowding", "signals", "signal_metrics", "signal_strategy", "crisis_summary", "overall")
    counts = [read[n].groupBy(F.lit(n).alias("table")).agg(F.count("*").alias("n")) for n in counted]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("result_rows")
def result_rows(spark, sf):
    """Rows of every result table, as the manifest of their version has them."""
    path = scratch_path(spark, "results")
    version = IO.commit_tables(result_tables(spark, sf), path)
    return spark.read.schema(IO.MANIFEST).parquet(f"{path}/manifest/version={version}").select("table", "rows")


# -- texts -------------------------------------------------------------------
@query(
    "summary_action_line",
    with_ctes(
        ["recs", "books"],
        f"""SELECT b.book_id, coalesce(upper(r.urgency) || ': ' || r.action || ' ' || r.instrument || ' (' || r.why || ')', '{C.HOLD_NO_CHANGE}') AS action_line
FROM (SELECT DISTINCT book_id FROM books) b LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY priority) AS rn FROM recs WHERE action <> 'hedge') WHERE rn = 1) r ON r.book_id = b.book_id""",
    ),
)
def summary_action_line(spark, sf):
    return TX.summary_action_lines(T.books(spark, sf), AQ.recs(spark, sf))


def regime(spark, sf):
    return staged(spark, sf, "regime", lambda: MO.regimes(features(spark, sf)))


def _book_rows(spark, sf):
    """The newest heat row of every customer book: its own components and score."""
    return AQ.book_days(spark, sf).groupBy("book_id").agg(F.max_by(F.struct("*"), "date").alias("h")).select("h.*")


@query("daily_summary_text")
def daily_summary_text(spark, sf):
    from bookheat.operators import actions as ACT

    recs = AQ.recs_own(spark, sf)
    summary = ACT.recommendation_summary(recs, AQ.own_heat_of_books(spark, sf))
    fb = LG.last_per_key(E.feedback(spark, sf), ["channel"], ["tapped_at", "vote"]).select(
        F.col("channel").alias("book_id"), "vote", R.market_day(F.col("tapped_at")).alias("vote_day")
    )
    reg = regime(spark, sf).select(F.struct("regime", "confidence").alias("g")).scalar()
    rows = _book_rows(spark, sf)
    regimes = rows.select("book_id").withColumn("g", reg).select("book_id", "g.*")
    return TX.daily_summary(
        rows, regimes, AQ.attributed_own(spark, sf), recs, summary, fb, F.concat(F.col("date").cast("string"), F.lit(" 16:30 ET")),
        F.lit("primary"), F.lit(30.0),
    )


@query(
    "level_change_text",
    with_ctes(
        "heat",
        """, s AS (SELECT *, lag(level) OVER (ORDER BY date) AS prev FROM heat), v AS (SELECT *, CASE level WHEN 'cool' THEN 0 WHEN 'warm' THEN 1 WHEN 'hot' THEN 2 WHEN 'critical' THEN 3 ELSE 4 END AS a,
        CASE prev WHEN 'cool' THEN 0 WHEN 'warm' THEN 1 WHEN 'hot' THEN 2 WHEN 'critical' THEN 3 ELSE 4 END AS b FROM s WHERE prev <> level)
SELECT CAST(date AS VARCHAR) AS date, CASE WHEN a > b THEN 'UP' ELSE 'DOWN' END AS direction, upper(prev) || ' -> ' || upper(level) AS step FROM v""",
    ),
)
def level_change_text(spark, sf):
    t = TX.level_changes(HQ.heat(spark, sf))
    step = F.regexp_extract("text", r"([A-Z]+) -> \S+ ([A-Z]+)", 1), F.regexp_extract("text", r"([A-Z]+) -> \S+ ([A-Z]+)", 2)
    return t.select(text("date"), "direction", F.concat(step[0], F.lit(" -> "), step[1]).alias("step"))


@query("regime_shift_text")
def regime_shift_text(spark, sf):
    from bookheat.plans.stream_queries import readings
    from pyspark.sql import Window

    ev = readings(T.table(spark, sf, "events"))
    prev = F.lag("regime").over(Window.partitionBy("book_id").orderBy("ts", "seq"))
    changed = ev.withColumn("old", prev).filter("regime <> old and regime <> 'unknown'")
    return changed.select("book_id", "seq", TX.regime_shift(F.col("old"), F.col("regime"), F.lit(0.8)).alias("text"))


@query("emergency_text")
def emergency_text(spark, sf):
    from bookheat.plans.stream_queries import readings

    ev = T.table(spark, sf, "events")
    scored = readings(ev).withColumn("score", F.lit(1.0)).filter("level = 'emergency'")
    heat = LG.last_per_key(scored, ["book_id"], ["ts", "seq"])
    return TX.emergency(heat, AQ.attributed_own(spark, sf), AQ.recs_own(spark, sf), F.lit("16:30:00 UTC"))


@query(
    "portfolio_snapshot",
    with_ctes(
        ["heat", "crowd", "exposures"],
        """SELECT 'reference' AS book_id, CAST(h.date AS VARCHAR) AS date, round(h.score, 10) + 0.0 AS score, h.level, h.dominant_factor, h.top_pair, round(c.crowding_score, 6) + 0.0 AS crowding_score, c.crowding_level, e.factors
FROM (SELECT * FROM heat ORDER BY date DESC LIMIT 1) h JOIN crowd c ON c.t = h.t JOIN (SELECT t, string_agg(factor, ',' ORDER BY exposure_share DESC) AS factors FROM exposures GROUP BY 1) e ON e.t = h.t""",
    ),
)
def portfolio_snapshot(spark, sf):
    from bookheat.operators import factors as X

    def newest(df, name):
        return df.groupBy("book_id").agg(F.max_by(F.struct("*"), "t").alias(name))

    heat = newest(HQ.heat(spark, sf), "h")
    crowd = newest(AQ.crowding(spark, sf), "c")
    exp = X.aggregate_exposures(HQ.exposures(spark, sf), T.reference_book(spark)).groupBy("book_id", "t").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("exposure_share")).alias("s"), "factor"))), lambda e: e["factor"]
            ),
            ",",
        ).alias("factors")
    )
    return heat.join(crowd, "book_id").join(newest(exp, "e"), "book_id").select(
        "book_id", F.col("h.date").cast("string").alias("date"), r(F.col("h.score"), 10).alias("score"), "h.level",
        "h.dominant_factor", "h.top_pair", r(F.col("c.crowding_score")).alias("crowding_score"), "c.crowding_level", "e.factors",
    )


@query("customer_states")
def customer_states(spark, sf):
    """Positions, exposures, own heat, clusters, limits, attribution and advice of every customer book on one row each."""
    from bookheat.operators import actions as ACT
    from bookheat.operators import factors as X
    from bookheat.operators import metrics as M
    from bookheat.operators.snapshot import portfolio_states
    from bookheat.plans.graph_queries import community_lists

    def place(df):
        return T.by_book(spark, sf, df)

    # placed by book once, every list is made and joined where its rows lie
    packed = place(M.packed_books(T.packed_books(spark, sf)))
    attributed = AQ.attributed_own(spark, sf)
    states = portfolio_states(
        place(AQ.book_days(spark, sf)),
        limits=place(AQ._limits(spark, sf, AQ.own_heat_of_books(spark, sf))),
        positions=packed.withColumnRenamed("items", "positions"),
        factor_exposures=place(X.exposure_lists(HQ.latest_exposures(spark, sf), T.packed_books(spark, sf))),
        attribution=place(attributed.select("book_id", "heat_share", "symbol", "marginal_heat", "recommendation")),
        recommendations=ACT.recommendations(place(attributed)),
        clusters=place(community_lists(spark, sf)),
    )
    lists = ("positions", "factor_exposures", "attribution", "recommendations", "clusters")
    return states.select(
        "book_id", F.col("heat.date").cast("string").alias("date"), r(F.col("heat.score"), 10).alias("score"), "heat.level",
        r("correlation_avg").alias("correlation_avg"), F.to_json("throttle").alias("throttle"), *[F.to_json(c).alias(c) for c in lists],
    )


@query(
    "customer_state_lists",
    with_ctes(
        ["books", "lexposures"],
        """SELECT b.book_id, b.positions, e.exposures, b.largest, e.leading
FROM (SELECT book_id, count(*) AS positions, round(max(weight), 6) + 0.0 AS largest FROM books GROUP BY 1) b
LEFT JOIN (SELECT book_id, count(*) AS exposures, arg_max(factor, exposure_share) AS leading FROM lexposures GROUP BY 1) e USING (book_id)""",
    ),
)
def customer_state_lists(spark, sf):
    """Length and first entry of the position and exposure lists of every book's state."""
    from bookheat.operators import factors as X
    from bookheat.operators.snapshot import portfolio_states

    books = T.books(spark, sf)
    states = portfolio_states(AQ.book_days(spark, sf), positions=books, factor_exposures=X.aggregate_exposures(HQ.latest_exposures(spark, sf), books))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("bigint")).alias("exposures" if c == "factor_exposures" else c)
    return states.select("book_id", size("positions"), size("factor_exposures"), r(F.col("positions")[0]["weight"]).alias("largest"), F.col("factor_exposures")[0]["factor"].alias("leading"))

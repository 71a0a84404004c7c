"""Registered queries: signals, crises, statistics and the drawdown scorecard."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.operators import heat as H
from bookheat.operators import panel as P
from bookheat.operators import scorecard as K
from bookheat.operators import signals as S
from bookheat.plans import heat_queries as HQ
from bookheat.plans.action_queries import crowding
from bookheat.plans.oracle import define, with_ctes
from bookheat.plans.panel_queries import text
from bookheat.plans.registry import query
from bookheat.session import rounded as r
from bookheat.session import staged
from bookheat.sources import tables as T

VIX_LIMIT = 60.0


def portfolio(spark, sf):
    """Equal-weight return of the reference book: (date, ret)."""
    rets = T.returns(spark, sf).join(T.reference_book(spark), "symbol", "left_semi")
    return P.equal_weight_portfolio(rets).select("date", "ret")


def signals(spark, sf):
    def build():
        aligned = S.align(HQ.heat(spark, sf), portfolio(spark, sf), T.vix(spark, sf))
        return S.build_signals(aligned, vix_threshold=VIX_LIMIT, ma_window=20, corr_threshold=0.02)

    return staged(spark, sf, "signals", build)


define("port", "SELECT t, date, avg(simple) AS ret FROM rets JOIN refbook USING (symbol) GROUP BY 1, 2", "rets", "refbook")
define(
    "aligned",
    """SELECT h.date, h.score, h.avg_corr, p.ret, v.vix, exp(sum(ln(1 + p.ret)) OVER (ORDER BY h.date)) AS level
FROM heat h JOIN port p ON p.date = h.date JOIN vix v ON v.date = h.date""",
    "heat",
    "port",
    "vix",
)
define(
    "flags",
    """SELECT *, CAST(score >= 0.4636 AS INTEGER) AS f0, CAST(vix > 60 AS INTEGER) AS f1,
       CAST(coalesce(level < CASE WHEN count(*) OVER w = 20 THEN avg(level) OVER w END, false) AS INTEGER) AS f2,
       CAST(row_number() OVER (PARTITION BY year(date), month(date) ORDER BY date) = 1 AS INTEGER) AS f3,
       CAST(avg_corr > 0.02 AS INTEGER) AS f4
FROM aligned WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "aligned",
)
define(
    "signals",
    """SELECT date, ret, 'heat' AS signal, 0 AS ordinal, f0 AS fired FROM flags UNION ALL SELECT date, ret, 'vix', 1, f1 FROM flags
UNION ALL SELECT date, ret, 'moving_average', 2, f2 FROM flags WHERE (SELECT max(f2) FROM flags) = 1
UNION ALL SELECT date, ret, 'monthly', 3, f3 FROM flags UNION ALL SELECT date, ret, 'correlation', 4, f4 FROM flags""",
    "flags",
)
define(
    "sigm",
    """SELECT signal, ordinal, n, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS q, fp / nullif(fp + tn, 0) AS fpr, coalesce(lead, 0) AS lead
FROM (SELECT signal, ordinal, count(*) AS n, count_if(fired = 1 AND danger) AS tp, count_if(fired = 1 AND NOT danger) AS fp,
             count_if(fired = 0 AND danger) AS fn, count_if(fired = 0 AND NOT danger) AS tn, avg(CASE WHEN danger THEN date_diff('day', ff, date) END) AS lead
      FROM (SELECT *, coalesce(CASE WHEN count(ret) OVER f = 5 THEN sum(ret) OVER f END < -0.05, false) AS danger,
                   min(CASE WHEN fired = 1 THEN date END) OVER (PARTITION BY signal ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ff
            FROM signals WINDOW f AS (PARTITION BY signal ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) GROUP BY 1, 2)""",
    "signals",
)
define(
    "sigf",
    "SELECT *, coalesce(p, 0) AS precision, coalesce(q, 0) AS recall, coalesce(2 * p * q / nullif(p + q, 0), 0) AS f1_score FROM sigm",
    "sigm",
)
define(
    "sigs",
    """SELECT signal, arg_max(sl, date) - 1 AS strategy_return, arg_max(bl, date) - 1 AS buy_hold_return, min(sdd) - min(bdd) AS max_drawdown_avoided,
       avg(st) / stddev_samp(st) * sqrt(252) AS sharpe_ratio
FROM (SELECT *, sl / max(sl) OVER w - 1 AS sdd, bl / max(bl) OVER w - 1 AS bdd
      FROM (SELECT *, exp(sum(ln(1 + st)) OVER w) AS sl, exp(sum(ln(1 + ret)) OVER w) AS bl
            FROM (SELECT *, ret * CASE WHEN fired = 1 AND signal <> 'monthly' THEN 0.5 ELSE 1 END AS st FROM signals)
            WINDOW w AS (PARTITION BY signal ORDER BY date)) WINDOW w AS (PARTITION BY signal ORDER BY date)) GROUP BY 1""",
    "signals",
)


@query("signals", with_ctes("signals", "SELECT signal, CAST(date AS VARCHAR) AS date, fired FROM signals"))
def signals_long(spark, sf):
    return signals(spark, sf).select("signal", text("date"), "fired")


@query(
    "signal_metrics",
    with_ctes(
        "sigf",
        """SELECT signal, round(precision, 4) + 0.0 AS precision, round(recall, 4) + 0.0 AS recall, round(f1_score, 4) + 0.0 AS f1_score,
       round(coalesce(fpr, 0), 4) + 0.0 AS false_positive_rate, round(lead, 1) + 0.0 AS lead_time_days FROM sigf""",
    ),
)
def signal_metrics(spark, sf):
    return S.signal_metrics(signals(spark, sf)).select(
        "signal", *[r(c, 4).alias(c) for c in ("precision", "recall", "f1_score", "false_positive_rate")],
        r("lead_time_days", 1).alias("lead_time_days"),
    )


@query(
    "signal_strategy",
    with_ctes(
        "sigs",
        """SELECT signal, round(strategy_return, 4) + 0.0 AS strategy_return, round(buy_hold_return, 4) + 0.0 AS buy_hold_return,
       round(max_drawdown_avoided, 4) + 0.0 AS max_drawdown_avoided, round(sharpe_ratio, 4) + 0.0 AS sharpe_ratio FROM sigs""",
    ),
)
def signal_strategy(spark, sf):
    cols = ("strategy_return", "buy_hold_return", "max_drawdown_avoided", "sharpe_ratio")
    return S.signal_strategy(signals(spark, sf)).select("signal", *[r(c, 4).alias(c) for c in cols])


@query(
    "compare_signals",
    with_ctes(
        ["sigf", "sigs"],
        """SELECT f.signal, round(f1_score, 4) + 0.0 AS f1_score, round(sharpe_ratio, 4) + 0.0 AS sharpe_ratio,
       (SELECT arg_max(signal, (f1_score, -ordinal)) FROM sigf) AS best_signal FROM sigf f JOIN sigs s ON s.signal = f.signal WHERE n >= 30""",
    ),
)
def compare_signals(spark, sf):
    return S.compare_signals(signals(spark, sf)).select(
        "signal", r("f1_score", 4).alias("f1_score"), r("sharpe_ratio", 4).alias("sharpe_ratio"), "best_signal"
    )


@query("comparison_text")
def comparison_text(spark, sf):
    return S.comparison_text(S.compare_signals(signals(spark, sf)))


_STATS = "mean median std min max p25 p75 p90 p95 avg_corr_mean factor_hhi_mean".split()


@query(
    "signal_stats",
    with_ctes(
        "heat",
        """SELECT count(*) AS days, round(avg(score), 4) + 0.0 AS mean, round(median(score), 4) + 0.0 AS median, round(stddev_samp(score), 4) + 0.0 AS std,
       round(min(score), 4) + 0.0 AS min, round(max(score), 4) + 0.0 AS max, round(quantile_cont(score, 0.25), 4) + 0.0 AS p25,
       round(quantile_cont(score, 0.75), 4) + 0.0 AS p75, round(quantile_cont(score, 0.9), 4) + 0.0 AS p90, round(quantile_cont(score, 0.95), 4) + 0.0 AS p95,
       round(avg(avg_corr), 4) + 0.0 AS avg_corr_mean, round(avg(factor_hhi), 4) + 0.0 AS factor_hhi_mean, """
        + ", ".join(f"round(count_if(level = '{lv}') / count(*) * 100, 1) + 0.0 AS pct_days_{lv}" for lv in C.LEVELS)
        + " FROM heat",
    ),
)
def signal_stats(spark, sf):
    return S.signal_stats(HQ.heat(spark, sf)).select(
        "days", *[r(c, 4).alias(c) for c in _STATS], *[r(f"pct_days_{lv}", 1).alias(f"pct_days_{lv}") for lv in C.LEVELS]
    )


define(
    "fwd",
    "SELECT date, "
    + ", ".join(
        f"CASE WHEN count(ret) OVER w{h} = {h} THEN sum(ret) OVER w{h} END AS fwd_{h}" for h in (1, 5, 10, 20)
    )
    + " FROM port WINDOW "
    + ", ".join(f"w{h} AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in (1, 5, 10, 20)),
    "port",
)
_FWD = ", ".join(
    f"round(avg(fwd_{h}) * 10000, 1) + 0.0 AS avg_fwd_{h}d_bps, round(median(fwd_{h}) * 10000, 1) + 0.0 AS median_fwd_{h}d_bps, "
    f"round(count_if(fwd_{h} < 0) / count(fwd_{h}) * 100, 1) + 0.0 AS pct_negative_{h}d"
    for h in (1, 5, 10, 20)
)


@query(
    "forward_returns_by_level",
    with_ctes(
        ["heat", "fwd"],
        f"SELECT level, count(*) AS n_days, {_FWD} FROM heat JOIN fwd USING (date) GROUP BY 1 HAVING count(*) >= 5",
    ),
)
def forward_returns_by_level(spark, sf):
    df = S.forward_returns_by_level(HQ.heat(spark, sf), portfolio(spark, sf))
    nums = [c for c in df.columns if c not in ("book_id", "level", "n_days")]
    return df.select("level", "n_days", *[r(c, 1).alias(c) for c in nums])


@query(
    "crowding_quintiles",
    with_ctes(
        ["crowd", "fwd", "days"],
        """, e AS (SELECT list_distinct(quantile_cont(crowding_score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM crowd)
SELECT CAST(greatest(len(list_filter(e.edges, lambda x: x < crowding_score)), 1) AS INTEGER) AS quintile, count(*) AS n_days,
       round(avg(fwd_5) * 10000, 1) + 0.0 AS avg_fwd_5d_bps, round(avg(fwd_20) * 10000, 1) + 0.0 AS avg_fwd_20d_bps
FROM crowd JOIN days USING (t) LEFT JOIN fwd USING (date), e GROUP BY 1""",
    ),
)
def crowding_quintiles(spark, sf):
    dates = HQ.heat(spark, sf).select("t", "date")
    crowd = crowding(spark, sf).join(dates, "t")
    return S.crowding_quintiles(crowd, portfolio(spark, sf)).select(
        "quintile", "n_days", r("avg_fwd_5d_bps", 1).alias("avg_fwd_5d_bps"), r("avg_fwd_20d_bps", 1).alias("avg_fwd_20d_bps")
    )


define(
    "crisis_agg",
    """SELECT crisis, avg(score) FILTER (date < "start") AS pre_heat_avg, max(score) FILTER (date < "start") AS pre_heat_max,
       avg(score) FILTER (d) AS during_heat_avg, max(score) FILTER (d) AS during_heat_max, min(score) FILTER (d) AS during_heat_min,
       avg(avg_corr) FILTER (d) AS during_avg_corr, max(avg_corr) FILTER (d) AS correlation_spike, avg(score) FILTER (date > "end") AS post_heat_avg, count(*) FILTER (d) AS n_days,
       count(*) FILTER (d AND level IN ('hot', 'critical', 'emergency')) AS n_days_hot, count(*) FILTER (d AND level IN ('critical', 'emergency')) AS n_days_critical,
       coalesce(date_diff('day', min(date) FILTER (d AND date < peak AND score >= 0.4636), max(peak)), 0) AS early_warning_days,
       coalesce(date_diff('day', min(date) FILTER (d AND date < peak AND score >= 0.6732), max(peak)), 0) AS early_hot_days
FROM (SELECT h.*, c.*, date BETWEEN "start" AND "end" AS d FROM heat h JOIN crises c ON date BETWEEN "start" - INTERVAL 45 DAY AND "end" + INTERVAL 30 DAY) GROUP BY 1""",
    "heat",
    "crises",
)
_CRISIS = "pre_heat_avg pre_heat_max during_heat_avg during_heat_max during_heat_min during_avg_corr post_heat_avg heat_increase".split()


@query(
    "crisis_summary",
    with_ctes(
        "crisis_agg",
        "SELECT crisis, "
        + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in _CRISIS[:-1])
        + """, round(during_heat_avg - pre_heat_avg, 4) + 0.0 AS heat_increase, n_days, n_days_hot, n_days_critical,
       CAST(early_warning_days AS INTEGER) AS early_warning_days, CAST(early_hot_days AS INTEGER) AS early_hot_days,
       coalesce(pre_heat_avg IS NOT NULL AND during_heat_max >= 0.6732, false) AS detected,
       coalesce(pre_heat_avg IS NOT NULL AND during_heat_max >= 0.8029, false) AS strong_signal FROM crisis_agg""",
    ),
)
def crisis_summary(spark, sf):
    return S.crisis_summary(HQ.heat(spark, sf), T.crises(spark), C.THRESHOLDS).select(
        "crisis", *[r(c, 4).alias(c) for c in _CRISIS], "n_days", "n_days_hot", "n_days_critical",
        "early_warning_days", "early_hot_days", "detected", "strong_signal",
    )


@query(
    "crisis_levels",
    with_ctes(
        ["heat", "crises"],
        """SELECT crisis, level, count(*) AS days FROM heat JOIN crises ON date BETWEEN "start" AND "end" GROUP BY 1, 2""",
    ),
)
def crisis_levels(spark, sf):
    return S.crisis_days(HQ.heat(spark, sf), T.crises(spark), 0, 0).groupBy("crisis", "level").agg(F.count("*").alias("days"))


@query(
    "signal_quality",
    with_ctes(
        "crisis_agg",
        """SELECT count(*) AS crises, round(avg(CAST(coalesce(pre_heat_avg IS NOT NULL AND during_heat_max >= 0.8029, false) AS INTEGER)), 4) + 0.0 AS strong_share,
       round(avg(CAST(coalesce(pre_heat_avg IS NOT NULL AND during_heat_max >= 0.6732, false) AS INTEGER)), 4) + 0.0 AS detected_share FROM crisis_agg""",
    ),
)
def signal_quality(spark, sf):
    c = S.crisis_summary(HQ.heat(spark, sf), T.crises(spark), C.THRESHOLDS)
    return c.agg(
        F.count("*").alias("crises"),
        r(F.avg(F.col("strong_signal").cast("int")), 4).alias("strong_share"),
        r(F.avg(F.col("detected").cast("int")), 4).alias("detected_share"),
    )


@query(
    "crisis_backtest",
    with_ctes(
        ["crisis_agg", "port", "crises"],
        """, g AS (SELECT crisis, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY crisis ORDER BY date)) AS lv FROM port JOIN crises ON date BETWEEN "start" AND "end"),
dd AS (SELECT crisis, min(x) AS max_drawdown FROM (SELECT crisis, lv / max(lv) OVER (PARTITION BY crisis ORDER BY date) - 1 AS x FROM g) GROUP BY 1)
SELECT a.crisis, round(coalesce(pre_heat_avg, 0), 4) + 0.0 AS heat_before, round(during_heat_avg, 4) + 0.0 AS heat_during, round(during_heat_max, 4) + 0.0 AS heat_peak,
       early_warning_days > 0 AS warned_early, CAST(early_warning_days AS INTEGER) AS days_early_warning, round(correlation_spike, 4) + 0.0 AS correlation_spike,
       round(max_drawdown, 4) + 0.0 AS max_drawdown, during_heat_avg > coalesce(pre_heat_avg, 0) AND during_heat_max >= 0.4636 AS success
FROM crisis_agg a LEFT JOIN dd ON dd.crisis = a.crisis""",
    ),
)
def crisis_backtest(spark, sf):
    b = S.crisis_backtest(HQ.heat(spark, sf), portfolio(spark, sf), T.crises(spark))
    return b.select(
        "crisis", *[r(c, 4).alias(c) for c in ("heat_before", "heat_during", "heat_peak")], "warned_early",
        "days_early_warning", r("correlation_spike", 4).alias("correlation_spike"), r("max_drawdown", 4).alias("max_drawdown"), "success",
    )


@query(
    "calm_days",
    with_ctes(
        ["heat", "crises"],
        """SELECT CAST(date AS VARCHAR) AS date, level FROM heat WHERE NOT EXISTS (SELECT 1 FROM crises WHERE date BETWEEN "start" AND "end")""",
    ),
)
def calm_days(spark, sf):
    return S.calm_days(HQ.heat(spark, sf), T.crises(spark)).select(text("date"), "level")


@query(
    "false_positive_rate",
    with_ctes(
        ["heat", "crises"],
        """SELECT count(*) AS windows, round(avg(CASE WHEN score >= 0.4636 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS false_positive_rate FROM heat
WHERE NOT EXISTS (SELECT 1 FROM crises WHERE date BETWEEN "start" AND "end")""",
    ),
)
def false_positive_rate(spark, sf):
    return S.false_positive_share(HQ.heat(spark, sf), T.crises(spark)).select(
        "windows", r("false_positive_rate", 4).alias("false_positive_rate")
    )


@query(
    "backtest_overall",
    with_ctes(
        ["crisis_agg", "heat", "crises"],
        """, res AS (SELECT early_warning_days, during_heat_avg > coalesce(pre_heat_avg, 0) AND during_heat_max >= 0.4636 AS success FROM crisis_agg)
SELECT count(*) AS n_crises_tested, count(*) FILTER (success) AS n_crises_detected, round(avg(CAST(success AS DOUBLE)), 4) + 0.0 AS overall_accuracy,
       round(coalesce(avg(early_warning_days) FILTER (early_warning_days > 0), 0), 1) + 0.0 AS avg_early_warning_days,
       (SELECT round(avg(CASE WHEN score >= 0.4636 THEN 1.0 ELSE 0.0 END), 4) + 0.0 FROM heat WHERE NOT EXISTS (SELECT 1 FROM crises WHERE date BETWEEN "start" AND "end")) AS false_positive_rate
FROM res""",
    ),
)
def backtest_overall(spark, sf):
    heat, crises = HQ.heat(spark, sf), T.crises(spark)
    o = S.backtest_overall(S.crisis_backtest(heat, portfolio(spark, sf), crises), S.false_positive_share(heat, crises))
    return o.select(
        "n_crises_tested", "n_crises_detected", r("overall_accuracy", 4).alias("overall_accuracy"),
        r("avg_early_warning_days", 1).alias("avg_early_warning_days"), r("false_positive_rate", 4).alias("false_positive_rate"),
    )


def calm_heat(spark, sf):
    """(calm rows, heat of every 60 consecutive calm rows) of the reference and all customer books."""
    calm = staged(spark, sf, "calm-returns", lambda: S.calm_returns(T.returns(spark, sf), T.crises(spark)))
    own = T.books(spark, sf).select(F.col("book_id").cast("string").alias("book_id"), "symbol", "weight")
    books = own.unionByName(T.reference_book(spark).select("book_id", "symbol", "weight"))
    scored = H.own_history(books, calm, T.factor_dim(spark))
    return calm.select("t").distinct().count(), scored, books


@query("false_positive_windows")
def false_positive_windows(spark, sf):
    """False alarms of every book in windows over its calm days."""
    rows, scored, books = calm_heat(spark, sf)
    return S.false_positive_windows(scored, rows, books).select("book_id", "windows", r("false_positive_rate", 4).alias("false_positive_rate"))


@query(
    "calm_rows",
    with_ctes(
        ["rets", "crises"],
        """SELECT row_number() OVER (ORDER BY date) - 1 AS t, CAST(date AS VARCHAR) AS date FROM (SELECT DISTINCT date FROM rets)
WHERE NOT EXISTS (SELECT 1 FROM crises WHERE date BETWEEN "start" AND "end")""",
    ),
)
def calm_rows(spark, sf):
    calm = S.calm_returns(T.returns(spark, sf), T.crises(spark))
    return calm.select(HQ.big("t"), text("date")).distinct()


@query(
    "history_checks",
    with_ctes(
        "heat",
        """, s AS (SELECT date, abs(score - lag(score) OVER w) AS change, abs(sev - lag(sev) OVER w) AS skip FROM (SELECT *, CASE level WHEN 'cool' THEN 0 WHEN 'warm' THEN 1 WHEN 'hot' THEN 2 WHEN 'critical' THEN 3 ELSE 4 END AS sev FROM heat) WINDOW w AS (ORDER BY date)),
g AS (SELECT run, count(*) AS n FROM (SELECT count(*) FILTER (NOT coalesce(change < 0.001, false)) OVER (ORDER BY date) AS run FROM s) GROUP BY 1)
SELECT round(avg(change), 4) + 0.0 AS mean_change, round(max(change), 4) + 0.0 AS max_change, round(count_if(change > 0.15) / count(change) * 100, 1) + 0.0 AS pct_large_jumps,
       CAST(count_if(skip > 2) AS BIGINT) AS level_skips, (SELECT max(n) FROM g) AS longest_stuck_run FROM s""",
    ),
)
def history_checks(spark, sf):
    return S.history_checks(HQ.heat(spark, sf)).select(
        r("mean_change", 4).alias("mean_change"), r("max_change", 4).alias("max_change"),
        r("pct_large_jumps", 1).alias("pct_large_jumps"), "level_skips", "longest_stuck_run",
    )


def features(spark, sf):
    return staged(spark, sf, "features", lambda: S.regime_features(portfolio(spark, sf), HQ.heat(spark, sf)))


@query(
    "regime_features",
    with_ctes(
        ["port", "heat"],
        """SELECT CAST(p.date AS VARCHAR) AS date, round(m, 6) + 0.0 AS rolling_return, round(sd, 6) + 0.0 AS realized_vol, round(sk, 5) + 0.0 AS return_skew,
       round(coalesce(h.avg_corr, (SELECT arg_min(avg_corr, date) FROM heat)), 6) + 0.0 AS avg_correlation,
       round(coalesce(h.score, (SELECT arg_min(score, date) FROM heat)), 10) + 0.0 AS heat_score
FROM (SELECT date, count(*) OVER w AS n, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS sd, skewness(ret) OVER w AS sk FROM port
      WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) p LEFT JOIN heat h ON h.date = p.date WHERE n = 20""",
    ),
)
def regime_features(spark, sf):
    return features(spark, sf).select(
        text("date"), r("rolling_return").alias("rolling_return"), r("realized_vol").alias("realized_vol"),
        r("return_skew", 5).alias("return_skew"), r("avg_correlation").alias("avg_correlation"), r("heat_score", 10).alias("heat_score"),
    )


@query(
    "window_functions",
    with_ctes(
        "rets",
        """SELECT CAST(t AS BIGINT) AS t, symbol, round(ma, 6) + 0.0 AS ma_50, round(sk, 4) + 0.0 AS skew_20, round(f5, 6) + 0.0 AS fwd_5,
       round(lv, 6) + 0.0 AS growth, round(lv / max(lv) OVER (PARTITION BY symbol ORDER BY t) - 1, 6) + 0.0 AS drawdown, m1 AS month_start
FROM (SELECT *, CASE WHEN count(*) OVER a = 50 THEN avg(close) OVER a END AS ma, CASE WHEN count(*) OVER b = 20 THEN skewness(simple) OVER b END AS sk,
             CASE WHEN count(*) OVER c = 5 THEN sum(simple) OVER c END AS f5, exp(sum(ln(1 + simple)) OVER d) AS lv,
             row_number() OVER (PARTITION BY symbol, year(date), month(date) ORDER BY date) = 1 AS m1
      FROM rets WINDOW a AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
           c AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), d AS (PARTITION BY symbol ORDER BY t))""",
    ),
)
def window_functions(spark, sf):
    k = ["symbol"]
    month = Window.partitionBy("symbol", F.year("date"), F.month("date")).orderBy("date")
    df = T.returns(spark, sf).withColumn("growth", S.growth("simple", k, "t"))
    return df.select(
        F.col("t").cast("bigint").alias("t"), "symbol", r(S.moving_average("close", k, "t", 50)).alias("ma_50"),
        r(S.rolling_skewness("simple", k, "t", 20), 4).alias("skew_20"), r(S.forward_sum("simple", k, "t", 5)).alias("fwd_5"),
        r("growth").alias("growth"), r(S.drawdown("growth", k, "t")).alias("drawdown"),
        (F.row_number().over(month) == 1).alias("month_start"),
    )


# -- scorecard -----------------------------------------------------------------
def _cards(spark, sf):
    closes = T.closes(spark, sf)
    return closes, K.lookback(closes, 24)


def warned(spark, sf):
    def build():
        closes, recent = _cards(spark, sf)
        return K.warning_leads(closes, T.vix(spark, sf), K.drawdown_episodes(recent), VIX_LIMIT, 50)

    return staged(spark, sf, "warned", build)


define(
    "recent_closes",
    "SELECT c.* FROM closes c JOIN (SELECT symbol, max(date) AS d FROM closes GROUP BY 1) l ON l.symbol = c.symbol AND c.date > l.d - INTERVAL 24 MONTH",
    "closes",
)
define(
    "episodes",
    """SELECT symbol, peak_date, trough_date, recovery_date, round(trough / peak - 1, 6) + 0.0 AS depth, CAST(date_diff('day', peak_date, trough_date) AS INTEGER) AS days_peak_to_trough
FROM (SELECT *, lead(peak_date) OVER (PARTITION BY symbol ORDER BY island) AS recovery_date
      FROM (SELECT symbol, island, min(date) AS peak_date, arg_min(close, date) AS peak, arg_min(date, (close, date)) AS trough_date, min(close) AS trough
            FROM (SELECT *, sum(CAST(coalesce(close >= pm, true) AS INTEGER)) OVER (PARTITION BY symbol ORDER BY date) AS island
                  FROM (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM recent_closes)) GROUP BY 1, 2))
WHERE trough / peak - 1 <= -0.05""",
    "recent_closes",
)
define(
    "warned",
    """SELECT e.symbol, e.peak_date, e.trough_date, min(f.date) FILTER (f.v) AS vix_first, count(*) FILTER (f.v) AS vix_days, min(f.date) FILTER (f.m) AS ma_first, count(*) FILTER (f.m) AS ma_days,
       date_diff('day', min(f.date) FILTER (f.v), e.trough_date) AS vix_lead, date_diff('day', min(f.date) FILTER (f.m), e.trough_date) AS ma_lead
FROM episodes e LEFT JOIN (
  SELECT c.symbol, c.date, coalesce(v.vix > 60, false) AS v, coalesce(c.close < c.ma, false) AS m
  FROM (SELECT *, CASE WHEN count(*) OVER w = 50 THEN avg(close) OVER w END AS ma FROM closes WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) c
  ASOF LEFT JOIN vix v ON c.date >= v.date) f ON f.symbol = e.symbol AND f.date BETWEEN e.peak_date AND e.trough_date
GROUP BY 1, 2, 3""",
    "episodes",
    "closes",
    "vix",
)


@query(
    "drawdown_episodes",
    with_ctes(
        "episodes",
        """SELECT symbol, CAST(peak_date AS VARCHAR) AS peak_date, CAST(trough_date AS VARCHAR) AS trough_date, CAST(recovery_date AS VARCHAR) AS recovery_date, depth, days_peak_to_trough FROM episodes""",
    ),
)
def drawdown_episodes(spark, sf):
    return K.drawdown_episodes(_cards(spark, sf)[1]).select(
        "symbol", text("peak_date"), text("trough_date"), text("recovery_date"), "depth", "days_peak_to_trough"
    )


@query(
    "warning_leads",
    with_ctes(
        "warned",
        """SELECT symbol, CAST(peak_date AS VARCHAR) AS peak_date, vix_days, ma_days, CAST(vix_lead AS INTEGER) AS vix_lead, CAST(ma_lead AS INTEGER) AS ma_lead FROM warned""",
    ),
)
def warning_leads(spark, sf):
    return warned(spark, sf).select("symbol", text("peak_date"), "vix_days", "ma_days", "vix_lead", "ma_lead")


@query(
    "scorecard",
    with_ctes(
        ["warned", "recent_closes"],
        """SELECT w.symbol, CAST(w.s AS VARCHAR) AS window_start, CAST(w.e AS VARCHAR) AS window_end, coalesce(n, 0) AS episodes, coalesce(v, 0) AS vix_fired, coalesce(m, 0) AS ma_fired, coalesce(x, 0) AS either_fired,
       vl AS vix_median_lead, ml AS ma_median_lead, xl AS either_median_lead, round(coalesce(v / n, 0), 6) + 0.0 AS vix_hit_rate, round(coalesce(m / n, 0), 6) + 0.0 AS ma_hit_rate, round(coalesce(x / n, 0), 6) + 0.0 AS either_hit_rate
FROM (SELECT symbol, min(date) AS s, max(date) AS e FROM recent_closes GROUP BY 1) w LEFT JOIN (
 SELECT symbol, count(*) AS n, count(vix_lead) AS v, count(ma_lead) AS m, count(greatest(vix_lead, ma_lead)) AS x, median(vix_lead) AS vl, median(ma_lead) AS ml, median(greatest(vix_lead, ma_lead)) AS xl FROM warned GROUP BY 1) q ON q.symbol = w.symbol""",
    ),
)
def scorecard(spark, sf):
    c = K.scorecard(_cards(spark, sf)[1], warned(spark, sf))
    names = ("vix", "ma", "either")
    return c.select(
        "symbol", text("window_start"), text("window_end"), "episodes", *[f"{n}_fired" for n in names],
        *[f"{n}_median_lead" for n in names], *[r(f"{n}_hit_rate").alias(f"{n}_hit_rate") for n in names],
    )


@query("scorecard_text")
def scorecard_text(spark, sf):
    return K.scorecard_text(K.scorecard(_cards(spark, sf)[1], warned(spark, sf)), warned(spark, sf))


@query(
    "scorecard_freshness",
    with_ctes(
        "recent_closes",
        """SELECT symbol, CAST(date_diff('day', max(date), DATE '2001-11-10') AS INTEGER) AS age_days, date_diff('day', max(date), DATE '2001-11-10') > 10 AS stale FROM recent_closes GROUP BY 1""",
    ),
)
def scorecard_freshness(spark, sf):
    card = K.scorecard(_cards(spark, sf)[1], warned(spark, sf))
    return K.stale_scorecards(card, F.to_date(F.lit("2001-11-10"))).select("symbol", "age_days", "stale")

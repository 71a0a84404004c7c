"""Warning signals: construction, classification quality, strategy results, crisis analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookheat import constants as C


def growth(ret: str, keys: list[str], order: str) -> Column:
    """Cumulative product of 1 + return."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.exp(F.sum(F.log1p(F.col(ret))).over(w))


def moving_average(value: str, keys: list[str], order: str, rows: int) -> Column:
    """Rolling mean, null until ``rows`` values exist."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) == rows, F.avg(value).over(w))


def rolling_skewness(value: str, keys: list[str], order: str, rows: int) -> Column:
    """Bias-corrected skewness of the last ``rows`` values, null until they exist."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    fix = (rows * (rows - 1)) ** 0.5 / (rows - 2)
    return F.when(F.count(value).over(w) == rows, F.skewness(value).over(w) * fix)


def forward_sum(value: str, keys: list[str], order: str, horizon: int) -> Column:
    """Sum of the next ``horizon`` values, null when fewer remain."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, horizon)
    return F.when(F.count(value).over(w) == horizon, F.sum(value).over(w))


def drawdown(level: str, keys: list[str], order: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.col(level) / F.max(level).over(w) - 1


def align(heat: DataFrame, returns: DataFrame, vix: DataFrame | None) -> DataFrame:
    """Days common to heat (book_id, date, score, avg_corr), returns (date, ret) and vix (date, vix)."""
    df = heat.select("book_id", "date", "score", "avg_corr").join(returns.select("date", "ret"), "date")
    if vix is not None:
        return df.join(vix.select("date", "vix"), "date")
    return df.withColumn("vix", F.lit(None).cast("double"))


def build_signals(
    aligned: DataFrame,
    heat_threshold: float = C.THRESHOLDS["warm"],
    vix_threshold: float = 25.0,
    ma_window: int = 50,
    corr_threshold: float = 0.6,
) -> DataFrame:
    """Long signals (book_id, signal, ordinal, date, ret, fired); the average rule only if it ever fires."""
    keys = ["book_id"]
    month = Window.partitionBy("book_id", F.year("date"), F.month("date")).orderBy("date")
    df = (
        aligned.withColumn("level", growth("ret", keys, "date"))
        .withColumn("ma", moving_average("level", keys, "date", ma_window))
        .withColumn("heat_fired", F.col("score") >= heat_threshold)
        .withColumn("vix_fired", F.col("vix") > vix_threshold)
        .withColumn("ma_fired", F.coalesce(F.col("level") < F.col("ma"), F.lit(False)))
        .withColumn("month_fired", F.row_number().over(month) == 1)
        .withColumn("corr_fired", F.col("avg_corr") > corr_threshold)
        .withColumn("ma_ever", F.max("ma_fired").over(Window.partitionBy("book_id")))
    )
    kinds = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("signal"), F.col(c).cast("int").alias("fired"))
            for i, (name, c) in enumerate(
                [
                    ("heat", "heat_fired"),
                    ("vix", "vix_fired"),
                    ("moving_average", "ma_fired"),
                    ("monthly", "month_fired"),
                    ("correlation", "corr_fired"),
                ]
            )
        ]
    )
    out = df.select("book_id", "date", "ret", "ma_ever", F.explode(kinds).alias("s"))
    return (
        out.filter((F.col("s.signal") != "moving_average") | F.col("ma_ever"))
        .filter(F.col("s.fired").isNotNull())
        .select("book_id", "s.signal", "s.ordinal", "date", "ret", "s.fired")
    )


def signal_metrics(signals: DataFrame, danger: float = -0.05, horizon: int = 5, lookback: int = 10) -> DataFrame:
    """Precision, recall, F1, false positive rate and mean lead of each signal.

    Danger is a forward sum below the threshold; the last days count as no danger. The lead of a
    danger day runs from the first fire among the last ``lookback`` rows.
    """
    keys = ["book_id", "signal", "ordinal"]
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(lookback - 1), 0)
    df = (
        signals.withColumn("fwd", forward_sum("ret", keys, "date", horizon))
        .withColumn("danger", F.coalesce((F.col("fwd") < danger).cast("int"), F.lit(0)))
        .withColumn("first_fire", F.min(F.when(F.col("fired") == 1, F.col("date"))).over(w))
        .withColumn("lead", F.when(F.col("danger") == 1, F.date_diff("date", "first_fire")))
    )
    f, d = F.col("fired") == 1, F.col("danger") == 1
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if(f & d).alias("tp"),
        F.count_if(f & ~d).alias("fp"),
        F.count_if(~f & d).alias("fn"),
        F.count_if(~f & ~d).alias("tn"),
        F.avg("lead").alias("lead"),
    )
    zero = F.lit(0.0)
    ok = F.col("rows") >= 10

    def ratio(a: Column, b: Column) -> Column:
        return F.when(ok, F.coalesce(F.try_divide(a, b), zero)).otherwise(zero)

    p, q = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (
        agg.withColumn("precision", p)
        .withColumn("recall", q)
        .withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .withColumn("false_positive_rate", ratio(F.col("fp"), F.col("fp") + F.col("tn")))
        .withColumn("lead_time_days", F.when(ok, F.coalesce("lead", zero)).otherwise(zero))
        .drop("lead")
    )


def signal_strategy(signals: DataFrame, action: str = "reduce", lag: int = 0) -> DataFrame:
    """Result of acting on each signal against buy and hold.

    ``reduce`` halves and ``exit`` ends the exposure on a fired day; monthly rebalancing keeps it.
    ``lag`` 0 acts on the same day as the signal, 1 on the next.
    """
    keys = ["book_id", "signal", "ordinal"]
    order = Window.partitionBy(*keys).orderBy("date")
    acted = F.coalesce(F.lag("fired", lag).over(order), F.lit(0)) if lag else F.col("fired")
    low = {"reduce": 0.5, "exit": 0.0, "rebalance": 1.0}[action]
    df = (
        signals.withColumn("acted", acted)
        .withColumn("exposure", F.when((F.col("acted") == 1) & (F.col("signal") != "monthly"), low).otherwise(1.0))
        .withColumn("strat", F.col("ret") * F.col("exposure"))
        .withColumn("bh_level", growth("ret", keys, "date"))
        .withColumn("st_level", growth("strat", keys, "date"))
        .withColumn("bh_dd", drawdown("bh_level", keys, "date"))
        .withColumn("st_dd", drawdown("st_level", keys, "date"))
    )
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        (F.max_by("st_level", "date") - 1).alias("strategy_return"),
        (F.max_by("bh_level", "date") - 1).alias("buy_hold_return"),
        (F.min("st_dd") - F.min("bh_dd")).alias("max_drawdown_avoided"),
        (F.coalesce(F.try_divide(F.avg("strat"), F.stddev_samp("strat")), F.lit(0.0)) * 252**0.5).alias("sharpe_ratio"),
    )
    cols = ("strategy_return", "buy_hold_return", "max_drawdown_avoided", "sharpe_ratio")
    return agg.select(*keys, *[F.when(F.col("rows") >= 10, F.col(c)).otherwise(0.0).alias(c) for c in cols])


def compare_signals(signals: DataFrame) -> DataFrame:
    """Metrics and strategy of every signal, the best by F1 flagged (first signal wins ties)."""
    keys = ["book_id", "signal", "ordinal"]
    both = signal_metrics(signals).filter("rows >= 30").join(signal_strategy(signals), keys)
    best = F.max_by("signal", F.struct(F.col("f1_score"), -F.col("ordinal"))).over(Window.partitionBy("book_id"))
    return both.withColumn("best_signal", best)


def comparison_text(compared: DataFrame) -> DataFrame:
    """One line per book: heat against the volatility index."""

    def part(name: str, label: str) -> Column:
        pick = lambda c: F.max(F.when(F.col("signal") == name, F.col(c)))
        return F.format_string(
            f"{label}: F1=%.2f, Precision=%.0f%%, Sharpe=%.2f",
            F.bround(pick("f1_score"), 2),
            F.bround(pick("precision") * 100, 0),
            F.bround(pick("sharpe_ratio"), 2),
        )

    f = lambda n: F.max(F.when(F.col("signal") == n, F.round("f1_score", 4)))
    h, v = f("heat"), f("vix")
    verdict = (
        F.when(h > v, F.format_string("Heat score outperforms VIX by %.2f F1 points", h - v))
        .when(v > h, F.format_string("VIX outperforms Heat by %.2f F1 points", v - h))
        .otherwise("Heat and VIX signals perform equally")
    )
    return compared.groupBy("book_id").agg(
        F.when(v.isNull(), part("heat", "Heat"))
        .otherwise(F.concat_ws(" | ", part("heat", "Heat"), part("vix", "VIX"), verdict))
        .alias("summary")
    )


def signal_stats(heat: DataFrame) -> DataFrame:
    """Distribution of the score per book with level shares."""
    q = lambda p: F.percentile("score", p)
    n = F.count("*")
    return heat.groupBy("book_id").agg(
        n.alias("days"),
        F.avg("score").alias("mean"),
        F.median("score").alias("median"),
        F.stddev_samp("score").alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
        q(0.25).alias("p25"),
        q(0.75).alias("p75"),
        q(0.90).alias("p90"),
        q(0.95).alias("p95"),
        F.avg("avg_corr").alias("avg_corr_mean"),
        F.avg("factor_hhi").alias("factor_hhi_mean"),
        *[(F.count_if(F.col("level") == lv) / n * 100).alias(f"pct_days_{lv}") for lv in C.LEVELS],
    )


def forward_returns_by_level(heat: DataFrame, returns: DataFrame, horizons=(1, 5, 10, 20), min_days: int = 5) -> DataFrame:
    """Mean and median forward return in basis points and share of losses per level."""
    r = returns
    for h in horizons:
        r = r.withColumn(f"fwd_{h}", forward_sum("ret", [], "date", h))
    df = heat.select("book_id", "date", "level").join(r, "date")
    aggs = [F.count("*").alias("n_days")]
    for h in horizons:
        c = F.col(f"fwd_{h}")
        aggs += [
            (F.avg(c) * 10000).alias(f"avg_fwd_{h}d_bps"),
            (F.median(c) * 10000).alias(f"median_fwd_{h}d_bps"),
            (F.count_if(c < 0) / F.count(c) * 100).alias(f"pct_negative_{h}d"),
        ]
    return df.groupBy("book_id", "level").agg(*aggs).filter(F.col("n_days") >= min_days)


def crowding_quintiles(crowd: DataFrame, returns: DataFrame) -> DataFrame:
    """Mean forward 5- and 20-day return per quintile of crowding (equal edges merged)."""
    r = returns.withColumn("fwd_5", forward_sum("ret", [], "date", 5)).withColumn(
        "fwd_20", forward_sum("ret", [], "date", 20)
    )
    edges = crowd.groupBy("book_id").agg(
        F.array_distinct(F.percentile("crowding_score", F.array(*[F.lit(i / 5) for i in range(6)]))).alias("edges")
    )
    above = F.size(F.filter("edges", lambda e: e < F.col("crowding_score")))
    return (
        crowd.join(edges, "book_id")
        .withColumn("quintile", F.greatest(above, F.lit(1)))
        .join(r.select("date", "fwd_5", "fwd_20"), "date", "left")
        .groupBy("book_id", "quintile")
        .agg(
            F.count("*").alias("n_days"),
            (F.avg("fwd_5") * 10000).alias("avg_fwd_5d_bps"),
            (F.avg("fwd_20") * 10000).alias("avg_fwd_20d_bps"),
        )
    )


def crisis_days(days: DataFrame, crises: DataFrame, before: int = 45, after: int = 30) -> DataFrame:
    """Days tagged pre, during or post of each crisis interval (range join on a broadcast dimension)."""
    span = F.col("date").between(F.date_sub("start", before), F.date_add("end", after))
    return days.join(F.broadcast(crises), span).withColumn(
        "phase", F.when(F.col("date") < F.col("start"), "pre").when(F.col("date") <= F.col("end"), "during").otherwise("post")
    )


def calm_days(days: DataFrame, crises: DataFrame) -> DataFrame:
    """Days in no crisis."""
    hit = crises.select(F.explode(F.sequence("start", "end")).alias("date")).distinct()
    return days.join(hit, "date", "left_anti")


def crisis_summary(heat: DataFrame, crises: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Heat before, during and after each crisis, first warnings before its peak, verdict."""
    d = crisis_days(heat, crises)
    pre, dur, post = (F.col("phase") == p for p in ("pre", "during", "post"))
    s = F.col("score")
    early = dur & (F.col("date") < F.col("peak"))
    hot, critical = F.col("level").isin("hot", "critical", "emergency"), F.col("level").isin("critical", "emergency")
    agg = d.groupBy("book_id", "crisis", "start", "peak", "end").agg(
        F.avg(F.when(pre, s)).alias("pre_heat_avg"),
        F.max(F.when(pre, s)).alias("pre_heat_max"),
        F.avg(F.when(dur, s)).alias("during_heat_avg"),
        F.max(F.when(dur, s)).alias("during_heat_max"),
        F.min(F.when(dur, s)).alias("during_heat_min"),
        F.avg(F.when(dur, F.col("avg_corr"))).alias("during_avg_corr"),
        F.avg(F.when(post, s)).alias("post_heat_avg"),
        F.count_if(dur).alias("n_days"),
        F.count_if(dur & hot).alias("n_days_hot"),
        F.count_if(dur & critical).alias("n_days_critical"),
        F.min(F.when(early & (s >= thresholds["warm"]), F.col("date"))).alias("first_warm"),
        F.min(F.when(early & (s >= thresholds["hot"]), F.col("date"))).alias("first_hot"),
    )
    seen = F.col("during_heat_avg").isNotNull() & F.col("pre_heat_avg").isNotNull()
    no = F.lit(False)
    return (
        agg.withColumn("early_warning_days", F.coalesce(F.date_diff("peak", "first_warm"), F.lit(0)))
        .withColumn("early_hot_days", F.coalesce(F.date_diff("peak", "first_hot"), F.lit(0)))
        .withColumn("heat_increase", F.col("during_heat_avg") - F.col("pre_heat_avg"))
        .withColumn("detected", F.when(seen, F.col("during_heat_max") >= thresholds["hot"]).otherwise(no))
        .withColumn("strong_signal", F.when(seen, F.col("during_heat_max") >= thresholds["critical"]).otherwise(no))
    )


def crisis_backtest(heat: DataFrame, returns: DataFrame, crises: DataFrame, warm: float = C.THRESHOLDS["warm"]) -> DataFrame:
    """Per crisis: heat before/during/peak, early warning, correlation peak, drawdown, success."""
    s = crisis_summary(heat, crises, C.THRESHOLDS)
    spike = (
        crisis_days(heat, crises, 0, 0).groupBy("book_id", "crisis").agg(F.max("avg_corr").alias("correlation_spike"))
    )
    inside = crisis_days(returns.select("date", "ret"), crises, 0, 0)
    dd = (
        inside.withColumn("level", growth("ret", ["crisis"], "date"))
        .withColumn("dd", drawdown("level", ["crisis"], "date"))
        .groupBy("crisis")
        .agg(F.min("dd").alias("max_drawdown"))
    )
    return (
        s.join(spike, ["book_id", "crisis"])
        .join(dd, "crisis", "left")
        .select(
            "book_id",
            "crisis",
            F.coalesce("pre_heat_avg", F.lit(0.0)).alias("heat_before"),
            F.col("during_heat_avg").alias("heat_during"),
            F.col("during_heat_max").alias("heat_peak"),
            F.col("first_warm").isNotNull().alias("warned_early"),
            F.col("early_warning_days").alias("days_early_warning"),
            "correlation_spike",
            "max_drawdown",
        )
        .withColumn("success", (F.col("heat_during") > F.col("heat_before")) & (F.col("heat_peak") >= warm))
    )


def backtest_overall(results: DataFrame, false_positives: DataFrame) -> DataFrame:
    """Per book: crises tested and detected, their share, mean early warning of the warned ones, false alarms."""
    overall = results.groupBy("book_id").agg(
        F.count("*").alias("n_crises_tested"),
        F.count_if("success").alias("n_crises_detected"),
        F.avg(F.col("success").cast("double")).alias("overall_accuracy"),
        F.coalesce(F.avg(F.when(F.col("warned_early"), F.col("days_early_warning"))), F.lit(0.0)).alias("avg_early_warning_days"),
    )
    return overall.join(false_positives, "book_id", "left").withColumn("false_positive_rate", F.coalesce("false_positive_rate", F.lit(0.0)))


def false_positive_share(heat: DataFrame, crises: DataFrame, warm: float = C.THRESHOLDS["warm"]) -> DataFrame:
    """Share of the calm days whose trailing-window heat is warm or above, over all calm days."""
    return calm_days(heat, crises).groupBy("book_id").agg(
        F.count("*").alias("windows"), F.avg((F.col("score") >= warm).cast("double")).alias("false_positive_rate")
    )


def history_checks(heat: DataFrame) -> DataFrame:
    """Quality of a heat history: jumps, stuck runs and level skips per book."""
    w = Window.partitionBy("book_id").orderBy("date")
    sev = F.element_at(F.create_map(*[x for k, v in C.SEVERITY.items() for x in (F.lit(k), F.lit(v))]), F.col("level"))
    df = (
        heat.withColumn("sev", sev)
        .withColumn("change", F.abs(F.col("score") - F.lag("score").over(w)))
        .withColumn("skip", F.abs(F.col("sev") - F.lag("sev").over(w)))
        .withColumn("run", F.count_if(~F.coalesce(F.col("change") < 0.001, F.lit(False))).over(w))
    )
    runs = df.groupBy("book_id", "run").agg(F.count("*").alias("len"))
    longest = runs.groupBy("book_id").agg(F.max("len").alias("longest_stuck_run"))
    return (
        df.groupBy("book_id")
        .agg(
            F.avg("change").alias("mean_change"),
            F.max("change").alias("max_change"),
            (F.count_if(F.col("change") > 0.15) / F.count("change") * 100).alias("pct_large_jumps"),
            F.count_if(F.col("skip") > 2).alias("level_skips"),
        )
        .join(longest, "book_id")
    )


def regime_features(returns: DataFrame, heat: DataFrame, window: int = 20) -> DataFrame:
    """Rolling mean, deviation and skewness joined with correlation and heat per (book, day).

    Days before the heat history starts take its first values; null rows drop out.
    """
    w = Window.orderBy("date").rowsBetween(-(window - 1), 0)
    full = F.count("ret").over(w) == window
    roll = returns.select(
        "date",
        F.when(full, F.avg("ret").over(w)).alias("rolling_return"),
        F.when(full, F.stddev_samp("ret").over(w)).alias("realized_vol"),
        rolling_skewness("ret", [], "date", window).alias("return_skew"),
    ).filter("rolling_return is not null")
    firsts = heat.groupBy("book_id").agg(
        F.min_by(F.struct("avg_corr", "score"), "date").alias("f"), F.min("date").alias("since")
    )
    # the days before a book's history are made per book and met by an equi-join
    begin = roll.agg(F.min("date")).scalar()
    gap = firsts.filter(F.col("since") > begin).select(
        "book_id", "f", F.explode(F.sequence(begin, F.date_sub("since", 1))).alias("date")
    )
    early = gap.join(roll, "date").select(
        "book_id", "date", "rolling_return", "realized_vol", "return_skew",
        F.col("f.avg_corr").alias("avg_correlation"), F.col("f.score").alias("heat_score"),
    )
    later = roll.join(heat, "date").select(
        "book_id", "date", "rolling_return", "realized_vol", "return_skew",
        F.col("avg_corr").alias("avg_correlation"), F.col("score").alias("heat_score"),
    )
    return early.unionByName(later).dropna()


def calm_returns(returns: DataFrame, crises: DataFrame) -> DataFrame:
    """``returns`` of the days in no crisis, their ``t`` numbered anew without holes.

    Days are counted by month first, so that no window runs over more than a month of days and one row per month.
    """
    days = calm_days(returns.select("date").distinct(), crises).withColumn("month", F.trunc("date", "month"))
    before = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = days.groupBy("month").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("month").orderBy("date")) - 1
    numbered = days.withColumn("inside", inside).join(months, "month").select("date", (F.col("before") + F.col("inside")).cast("int").alias("t"))
    return returns.drop("t").join(numbered, "date").select(*returns.columns)


def false_positive_windows(scored: DataFrame, calm_rows: int, books: DataFrame, window: int = C.WINDOW_ROWS, least: int = 120, warm: float = C.THRESHOLDS["warm"]) -> DataFrame:
    """Per book: windows over the calm days and the share whose heat is warm or above.

    ``scored`` is the heat of every ``window`` consecutive calm rows, ranked in the windows before it. With fewer than ``least``
    calm rows the share is 0 of no windows.
    """
    share = scored.filter(F.lit(calm_rows >= least)).groupBy("book_id").agg(
        F.count("*").alias("windows"), F.avg((F.col("score") >= warm).cast("double")).alias("false_positive_rate")
    )
    every = books.select("book_id").distinct().join(share, "book_id", "left")
    return every.select("book_id", F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("false_positive_rate", F.lit(0.0)).alias("false_positive_rate"))

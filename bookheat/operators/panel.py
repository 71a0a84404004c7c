"""Price and return panels in long form: returns, bars, snapshots, source choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def close_prices(bars: DataFrame) -> DataFrame:
    """Drop the dates on which every symbol is null."""
    live = bars.groupBy("date").agg(F.count("close").alias("n")).filter("n > 0")
    return bars.join(live, "date", "left_semi").select("date", "symbol", "close")


def date_grid(closes: DataFrame, symbols: int | None = None) -> DataFrame:
    """One row per date: grid ordinal ``g``, return ordinal ``t`` and completeness.

    A date is complete when every symbol (``symbols`` of them, by default those of ``closes``) has a price on it
    and on the grid date before.
    Windows run over one row per date only.
    """
    quoted = closes.filter(F.col("close").isNotNull())
    n = F.lit(symbols) if symbols is not None else quoted.agg(F.countDistinct("symbol").alias("n")).scalar()
    w = Window.orderBy("date")
    per_date = closes.groupBy("date").agg(F.count("close").alias("cnt")).withColumn("n", n)
    full = F.col("cnt") == F.col("n")
    before = F.coalesce(F.lag("cnt").over(w), F.lit(0)) == F.col("n")
    return (
        per_date.withColumn("g", F.row_number().over(w) - 1)
        .withColumn("complete", full & before)
        .withColumn("t", F.sum(F.col("complete").cast("int")).over(w) - 1)
        .withColumn("g_last", F.max("g").over(Window.partitionBy()))
        .select("date", "g", "g_last", "complete", F.col("t").cast("int").alias("t"))
    )


def forward_fill_closes(closes: DataFrame) -> DataFrame:
    """Carry each symbol's last close over the grid dates it misses (no cross join)."""
    grid = date_grid(closes).select("date", "g", "g_last")
    w = Window.partitionBy("symbol").orderBy("g")
    spans = (
        closes.filter(F.col("close").isNotNull())
        .join(grid, "date")
        .withColumn("until", F.coalesce(F.lead("g").over(w) - 1, F.col("g_last")))
        .select("symbol", "close", F.explode(F.sequence("g", "until")).alias("g"))
    )
    return spans.join(grid.select("g", "date"), "g").select("date", "symbol", "close")


def log_returns(closes: DataFrame, period: int | None = None, fill: str | None = None, symbols: int | None = None) -> DataFrame:
    """Daily log and simple returns on complete dates, newest ``period`` dates if given.

    Result: (t, date, symbol, close, ret, simple); ``t`` numbers the kept dates.
    """
    if fill == "ffill":
        closes = forward_fill_closes(closes)
    grid = date_grid(closes, symbols)
    w = Window.partitionBy("symbol").orderBy("g")
    out = (
        closes.join(grid, "date")
        .withColumn("prev", F.lag("close").over(w))
        .withColumn("prev_g", F.lag("g").over(w))
        .filter(F.col("complete") & (F.col("prev_g") == F.col("g") - 1))
        .select(
            "t",
            "date",
            "symbol",
            "close",
            F.log(F.col("close") / F.col("prev")).alias("ret"),
            (F.col("close") / F.col("prev") - 1).alias("simple"),
        )
    )
    if period is not None:
        last = grid.agg(F.max("t")).scalar()
        out = out.filter(F.col("t") > last - period)
    return out


def ohlcv_bars(ticks: DataFrame, width: str) -> DataFrame:
    """Tumbling bars from trades (symbol, ts, price, size, seq); ties in time break by seq."""
    order = F.struct("ts", "seq")
    return (
        ticks.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume"),
            (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"),
        )
        .select("symbol", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "vwap")
    )


def latest_snapshot(bars: DataFrame) -> DataFrame:
    """Newest bar per symbol against the close before it."""
    w = Window.partitionBy("symbol").orderBy("bar_start")
    newest = Window.partitionBy("symbol").orderBy(F.col("bar_start").desc())
    change = F.col("close") - F.col("prev_close")
    no_base = F.col("prev_close").isNull() | (F.col("prev_close") == 0)
    return (
        bars.withColumn("prev_close", F.lag("close").over(w))
        .withColumn("rn", F.row_number().over(newest))
        .filter("rn = 1")
        .select(
            "symbol",
            F.col("close").alias("price"),
            "open",
            "high",
            "low",
            "volume",
            "prev_close",
            F.when(no_base, F.lit(0.0)).otherwise(change).alias("change"),
            F.when(no_base, F.lit(0.0)).otherwise(change / F.col("prev_close") * 100).alias("change_pct"),
            F.col("bar_start").alias("ts"),
        )
    )


def macro_panel(series: DataFrame, ids: list[str], minuend: str, subtrahend: str) -> DataFrame:
    """Wide macro panel: forward filled, all-null rows dropped, plus one spread column."""
    wide = series.filter(F.col("value").isNotNull()).groupBy("date").pivot("series_id", ids).agg(F.first("value"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = wide.select("date", *[F.last(F.col(f"`{i}`"), True).over(w).alias(i) for i in ids])
    return filled.dropna("all", subset=ids).withColumn("spread", F.col(f"`{minuend}`") - F.col(f"`{subtrahend}`"))


def resolve_source(
    quotes: DataFrame, priority: DataFrame, n_symbols: Column, keys: list[str], share: float = 0.5
) -> DataFrame:
    """Rows of the first source, by priority, that covers ``share`` of the symbols.

    Where none does, the first non-empty source is kept and marked stale.
    """
    coverage = (
        quotes.groupBy(*keys, "source")
        .agg(F.countDistinct("symbol").alias("covered"))
        .join(priority, "source")
        .withColumn("ok", F.col("covered") >= n_symbols * share)
    )
    chosen = coverage.groupBy(*keys).agg(
        F.coalesce(
            F.min_by("source", F.when(F.col("ok"), F.col("priority"))),
            F.min_by("source", "priority"),
        ).alias("source"),
        (~F.bool_or("ok")).alias("stale"),
    )
    return quotes.join(chosen, [*keys, "source"])


def live_prices(quotes: DataFrame, priority: DataFrame, n_symbols: Column) -> DataFrame:
    """Newest usable price per symbol from the best covering source."""
    last = (
        quotes.filter("close is not null and close <> 0")
        .groupBy("source", "symbol")
        .agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))
    )
    return resolve_source(last, priority, n_symbols, [])


def data_quality(quotes: DataFrame, as_of: Column) -> DataFrame:
    """Use count, newest stamp and age in seconds per source."""
    return quotes.groupBy("source").agg(F.count("*").alias("used"), F.max("date").alias("last_fetch")).withColumn(
        "age_seconds",
        F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("last_fetch").cast("timestamp")),
    )


def equal_weight_portfolio(returns: DataFrame, value: str = "simple") -> DataFrame:
    """Row mean over symbols per date."""
    return returns.groupBy("t", "date").agg(F.avg(value).alias("ret"))


def index_series(closes: DataFrame, symbol: str) -> DataFrame:
    """One index as (date, value), nulls dropped."""
    return closes.filter((F.col("symbol") == symbol) & F.col("close").isNotNull()).select(
        "date", F.col("close").alias("value")
    )


def missing_symbols(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted symbols that the panel lacks."""
    return wanted.select("symbol").distinct().join(present.select("symbol").distinct(), "symbol", "left_anti")


def windows(returns: DataFrame, value: str, size: int, include_current: bool, out: str = "x") -> DataFrame:
    """One array of ``size`` returns per (t, symbol), oldest first.

    With ``include_current`` False the window ends on the day before ``t``, the label rule
    of the historical replay.
    """
    lo, hi = (-(size - 1), 0) if include_current else (-size, -1)
    w = Window.partitionBy("symbol").orderBy("t")
    return (
        returns.withColumn(out, F.collect_list(value).over(w.rowsBetween(lo, hi)))
        .filter(F.size(out) == size)
        .select("t", "date", "symbol", out)
    )


def as_of_fill(days: DataFrame, series: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Last known ``value`` on or before each day, null before the first stamp."""
    both = days.select(*keys, "date").withColumn("_day", F.lit(True)).withColumn(value, F.lit(None).cast("double"))
    stamps = series.select(*keys, "date", F.lit(False).alias("_day"), F.col(value).cast("double").alias(value))
    w = (
        Window.partitionBy(*keys)
        .orderBy("date", F.col("_day"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        both.unionByName(stamps)
        .withColumn("_v", F.last(value, True).over(w))
        .filter("_day")
        .select(*keys, "date", F.col("_v").alias(value))
    )

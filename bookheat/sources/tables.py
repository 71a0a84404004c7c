"""The analytics model derived from the given star-schema and event tables.

Prices come from line items by brand and week, books from customer spend, the volatility
index and macro series from orders, trades and ledgers from events. Tables that many jobs
share (panel, holdings) are staged once per application.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.operators import panel
from bookheat.session import least_parts, parts_of, spread, staged

BOOK_SYMBOLS = tuple(f"Brand#{i}" for i in range(1, 10))
FACTOR_SYMBOLS = tuple(f"Brand#{i}" for i in range(10, 19))
ALL_SYMBOLS = tuple(f"Brand#{i}" for i in range(1, 26))
MARKET_SYMBOL = "Brand#16"
CRISES = (
    ("first_half_1996", "1996-01-01", "1996-04-15", "1996-06-30"),
    ("second_half_1998", "1998-07-01", "1998-09-21", "1998-12-31"),
    ("first_half_2000", "2000-01-01", "2000-03-13", "2000-06-30"),
)
SOURCES = (("N", 1), ("A", 2), ("R", 3))
#: Parts up to which their brands go to every task.
MAX_BROADCAST_PARTS = 1_500_000
MACRO_SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def week(col: str):
    return F.to_date(F.date_trunc("week", F.col(col)))


def vwap():
    """Traded value over quantity; cents are summed as integers, so any partitioning gives equal bits."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return cents.cast("double") / 100 / F.sum("l_quantity")


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()


def _line_parts(spark: SparkSession, sf: str) -> int:
    return parts_of(spark, f"{sf}/lineitem.parquet", f"{sf}/orders.parquet")


def _joined(spark: SparkSession, sf: str, lines: DataFrame, other: DataFrame, line_key: str, key: str) -> DataFrame:
    """Line items with their row of ``other``; large tables meet in as many partitions as their size asks for."""
    n = _line_parts(spark, sf)
    if n > least_parts(spark):
        lines, other = spread(lines, line_key, parts=n), spread(other, key, parts=n)
    return lines.join(other, F.col(line_key) == F.col(key))


def _branded(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    """Line items with the ``symbol`` of their part, which goes to every task only after a count."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    if part.count() <= MAX_BROADCAST_PARTS:
        return lines.join(F.broadcast(part), F.col("l_partkey") == F.col("p_partkey"))
    return _joined(spark, sf, lines, part, "l_partkey", "p_partkey")


def by_book(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    """Rows hashed by book, into as many partitions as the books come from: frames placed so are grouped and joined without a shuffle."""
    return spread(df, "book_id", parts=_line_parts(spark, sf))


def closes(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly volume-weighted price per brand: (date, symbol, close)."""

    def build() -> DataFrame:
        lines = table(spark, sf, "lineitem").select("l_partkey", week("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
        return _branded(spark, sf, lines).groupBy("date", "symbol").agg(vwap().alias("close"))

    return staged(spark, sf, "closes", build)


def source_closes(spark: SparkSession, sf: str) -> DataFrame:
    """The same price quoted by three sources (the return flag): (source, date, symbol, close)."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return (
        table(spark, sf, "lineitem")
        .select(
            "l_partkey",
            week("l_shipdate").alias("date"),
            F.col("l_returnflag").alias("source"),
            "l_extendedprice",
            "l_quantity",
        )
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("source", "date", "symbol")
        .agg(vwap().alias("close"))
    )


def source_priority(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "source string, priority int")


def returns(spark: SparkSession, sf: str, fill: str | None = None) -> DataFrame:
    """Return panel (t, date, symbol, close, ret, simple)."""
    return staged(
        spark, sf, f"returns-{fill or 'strict'}", lambda: panel.log_returns(closes(spark, sf), fill=fill)
    )


def factor_dim(spark: SparkSession) -> DataFrame:
    """The nine factors mapped in order to nine brands."""
    return spark.createDataFrame(list(zip(FACTOR_SYMBOLS, C.FACTORS)), "symbol string, factor string")


def reference_book(spark: SparkSession) -> DataFrame:
    """One equally weighted book of nine brands."""
    rows = [("reference", s, 1.0 / len(BOOK_SYMBOLS)) for s in BOOK_SYMBOLS]
    return spark.createDataFrame(rows, "book_id string, symbol string, weight double")


def _bought(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by customer: (book_id, symbol, status, spend, shares, ordered)."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("spend"),
        F.col("l_quantity").alias("shares"),
    )
    lines = _branded(spark, sf, lines).select("l_orderkey", "symbol", "spend", "shares")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return _joined(spark, sf, lines, orders, "l_orderkey", "o_orderkey").select(
        F.col("o_custkey").alias("book_id"), "symbol", F.col("o_orderstatus").alias("status"), "spend", "shares", F.col("o_orderdate").alias("ordered")
    )


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Customer spend per brand and order status: (book_id, symbol, status, spend, shares, updated_at)."""

    def build() -> DataFrame:
        return (
            _bought(spark, sf)
            .groupBy("book_id", "symbol", "status")
            .agg(F.sum("spend").alias("spend"), F.sum("shares").alias("shares"), F.max("ordered").cast("timestamp").alias("updated_at"))
        )

    return staged(spark, sf, "holdings", build)


def _weights(h: DataFrame) -> DataFrame:
    """Weights of the books of ``h``, whose rows are shuffled once: sums by symbol and by book both keep to the placement by book.

    The number of partitions is fixed: a row takes many times its shuffled bytes in the maps and sorts of one task.
    """
    per = spread(h, "book_id").groupBy("book_id", "symbol").agg(
        F.sum("spend").alias("spend"), F.sum("shares").alias("shares"), F.max("updated_at").alias("updated_at")
    )
    total = F.sum("spend").over(Window.partitionBy("book_id"))
    return per.select("book_id", "symbol", (F.col("spend") / total).alias("weight"), "shares", "updated_at")


def packed_books(spark: SparkSession, sf: str) -> DataFrame:
    """All customer books, one row each: (book_id, items), the positions in order of symbols; staged.

    What a customer bought is shuffled once, by customer: sums by symbol, the list of the positions and their weights follow in the same task.
    """

    def build() -> DataFrame:
        per = by_book(spark, sf, _bought(spark, sf)).groupBy("book_id", "symbol").agg(
            F.sum("spend").alias("spend"), F.sum("shares").alias("shares"), F.max("ordered").cast("timestamp").alias("updated_at")
        )
        items = F.array_sort(F.collect_list(F.struct("symbol", "spend", "shares", "updated_at")))
        whole = per.groupBy("book_id").agg(items.alias("items"), F.sum("spend").alias("total"))

        def position(e: Column) -> Column:
            return F.struct(e["symbol"].alias("symbol"), (e["spend"] / F.col("total")).alias("weight"), e["shares"].alias("shares"), e["updated_at"].alias("updated_at"))

        return whole.select("book_id", F.transform("items", position).alias("items"))

    return staged(spark, sf, "books", build)


def books(spark: SparkSession, sf: str) -> DataFrame:
    """All customer books: (book_id, symbol, weight, shares, updated_at)."""
    return packed_books(spark, sf).select("book_id", F.inline("items"))


def books_by_status(spark: SparkSession, sf: str, status: str) -> DataFrame:
    """Books from the orders of one status; used as current book and as candidate update."""
    return _weights(holdings(spark, sf).filter(F.col("status") == status))


def settled_books(spark: SparkSession, sf: str) -> DataFrame:
    """Books from all orders that are not pending."""
    return _weights(holdings(spark, sf).filter(F.col("status") != "P"))


def vix(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly volatility proxy of order values: (date, vix)."""
    return (
        table(spark, sf, "orders")
        .groupBy(week("o_orderdate").alias("date"))
        .agg((100 * F.stddev_samp("o_totalprice") / F.avg("o_totalprice")).alias("vix"))
        .filter("vix is not null")
    )


def macro(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly mean order value per priority: (date, series_id, value)."""
    return (
        table(spark, sf, "orders")
        .groupBy(week("o_orderdate").alias("date"), F.col("o_orderpriority").alias("series_id"))
        .agg(F.avg("o_totalprice").alias("value"))
    )


def crises(spark: SparkSession) -> DataFrame:
    """Named crisis intervals, a fixed dimension."""
    return spark.createDataFrame(list(CRISES), "crisis string, start string, peak string, end string").select(
        "crisis", *[F.to_date(c).alias(c) for c in ("start", "peak", "end")]
    )


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Trades: (symbol, ts, price, size, seq)."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("size"),
        F.col("event_id").alias("seq"),
    )

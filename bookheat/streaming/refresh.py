"""Incremental heat: each batch of closes reads the stretch of rows that its days need, whatever the history.

Closes and components are kept in month folders. A day needs the ``window`` return rows before it and its books the
``history`` component rows before it, so a batch reads back from its first day by whole months, until enough rows are there, and
on to the newest day: an ordinary batch reads a fixed number of rows, a late one as many as it is late.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.operators import heat as H
from bookheat.operators import panel as P
from bookheat.session import folders
from bookheat.streaming import jobs as J

CLOSES = "date date, symbol string, close double"
PARTS = (
    "t int, date date, absorption_ratio double, turbulence double, div_ratio double, factor_hhi double, avg_corr double, "
    "dominant_factor string, top_pair string, top_corr double"
)


class Months:
    """A table in month folders. A batch that runs again replaces its own rows; rows of other batches stay."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def put(self, rows: DataFrame, batch_id: int) -> None:
        placed = rows.withColumns({"month": F.date_format("date", "yyyy-MM"), "batch": F.lit(batch_id)}).hint("rebalance", "month")
        placed.write.partitionBy("month", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def months(self) -> list[str]:
        return sorted(f.removeprefix("month=") for f in folders(self.spark, self.path) if f.startswith("month="))

    def since(self, month: str, batch_id: int, included: bool, only: bool = False) -> DataFrame:
        """Rows of this month and later, of the batches before ``batch_id`` (``included``: and its own, ``only``: its own).

        Other months are not looked at.
        """
        paths = [f"{self.path}/month={m}" for m in self.months() if m >= month]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.option("basePath", self.path).schema(f"{self.schema}, month string, batch int").parquet(*paths)
        at = F.col("batch")
        return rows.filter(at == batch_id if only else at <= batch_id if included else at < batch_id).drop("month", "batch")

    def reach(self, day: date, enough: Callable[[DataFrame], bool], batch_id: int, included: bool) -> str:
        """The latest month from which rows have ``enough`` before ``day``, by doubling steps; else the first month."""
        own = day.strftime("%Y-%m")
        earlier = [m for m in self.months() if m <= own]
        back = 1
        while back < len(earlier):
            if enough(self.since(earlier[-back], batch_id, included).filter(F.col("date") < F.lit(day))):
                return earlier[-back]
            back *= 2
        return earlier[0] if earlier else own


def _universe(batch: DataFrame, batch_id: int, path: str) -> int:
    """Number of symbols quoted so far; only new ones are written."""
    spark = batch.sparkSession
    quoted = batch.filter("close is not null").select("symbol").distinct()
    names = [f for f in folders(spark, path) if f.startswith("batch=") and int(f.removeprefix("batch=")) < batch_id]
    old = spark.read.schema("symbol string").parquet(*[f"{path}/{f}" for f in names]) if names else None
    fresh = quoted if old is None else quoted.join(old, "symbol", "left_anti")
    if names and fresh.isEmpty():
        return old.count()
    fresh.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return (old.count() if old is not None else 0) + spark.read.schema("symbol string").parquet(f"{path}/batch={batch_id}").count()


def heat_refresh(closes: DataFrame, books: DataFrame, factors: DataFrame, window: int = C.WINDOW_ROWS, history: int = C.HISTORY_ROWS) -> str:
    """Score the days that new closes complete and append them to the heat table.

    A day is scored once, with what is known then: its window holds the complete days before it, its ranks the
    scored days before it. ``t`` numbers days since 1970. A repeated batch replaces its rows. Returns the path of the heat batches.
    """
    kind = dict(books.dtypes)["book_id"]

    def score(batch: DataFrame, batch_id: int, path: str) -> None:
        spark = batch.sparkSession
        store = Months(spark, f"{path}-closes", CLOSES)
        parts = Months(spark, f"{path}-components", f"book_id {kind}, {PARTS}")
        rows = batch.select("date", "symbol", F.col("close").cast("double").alias("close"))
        first = rows.agg(F.min("date")).first()[0]
        if first is None:
            return
        store.put(rows, batch_id)
        n = _universe(rows, batch_id, f"{path}-symbols")
        start = store.reach(first, lambda before: P.date_grid(before, n).filter("complete").count() >= window, batch_id, True)
        returns = P.log_returns(store.since(start, batch_id, True), symbols=n).withColumn("t", F.datediff("date", F.lit(date(1970, 1, 1))))
        windowed = P.windows(returns, "simple", window, include_current=False).filter(F.col("date") >= F.lit(first))
        done = parts.since(first.strftime("%Y-%m"), batch_id, False).select("date").distinct()
        parts.put(H.components(books, windowed.join(done, "date", "left_anti"), factors), batch_id)
        start = parts.reach(first, lambda before: before.select("date").distinct().count() >= history - 1, batch_id, False)
        known = parts.since(start, batch_id, False)
        own = parts.since(first.strftime("%Y-%m"), batch_id, True, only=True)
        H.blend(own, known, history).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return J.run_available(closes, "append", "heat-refresh", score)

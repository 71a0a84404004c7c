"""Structured Streaming jobs: bars, counters, idempotent slots, alerts, book updates, heat refresh.

Sinks are idempotent: every micro-batch overwrites its own ``batch=<id>`` folder, so a batch that
is run again after a lost executor replaces its rows instead of adding them twice.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bookheat import constants as C
from bookheat.functions import rules as R
from bookheat.functions.windows import bucketed_count_if, bucketed_lag
from bookheat.operators import panel as P
from bookheat.session import scratch_path, spread, stage

# the runner that prepares a stateful processor does not see files shipped to the workers, so the
# processor travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a file stream, schema taken from the files."""
    pattern = f"{sf}/{name}*.parquet"
    return spark.readStream.schema(spark.read.parquet(pattern).schema).parquet(pattern)


def stream_of(df: DataFrame, tag: str, files_per_batch: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and opened as a file stream."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    reader = df.sparkSession.readStream.schema(df.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(
    stream: DataFrame,
    mode: str,
    tag: str,
    handle: Callable[[DataFrame, int, str], None] | None = None,
    before: Callable[[str], None] | None = None,
) -> str:
    """Run the stream over all available input into ``<path>/batch=<id>`` folders and return the path.

    ``handle`` takes a micro-batch instead of writing it there; ``before`` prepares the path.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, tag)
    if before is not None:
        before(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        if handle is None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        else:
            handle(batch, batch_id, path)

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, f"{tag}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path


def newest_batch(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest batch folder (complete mode and whole-table versions)."""
    df = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    newest = df.agg(F.max("batch")).scalar()
    return df.filter(F.col("batch") == newest).drop("batch")


def bars(ticks: DataFrame, width: str, watermark: str) -> DataFrame:
    """Tumbling bars with a watermark on trade time."""
    return P.ohlcv_bars(ticks.withWatermark("ts", watermark), width)


def trades_of(ticks: DataFrame, symbols: list[str]) -> DataFrame:
    """The subscribed symbols of a trade stream."""
    return ticks.filter(F.col("symbol").isin(symbols))


def tier_counts(ledger: DataFrame, watermark: str) -> DataFrame:
    """Deliveries per channel, tier and day as a running count."""
    return (
        ledger.withWatermark("utc", watermark)
        .groupBy("channel", "tier", F.window("utc", "1 day").alias("w"))
        .agg(F.count("*").alias("sent"))
        .select("channel", "tier", F.col("w.start").alias("day"), "sent")
    )


def first_per_date(rows: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    """First row per key and data date; the data date itself is the event time."""
    timed = rows.withColumn("event_time", F.col("date").cast("timestamp")).withWatermark("event_time", watermark)
    return timed.dropDuplicatesWithinWatermark([*keys, "date"]).drop("event_time")


def one_scheduled_summary(ledger: DataFrame, watermark: str) -> DataFrame:
    """At most one scheduled summary per (channel, day); manual sends and alerts never block it."""
    slots = ledger.filter((F.col("tier") == C.SUMMARY_TIER) & F.col("scheduled")).withColumn("date", F.col("et_date"))
    return first_per_date(slots, ["channel"], watermark)


# -- alerts -------------------------------------------------------------------
ALERT_OUT = "book_id long, ts timestamp, seq long, tier string"


class AlertProcessor(StatefulProcessor):
    """Per book: previous level and regime and the time of the last send of each tier, and the readings not yet in order.

    A reading waits until the watermark has passed it; a timer then releases what is due in order of time, whatever
    the order of arrival, so a late reading is judged in its place. Previous states move even when an alert is suppressed; a cooldown
    starts only with a send.
    """

    def __init__(self, cooldowns: dict[str, int]):
        self.cooldowns = cooldowns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "alerts", "level string, regime string, emergency double, level_change double, regime_shift double"
        )
        self.waiting = handle.getListState("waiting", "at long, seq long, level string, regime string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(at.tolist(), part["seq"].tolist(), part["level"].tolist(), part["regime"].tolist())))
            first = int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for row in self.waiting.get():
            (due if row[0] < until else rest).append(tuple(row))
        if not due:
            return
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(row[0] for row in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        level, regime, *last = self.state.get() if self.state.exists() else (None, None, None, None, None)
        sent = dict(zip(("emergency", "level_change", "regime_shift"), last))
        out = []
        for at, seq, new_level, new_regime in sorted(due, key=lambda row: row[:2]):
            now = at / 6e7
            wants = {
                "emergency": new_level == "emergency",
                "level_change": level is not None and new_level != level,
                "regime_shift": regime is not None and new_regime != regime and new_regime != "unknown",
            }
            for tier, wanted in wants.items():
                if wanted and (sent[tier] is None or now - sent[tier] >= self.cooldowns[tier]):
                    sent[tier] = now
                    out.append((key[0], pd.Timestamp(at, unit="us"), seq, tier))
            level, regime = new_level, new_regime
        self.state.update((level, regime, sent["emergency"], sent["level_change"], sent["regime_shift"]))
        if out:
            yield pd.DataFrame(out, columns=["book_id", "ts", "seq", "tier"])

    def close(self) -> None:
        pass


def alert_stream(readings: DataFrame, cooldowns: dict[str, int] | None = None, delay: str = "1 hour") -> DataFrame:
    """Alerts of a stream of (book_id, ts, seq, level, regime); readings may arrive out of order by up to ``delay``.

    Later ones are dropped, as by any watermark. A reading is judged when the watermark has passed it.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return readings.withWatermark("ts", delay).groupBy("book_id").transformWithStateInPandas(
        AlertProcessor(cooldowns or C.COOLDOWN_MINUTES), ALERT_OUT, "append", "eventTime"
    )


def alert_batch(readings: DataFrame, cooldowns: dict[str, int] | None = None) -> DataFrame:
    """The same alerts over a table.

    The tiers are independent, and a pause as long as the cooldown makes what follows independent
    of what came before. So candidates are cut into runs at such pauses and each (book, tier, run)
    streams through a task in time order with one number of state: a busy book spreads over tasks
    and no group is collected.
    """
    limits = cooldowns or C.COOLDOWN_MINUTES
    order, day = ["ts", "seq"], F.to_date("ts")
    df = bucketed_lag(readings, ["book_id"], order, day, {"pl": "level", "pr": "regime"})
    fires = {
        "emergency": F.col("level") == "emergency",
        "level_change": F.col("level") != F.col("pl"),
        "regime_shift": (F.col("regime") != F.col("pr")) & (F.col("regime") != "unknown"),
    }
    wanted = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fires.items()]))
    cand = (
        df.select("book_id", "ts", "seq", F.explode(wanted).alias("tier"))
        .withColumn("now", F.unix_micros("ts") / 6e7)
        .withColumn("limit", R.lookup(F.col("tier"), {k: float(v) for k, v in limits.items()}, 60.0))
    )
    # written once: the steps below read the candidates several times, the raw readings never again
    cand = stage(cand, "alert-candidates")
    group = ["book_id", "tier"]
    cand = bucketed_lag(cand, group, order, day, {"before": "now"})
    pause = F.coalesce(F.col("now") - F.col("before") >= F.col("limit"), F.lit(False))
    cand = bucketed_count_if(cand, group, order, day, pause, "run")
    keys = ["book_id", "tier", "run"]
    placed = spread(cand, *keys).sortWithinPartitions(*keys, "ts", "seq")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, 0.0
        for pdf in batches:
            keep = []
            for key, at, limit in zip(zip(pdf["book_id"], pdf["tier"], pdf["run"]), pdf["now"], pdf["limit"]):
                sent = key != current or at - last >= limit
                if sent:
                    current, last = key, at
                keep.append(sent)
            yield pdf.loc[keep, ["book_id", "ts", "seq", "tier"]]

    return placed.mapInPandas(pick, ALERT_OUT)


def should_alert(readings: DataFrame) -> DataFrame:
    """The plain rule: a first reading that is not cool, or any change of level."""
    df = bucketed_lag(readings, ["book_id"], ["ts", "seq"], F.to_date("ts"), {"prev": "level"})
    changed = F.when(F.col("prev").isNull(), F.col("level") != "cool").otherwise(F.col("level") != F.col("prev"))
    return df.withColumn("alert", changed)

"""Readers and writers: heat tables, ledgers, transcripts, calibration and wide CSV files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat.session import _hadoop, folders

MANIFEST = "table string, folder string, rows long"

LEDGER_SCHEMA = (
    "channel long, tier string, et_date date, et_time string, utc timestamp, scheduled boolean, message_id long, "
    "server_ts timestamp, heat_score double, positions array<string>, "
    "top_attributions array<struct<symbol:string,share:double>>, action string"
)
SESSION_SCHEMA = (
    "session_id string, platform string, session_start timestamp, messages array<struct<role:string,content:string>>"
)
SEED_FIELDS = ("ar", "turb", "dr", "hhi", "corr")


def append_heat(scored: DataFrame, path: str) -> None:
    """Append heat rows, one folder per day."""
    scored.write.mode("append").partitionBy("date").parquet(path)


def heat_history(
    spark: SparkSession, path: str, start: Column | None = None, end: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Heat rows between two days (inclusive), newest first. Only the day folders in range are read."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col("date") >= start)
    if end is not None:
        df = df.filter(F.col("date") <= end)
    df = df.orderBy(F.col("date").desc(), "book_id")
    return df.limit(limit) if limit else df


def commit_tables(tables: dict[str, DataFrame], path: str) -> int:
    """Write result tables as one version and return its number: readers see all of them or none.

    The tables go to a folder that nothing names yet; the commit is the rename of a manifest, which a store does at once. A
    writer that fails leaves the version before in force; of two writers one gets the number, the other tries the next.
    """
    spark = next(iter(tables.values())).sparkSession
    data = f"data/{uuid.uuid4().hex}"
    rows = []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{data}/{name}")
        rows.append((name, f"{data}/{name}", spark.read.parquet(f"{path}/{data}/{name}").count()))
    draft = f"{path}/drafts/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(draft)
    fs, source = _hadoop(spark, draft)
    version = max(versions(spark, path), default=0) + 1
    while True:
        _, target = _hadoop(spark, f"{path}/manifest/version={version}")
        fs.mkdirs(target.getParent())
        if not fs.exists(target) and fs.rename(source, target):
            return version
        version += 1


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    return sorted(int(f.removeprefix("version=")) for f in folders(spark, f"{path}/manifest") if f.startswith("version="))


def committed_tables(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version, the newest by default; none before the first commit."""
    known = versions(spark, path)
    if not known:
        return {}
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={version or known[-1]}")
    return {r["table"]: spark.read.parquet(f"{path}/{r['folder']}") for r in manifest.collect()}  # one row per table


def expire_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest versions, and data that no version names."""
    known = versions(spark, path)
    live = {r["folder"].split("/")[1] for v in known[-keep:] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={v}").collect()}
    gone = [f"manifest/version={v}" for v in known[:-keep]] + [f"data/{f}" for f in folders(spark, f"{path}/data") if f not in live]
    for name in gone:
        fs, p = _hadoop(spark, f"{path}/{name}")
        fs.delete(p, True)


def append_ledger(records: DataFrame, path: str) -> None:
    """Append JSON lines; absent optional fields are left out of the line."""
    records.write.mode("append").option("ignoreNullFields", "true").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER_SCHEMA) -> DataFrame:
    """JSON lines without the blank and corrupt ones."""
    df = (
        spark.read.schema(f"{schema}, _bad string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )
    return df.filter(F.col("_bad").isNull()).drop("_bad")


def explode_sessions(spark: SparkSession, path: str, platform: str, since: Column) -> DataFrame:
    """Messages of transcript files of one platform since a day; unreadable files are skipped."""
    df = (
        spark.read.schema(f"{SESSION_SCHEMA}, _bad string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )
    return (
        df.filter(F.col("_bad").isNull() & (F.col("platform") == platform) & (F.to_date("session_start") >= since))
        .select("session_id", "platform", "session_start", F.posexplode("messages").alias("idx", "m"))
        .select("session_id", "platform", "session_start", "idx", "m.role", "m.content")
    )


def load_calibration(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Component histories (ar, turb, dr, hhi, corr) from a list of day records or a dictionary of lists.

    Records carry the diversification ratio and are inverted; dictionaries hold the inverse already.
    """
    raw = spark.read.option("multiLine", multiline).json(path)
    if "ar" in raw.columns:
        return raw.select(F.explode(F.arrays_zip(*[f for f in SEED_FIELDS if f in raw.columns])).alias("e")).select("e.*")
    return raw.select(
        F.col("absorption_ratio").alias("ar"),
        F.col("turbulence").alias("turb"),
        (1.0 / F.greatest("div_ratio", F.lit(0.01))).alias("dr"),
        F.col("factor_hhi").alias("hhi"),
        F.col("avg_corr").alias("corr"),
    )


def parse_heat_history(df: DataFrame, keep_zero: bool = False) -> DataFrame:
    """(date, score) from rows with alternative field names; what cannot be parsed is dropped.

    ``keep_zero`` False drops a score of zero, as a chain of fallbacks on truth values would.
    """
    def first(names: tuple[str, ...], parse) -> Column:
        have = [parse(F.col(n)) for n in names if n in df.columns]
        return F.coalesce(*have) if have else F.lit(None)

    def number(c: Column) -> Column:
        v = c.try_cast("double")
        return v if keep_zero else F.nullif(v, F.lit(0.0))

    day = first(("date", "timestamp", "time"), lambda c: F.try_to_timestamp(c))
    return (
        df.select(day.alias("date"), first(("score", "heat_score", "value"), number).alias("score"))
        .dropna()
        .orderBy("date")
    )


def wide_csv_returns(spark: SparkSession, path: str, symbols: list[str]) -> DataFrame:
    """Long (date, symbol, ret) from a CSV with one column per symbol."""
    quoted = [f"`{s}` double" for s in symbols]
    wide = spark.read.schema("date date, " + ", ".join(quoted)).option("header", True).csv(path)
    return wide.unpivot("date", [F.col(f"`{s}`") for s in symbols], "symbol", "ret").filter("ret is not null")

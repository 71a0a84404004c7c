"""Books as a log-structured table: a batch writes the books it changes, and nothing else.

A table is a set of segments, each a folder of rows in buckets by book. A manifest per batch lists the live segments and is written
last, so a reader sees a batch as a whole or not at all, and a batch that runs again replaces what it wrote. Of a book's
rows, those of the newest ``seq`` count; a row without symbol says that the book is gone. When ``FAN`` segments of a
size class have gathered they are merged into one of the next class, so a row is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat.operators import books as B
from bookheat.session import _hadoop, folders
from bookheat.streaming import jobs as J

FAN = 4
#: Rows of the smallest size class.
SMALL = 100_000
BUCKETS = 16


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(F.col("book_id").cast("string")), F.lit(buckets)).cast("int")


class Log:
    """Rows with ``book_id`` and ``seq`` in segments; ``newest_only`` says that older rows of a book are dead."""

    def __init__(self, spark: SparkSession, path: str, schema: str, newest_only: bool = True, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.newest_only, self.buckets = spark, path, schema, newest_only, buckets

    def manifest(self, before: int | None = None) -> dict[str, int]:
        """Live segments and their rows, by the newest manifest (of a batch before ``before``)."""
        ids = [int(f.removeprefix("batch=")) for f in folders(self.spark, f"{self.path}/manifest") if f.startswith("batch=")]
        ids = [i for i in ids if before is None or i < before]
        if not ids:
            return {}
        rows = self.spark.read.schema("name string, rows long").parquet(f"{self.path}/manifest/batch={max(ids)}")
        return {r["name"]: r["rows"] for r in rows.filter("name is not null").collect()}  # one row per segment

    def read(self, segments: dict[str, int], books: DataFrame | None = None) -> DataFrame:
        """Rows of the segments; with ``books``, only those of these books, from their buckets."""
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/segments/{name}" for name in segments]
        rows = self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", f"{self.path}/segments").parquet(*paths)
        if books is not None:
            touched = [r[0] for r in books.select(_bucket(self.buckets)).distinct().collect()]  # at most ``buckets``
            rows = rows.filter(F.col("bucket").isin(touched)).join(books.select("book_id").distinct(), "book_id", "left_semi")
        return rows.drop("bucket").select(*self.spark.createDataFrame([], self.schema).columns)

    def newest(self, rows: DataFrame) -> DataFrame:
        last = rows.groupBy("book_id").agg(F.max("seq").alias("last"))
        return rows.join(last, "book_id").filter("seq = last").drop("last")

    def _write(self, rows: DataFrame, name: str) -> int:
        placed = rows.withColumn("bucket", _bucket(self.buckets)).hint("rebalance", "bucket")
        placed.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/segments/{name}")
        made = folders(self.spark, f"{self.path}/segments/{name}")
        return self.read({name: 0}).count() if any(f.startswith("bucket=") for f in made) else 0

    def commit(self, rows: DataFrame, batch_id: int, live=None) -> None:
        """Add a segment, merge size classes that are full, then publish the manifest.

        ``live`` drops dead rows while merging (all rows live by default, or the newest of each book).
        """
        segments = self.manifest(before=batch_id)
        name = f"segment=b{batch_id}"
        count = self._write(rows, name)
        if count:
            segments[name] = count
        step = 0
        while True:
            classes: dict[int, list[str]] = {}
            for s, n in segments.items():
                classes.setdefault(int(math.log(max(1, n / SMALL), FAN)), []).append(s)
            full = next((c for _, c in sorted(classes.items()) if len(c) >= FAN), None)
            if full is None:
                break
            merged = self.read({s: segments[s] for s in full})
            if self.newest_only:
                merged = self.newest(merged)
                # with all segments merged there is nothing left that a deletion could hide
                if len(full) == len(segments):
                    merged = merged.filter("symbol is not null")
            if live is not None:
                merged = live(merged)
            name, step = f"segment=m{batch_id}-{step}", step + 1
            count = self._write(merged, name)
            segments = {s: n for s, n in segments.items() if s not in full} | ({name: count} if count else {})
        rows = self.spark.createDataFrame([*segments.items()] or [(None, 0)], "name string, rows long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete the segments that none of the newest ``keep`` manifests lists, and older manifests."""
        ids = sorted(int(f.removeprefix("batch=")) for f in folders(self.spark, f"{self.path}/manifest") if f.startswith("batch="))
        live: set[str] = set().union(*(self.manifest(before=i + 1) for i in ids[-keep:]))
        dead = [f"segments/{s}" for s in folders(self.spark, f"{self.path}/segments") if s not in live]
        for name in dead + [f"manifest/batch={i}" for i in ids[:-keep]]:
            fs, p = _hadoop(self.spark, f"{self.path}/{name}")
            fs.delete(p, True)


def _log(spark: SparkSession, path: str, columns: DataFrame, buckets: int) -> Log:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields if f.name not in ("version", "positions")]
    return Log(spark, path, ", ".join([*fields, "seq long"]), True, buckets)


def book_updates(candidates: DataFrame, start: DataFrame, tolerance: float = 0.05, buckets: int = BUCKETS) -> str:
    """Apply streamed candidate books to a log-structured table and return its path; ``current_books`` reads it.

    Candidates carry ``version`` and ``positions``, the number of rows of that version; a version of no positions (one row
    without symbol) deletes its book. Rows wait until all of a version have arrived, in whatever batches; then the newest complete
    version of a book replaces it. One that fails the checks leaves its book as it was. A batch reads the
    waiting rows of its own books, not the table, and writes the books it changes.
    """
    shape = start.limit(0)

    def apply(batch: DataFrame, batch_id: int, path: str) -> None:
        spark = batch.sparkSession
        table = _log(spark, f"{path}-table", shape, buckets)
        waiting = Log(spark, f"{path}-waiting", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields) + ", seq long", False, buckets)
        applied = Log(spark, f"{path}-applied", f"book_id {dict(batch.dtypes)['book_id']}, symbol string, version long, seq long", True, buckets)
        own = batch.select("book_id").distinct()
        done = applied.newest(applied.read(applied.manifest(before=batch_id), own)).select("book_id", F.col("version").alias("done"))
        seen = batch.unionByName(waiting.read(waiting.manifest(before=batch_id), own).drop("seq"))
        seen = seen.join(done, "book_id", "left").filter("done is null or version > done").drop("done")
        whole = seen.groupBy("book_id", "version").agg((F.count("symbol") >= F.max("positions")).alias("whole"))
        last = whole.filter("whole").groupBy("book_id").agg(F.max("version").cast("long").alias("last"))
        ready = seen.join(last, "book_id").filter("version = last").drop("version", "positions", "last")
        gone = ready.filter("symbol is null").select("book_id").distinct()
        filled = ready.filter("symbol is not null")
        valid = B.validate_books(filled, tolerance).filter("valid").select("book_id")
        emptied = gone.join(filled.select("book_id").distinct(), "book_id", "left_anti")
        changed = filled.join(valid, "book_id", "left_semi").unionByName(ready.filter("symbol is null").join(emptied, "book_id", "left_semi"))
        seq = F.lit(batch_id + 1).cast("long").alias("seq")
        table.commit(changed.select(*shape.columns, seq), batch_id)
        waiting.commit(batch.select("*", seq), batch_id, lambda rows: _still_waiting(rows, applied, batch_id))
        applied.commit(last.select("book_id", F.lit("").alias("symbol"), F.col("last").alias("version"), seq), batch_id)

    path = J.run_available(candidates, "append", "book-updates", apply, lambda path: _log(start.sparkSession, f"{path}-table", shape, buckets).commit(start.withColumn("seq", F.lit(0).cast("long")), -1))
    return f"{path}-table"


def _still_waiting(rows: DataFrame, applied: Log, batch_id: int) -> DataFrame:
    done = applied.newest(applied.read(applied.manifest(before=batch_id))).select("book_id", F.col("version").alias("done"))
    return rows.join(done, "book_id", "left").filter("done is null or version > done").drop("done")


def current_books(spark: SparkSession, path: str, like: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The books in force: the newest rows of every book that is not gone."""
    log = _log(spark, path, like, buckets)
    return log.newest(log.read(log.manifest())).filter("symbol is not null").drop("seq")


def live_history(history: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of a symbol-keyed history (``book_id``, ``date``, ...) since each book last changed.

    ``changes`` (``book_id``, ``changed_on``) may name a book many times; what was recorded for an earlier book of that
    name is not compared with the new one.
    """
    last = changes.groupBy("book_id").agg(F.max("changed_on").alias("changed_on"))
    kept = history.join(last, "book_id", "left").filter("changed_on is null or date >= changed_on")
    return kept.drop("changed_on")

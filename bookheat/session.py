"""Session helpers: session settings and staged (materialised) tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of source files whose rows make one partition of a shuffle.
PARTITION_BYTES = 16_000_000
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_staged: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}


def get_session(app: str = "bookheat", cpus: str | int = "*") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def ship_package(spark: SparkSession) -> None:
    """Let local Python workers import this package whatever the working directory.

    A cluster gets the package with ``--py-files`` or an installed wheel.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped or not sc.master.startswith("local"):
        return
    root = Path(__file__).resolve().parent
    target = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/bookheat.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"bookheat/{f.relative_to(root)}")
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably (a lost executor re-reads files, it does not recompute)
    and gives the optimizer true sizes, so later joins broadcast by measured bytes.
    Shuffle files of the write are deleted with its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """File system and path of a folder, whatever its scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a folder; none if it is not there."""
    fs, p = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def source_version(spark: SparkSession, source: str) -> tuple:
    """Names, sizes and times of the files below ``source``."""
    fs, path = _hadoop(spark, source)
    files, found = fs.listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def staged(spark: SparkSession, source: str, tag: str, build) -> DataFrame:
    """``build()`` staged once per application, source folder and version of its files."""
    key, version = (spark.sparkContext.applicationId, source, tag), source_version(spark, source)
    if key not in _staged or _staged[key][0] != version:
        _staged[key] = (version, stage(build(), tag))
    return _staged[key][1]


def clear_staged(spark: SparkSession) -> None:
    """Forget all staged tables of this application and delete their files."""
    for key in [k for k in _staged if k[0] == spark.sparkContext.applicationId]:
        for file in _staged.pop(key)[1].inputFiles()[:1]:
            fs, path = _hadoop(spark, file.rpartition("/")[0])
            fs.delete(path, True)


def least_parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def parts_of(spark: SparkSession, *sources: str) -> int:
    """Partitions for the rows of source files: their number grows with the files, a task's share does not."""
    size = sum(length for s in sources for _, length, _ in source_version(spark, s))
    return max(least_parts(spark), -(-size // PARTITION_BYTES))


def spread(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Hash rows by key over all shuffle partitions, or over ``parts``.

    The fixed count keeps adaptive execution from folding compute-heavy groups, which are small
    in bytes, into one task.
    """
    return df.repartition(parts or least_parts(df.sparkSession), *keys)


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows.

    The count stops at ``max_rows + 1``; a larger frame is left to the shuffle joins.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Round for reporting; adding 0.0 turns a negative zero into zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)

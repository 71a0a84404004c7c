"""Ordered per-key expressions that survive a key holding a large share of all rows.

A plain window sorts a whole key in one task. Here a key is cut into time buckets; rows are
ordered within (key, bucket) and only one summary row per bucket travels along the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_lag(df: DataFrame, keys: list[str], order: list[str], bucket: Column, cols: dict[str, str]) -> DataFrame:
    """Adds ``new: lag(old)`` for every entry of ``cols`` along ``order`` within ``keys``."""
    df = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    value = F.struct(*[F.col(old).alias(new) for new, old in cols.items()])
    last = df.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select(
        *keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried")
    )
    out = df.withColumn("_lag", F.lag(value).over(inside)).join(carried, [*keys, "_bucket"])
    out = out.withColumn("_lag", F.coalesce("_lag", "_carried"))
    return out.select(*[c for c in out.columns if not c.startswith("_")], *[F.col(f"_lag.{n}").alias(n) for n in cols])


def bucketed_count_if(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, flag: Column, name: str
) -> DataFrame:
    """Adds the running count of ``flag`` along ``order`` within ``keys``."""
    df = df.withColumn("_bucket", bucket).withColumn("_flag", flag)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = (
        df.groupBy(*keys, "_bucket")
        .agg(F.count_if("_flag").alias("_hits"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_hits").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        df.withColumn(name, F.count_if("_flag").over(inside))
        .join(offset, [*keys, "_bucket"])
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_bucket", "_flag", "_offset")
    )

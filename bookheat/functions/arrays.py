"""Array expressions for windowed return vectors (JVM side, no Python rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def with_centered(df: DataFrame, x: str, out: str) -> DataFrame:
    """``out`` = (x - mean)/sqrt(n-1): inner products are sample covariances."""
    n = F.size(x)
    return (
        df.withColumn("_m", total(F.col(x)) / n)
        .withColumn(out, F.transform(x, lambda v: (v - F.col("_m")) / F.sqrt(n - F.lit(1.0))))
        .drop("_m")
    )


def with_unit(df: DataFrame, c: str, out: str) -> DataFrame:
    """``out`` = c/|c|, zero for a zero vector: inner products of centred vectors are correlations."""
    return (
        df.withColumn("_s", F.sqrt(dot(F.col(c), F.col(c))))
        .withColumn(out, F.transform(c, lambda v: F.when(F.col("_s") > 0, v / F.col("_s")).otherwise(F.lit(0.0))))
        .drop("_s")
    )


def with_ewma_centered(df: DataFrame, x: str, out: str, span: int, debias: bool = False) -> DataFrame:
    """``out`` = sqrt(w/Σw)·(x - weighted mean): inner products are EWMA covariances.

    Weights are (1-a)^age with a = 2/(span+1), newest element last. ``debias`` multiplies by
    Σw²-corrected 1/(1 - Σw²/(Σw)²), which cancels in correlations.
    """
    decay = 1 - 2.0 / (span + 1)
    w = F.transform(x, lambda v, i: F.pow(F.lit(decay), F.size(x) - 1 - i))
    out_df = (
        df.withColumn("_w", w)
        .withColumn("_sw", total(F.col("_w")))
        .withColumn("_m", dot(F.col(x), F.col("_w")) / F.col("_sw"))
    )
    scale = 1 / F.col("_sw")
    if debias:
        out_df = out_df.withColumn("_sq", dot(F.col("_w"), F.col("_w")))
        scale = F.col("_sw") / (F.col("_sw") * F.col("_sw") - F.col("_sq"))
    return (
        out_df.withColumn("_f", scale)
        .withColumn(out, F.zip_with(x, "_w", lambda v, u: F.sqrt(u * F.col("_f")) * (v - F.col("_m"))))
        .drop("_w", "_sw", "_m", "_f", "_sq")
    )


def vector_sum(df: DataFrame, keys: list[str], vec: Column, name: str) -> DataFrame:
    """Element-wise sum of equally long vectors per key: (keys, _k, name).

    The outer form keeps the optimizer from copying the vector expression into a size filter.
    """
    return (
        df.select(*keys, F.posexplode_outer(vec).alias("_k", "_v"))
        .groupBy(*keys, "_k")
        .agg(F.sum("_v").alias(name))
    )

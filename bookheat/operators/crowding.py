"""Crowding composite per (book, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookheat import constants as C
from bookheat.functions import rules as R
from bookheat.operators import metrics as M
from bookheat.operators import moments as MM


def concentration(hhi: DataFrame) -> DataFrame:
    """(HHI - 1/n)/(1 - 1/n) clipped to [0, 1]."""
    floor = 1.0 / F.col("n_factors")
    value = F.coalesce(F.try_divide(F.col("factor_hhi") - floor, 1 - floor), F.lit(0.0))
    return hhi.select(
        "book_id",
        "t",
        F.when(F.col("factor_hhi") == 0, 0.0).otherwise(R.clip(value, 0.0, 1.0)).alias("factor_concentration"),
        "dominant_factor",
    )


def dispersion(books: DataFrame, returns: DataFrame, value: str, window: int) -> DataFrame:
    """Mean cross-sectional deviation of the ``window`` days before t, ranked inversely in history."""
    per = (
        books.select("book_id", "symbol")
        .join(returns.select("t", "symbol", value), "symbol")
        .groupBy("book_id", "t")
        .agg(F.stddev_samp(value).alias("cs"), F.count("*").alias("n"))
    )
    before = Window.partitionBy("book_id").orderBy("t").rowsBetween(-window, -1)
    d = per.withColumn("dispersion", F.avg("cs").over(before)).withColumn("rows", F.count("*").over(before))
    d = d.filter(F.col("rows") == window)
    rank = M.inv_pct_rank_excl("dispersion", ["book_id"], "t")
    return d.select(
        "book_id", "t", "dispersion", F.when(F.col("n") < 2, 0.5).otherwise(rank).alias("return_dispersion")
    )


def comovement(windowed: DataFrame, factors: DataFrame) -> DataFrame:
    """Mean sample correlation between factors per day, mapped to [0, 1]."""
    z = MM.sample_vectors(windowed.join(factors, "symbol", "left_semi")).select("t", "symbol", "z")
    return MM.avg_pairwise(z, ["t"]).select(
        "t",
        F.when(F.col("n") < 2, 0.0).otherwise(R.range_normalise(F.col("avg_corr"))).alias("factor_comovement"),
    )


def beta_convergence(books: DataFrame, windowed: DataFrame, market: str) -> DataFrame:
    """Population deviation of market betas per (book, day), ranked inversely in history."""
    betas = MM.market_beta(windowed, market, ["t"])
    per = (
        books.select("book_id", "symbol")
        .join(betas, "symbol")
        .groupBy("book_id", "t")
        .agg(F.stddev_pop("beta").alias("beta_std"), F.count("beta").alias("n"))
    )
    rank = M.inv_pct_rank_excl("beta_std", ["book_id"], "t")
    return per.select(
        "book_id", "t", "beta_std", F.when(F.col("n") < 2, 0.5).otherwise(rank).alias("beta_convergence")
    )


def crowding(
    books: DataFrame,
    returns: DataFrame,
    windowed: DataFrame,
    hhi: DataFrame,
    avg_corr: DataFrame,
    factors: DataFrame,
    market: str,
    window: int = C.WINDOW_ROWS,
) -> DataFrame:
    """All five signals, their blend, its level, percentile and contrarian signal."""
    keys = ["book_id", "t"]
    df = (
        concentration(hhi)
        .join(dispersion(books, returns, "simple", window), keys)
        .join(beta_convergence(books, windowed, market), keys)
        .join(avg_corr.select(*keys, R.range_normalise(F.col("avg_corr")).alias("correlation_level")), keys)
        .join(comovement(windowed, factors), "t")
    )
    blend = sum((F.col(k) * w for k, w in C.CROWDING_WEIGHTS.items()), F.lit(0.0))
    df = df.withColumn("crowding_score", R.clip(blend, 0.0, 1.0))
    return (
        df.withColumn("percentile", M.pct_rank_excl("crowding_score", ["book_id"], "t"))
        .withColumn("crowding_level", R.crowding_level(F.col("crowding_score")))
        .withColumn("crowding_alpha", R.crowding_alpha(F.col("percentile")))
        .withColumnRenamed("dominant_factor", "most_crowded_factor")
    )

"""Books of positions: validation, updates, set comparisons, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_symbol(c: Column | str) -> Column:
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def validate_books(books: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row per book: (book_id, positions, total_weight, reason, valid).

    The first failing rule names the reason: blank symbol, duplicate symbol, non-positive
    weight, weight sum away from one. An empty book has no row and never replaces anything.
    """
    per_symbol = books.groupBy("book_id", clean_symbol("symbol").alias("symbol")).agg(
        F.count("*").alias("n"),
        F.sum("weight").alias("w"),
        F.count_if(F.col("weight").isNull() | (F.col("weight") <= 0)).alias("bad"),
    )
    return (
        per_symbol.groupBy("book_id")
        .agg(
            F.sum("n").alias("positions"),
            F.sum("w").alias("total_weight"),
            F.count_if(F.col("symbol").isNull() | (F.col("symbol") == "")).alias("blank"),
            F.count_if(F.col("n") > 1).alias("dupes"),
            F.sum("bad").alias("bad"),
        )
        .withColumn(
            "reason",
            F.when(F.col("blank") > 0, "a position has an empty symbol")
            .when(F.col("dupes") > 0, "duplicate symbols")
            .when(F.col("bad") > 0, "a position has non-positive weight")
            .when(F.abs(F.col("total_weight") - 1) > tolerance, "weights do not sum to one"),
        )
        .select("book_id", "positions", "total_weight", "reason", F.col("reason").isNull().alias("valid"))
    )


def apply_book_updates(current: DataFrame, candidate: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Swap whole books: a valid candidate replaces its book, an invalid one changes nothing."""
    valid = validate_books(candidate, tolerance).filter("valid").select("book_id")
    fresh = candidate.join(valid, "book_id", "left_semi")
    kept = current.join(valid, "book_id", "left_anti")
    return fresh.unionByName(kept)


def upsert_positions(current: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by (book, symbol); the newest row wins, new rows win ties."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("book_id", "symbol").orderBy(F.col("_new").desc(), F.col("updated_at").desc())
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")


def delete_positions(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Remove positions whose upper-cased symbol is listed for the book."""
    gone = keys.select("book_id", clean_symbol("symbol").alias("_s")).distinct()
    return (
        current.withColumn("_s", clean_symbol("symbol")).join(gone, ["book_id", "_s"], "left_anti").drop("_s")
    )


def positions_by_weight(books: DataFrame) -> DataFrame:
    return books.orderBy(F.col("weight").desc(), "book_id", "symbol")


def gross_exposure(books: DataFrame) -> DataFrame:
    return books.groupBy("book_id").agg(F.sum(F.abs("weight")).alias("gross"))


def same_book(left: DataFrame, right: DataFrame) -> DataFrame:
    """Do two versions of each book hold the same set of upper-cased symbols?"""

    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("book_id").agg(F.array_sort(F.collect_set(clean_symbol("symbol"))).alias(name))

    return (
        sets(left, "l")
        .join(sets(right, "r"), "book_id", "full_outer")
        .select("book_id", F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("match"))
    )


def compare_weights(actual: DataFrame, target: DataFrame) -> DataFrame:
    """Actual against target weights in percent; a missing side counts as zero."""
    a = actual.select("book_id", "symbol", F.col("weight").alias("a"))
    b = target.select("book_id", "symbol", F.col("weight").alias("b"))
    return a.join(b, ["book_id", "symbol"], "full_outer").select(
        "book_id",
        "symbol",
        (F.coalesce("a", F.lit(0.0)) * 100).alias("actual_pct"),
        (F.coalesce("b", F.lit(0.0)) * 100).alias("target_pct"),
    )

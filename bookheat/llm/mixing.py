"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key (the MD5 of seed, id and text). Keys order the documents inside
their source. The key's first three hex digits cut a source into 4,096 ranges of equal width, so a
range sort needs no sampling and no task ever holds a whole source: sums per range give each range its
offset (a prefix sum over at most 4,096 rows of a source), and a window inside the range finishes the
prefix sum of each document. The mix is cut exactly at the source's budget; a budget above the size of
the source repeats whole passes first.

Targets: the sources in code point order (null last) weigh 3, 1, 2, 3, 1, 2 and so on and share
``share`` times all words; no target exceeds ``most`` times its source, and what is above goes to the
others by weight. The level at which that ends is found in one pass over the sources, ordered by
their cap per unit of weight.

Cases: a null text counts as empty, a null id as one more id; empty documents have size 0 and take 0
words. Rows that are equal in every respect are taken in any order, which gives the same rows. A source
of empty documents only has target 0. No rows give no rows. Columns of the input that are named like
new ones, in either case of letters, are replaced; all others pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookheat.llm.common import other_columns, row_of, unpacked, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"
NEW = ("size", "source_size", "target", "taken", "copies")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Sources (``_null``, ``_source``, ``_size``) with their ``_target`` words.

    One row per source goes through the two windows without partition.
    """
    by_name = W.orderBy("_null", "_source")
    by_cap = W.orderBy("_ratio", "_null", "_source")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ladder = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.withColumn("_w", F.element_at(ladder, (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int")))
        .withColumn("_cap", F.col("_size") * float(most))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    )
    rows = rows.select(
        "*",
        (F.sum(F.col("_size").cast("double")).over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).alias("_rest"),
        (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))).alias("_weight"),
    )
    # the first source, by cap per weight, that the level reached so far does not fill ends the search
    full = F.col("_ratio") <= F.col("_rest") / F.col("_weight")
    rows = rows.withColumn("_full", full)
    stop = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_null", "_source", "_rest", "_weight"))).over(every)
    rows = rows.withColumn("_stop", stop)
    return rows.select(
        "_null",
        "_source",
        "_size",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_stop._rest") / F.col("_stop._weight")).alias("_target"),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` (words) and ``copies``.

    ``copies`` counts the passes that take the document, the one cut inside it included.
    """
    keep = other_columns(docs, *NEW)
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        row_of(keep).alias("_row"),
        F.col(source).isNull().alias("_null"),
        F.coalesce(F.col(source), F.lit("")).alias("_source"),
        word_count(body).alias("_n"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), body)).alias("_key"),
    ).withColumn("_range", F.substring("_key", 1, 3))
    group = ["_null", "_source"]
    ranges = base.groupBy(*group, "_range").agg(F.sum("_n").alias("_sum"))
    sizes = ranges.groupBy(*group).agg(F.sum("_sum").alias("_size"))
    running = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select(*group, "_range", F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_offset"))
    offsets = offsets.join(targets(sizes, weights, share, most), group)
    inside = W.partitionBy(*group, "_range").orderBy("_key", "_n").rowsBetween(W.unboundedPreceding, -1)
    placed = base.join(offsets, [*group, "_range"]).withColumn(
        "_before", F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    budget = F.floor("_target").cast("long")
    size = F.col("_size")
    passes = F.when(size > 0, F.floor(budget / size)).otherwise(F.lit(0)).cast("long")
    rest = budget - passes * size
    left = F.greatest(F.lit(0), F.least(F.col("_n"), rest - F.col("_before"))).cast("long")
    started = F.when(size == 0, F.lit(1)).otherwise((F.col("_before") < rest).cast("int"))
    return placed.select(
        *unpacked(keep, "_row"),
        F.col("_n").alias("size"),
        size.cast("long").alias("source_size"),
        F.col("_target").alias("target"),
        (passes * F.col("_n") + left).alias("taken"),
        (passes + started).cast("int").alias("copies"),
    )

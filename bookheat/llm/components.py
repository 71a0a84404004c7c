"""Distributed connected components by alternating large-star and small-star rounds.

Edges are rows; each round is a few joins and minima with map-side combine, written to the shared folder,
so a lost executor rereads files and no lineage grows. Only the answer to "are these stars yet?" reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookheat.session import stage


def _stars(edges: DataFrame) -> bool:
    """Each node has one centre and no centre has another."""
    twice = edges.groupBy("u").count().filter("count > 1").select("u")
    chained = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
    return twice.unionAll(chained).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Loops and edges with a null end are ignored; repeated edges count once.
    """
    pairs = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stage(pairs, "links")
    while not _stars(now):
        now = stage(_small_star(stage(_large_star(now), "links")), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def local_roots(a, b, n: int):
    """Smallest member (by number) of each of ``n`` nodes' component under the pairs ``a``, ``b``."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return root
        root = new

"""Modularity communities by rounds of joins and aggregates on the edge table; no graph is ever gathered.

A round finds, for every node, the neighbouring community that it would gain most by joining. Of all wanted moves those are made that
are the best in the community they leave and in the one they enter: they touch disjoint communities, so their gains are exact and
add up, and modularity rises with every round. When no node wants to move, communities become nodes and the rounds go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookheat.session import stage

EPS = 1e-12


def _moves(links: DataFrame, own: DataFrame, resolution: float) -> DataFrame:
    """(book_id, node, c, new) of the moves of one round. ``links`` (book_id, a, b, w) has both directions, loops count twice."""
    degree = links.groupBy("book_id", F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    total = degree.groupBy("book_id").agg(F.sum("k").alias("m2"))
    placed = own.join(degree, ["book_id", "node"]).join(total, "book_id")
    size = placed.groupBy("book_id", "c").agg(F.sum("k").alias("tot"))
    other = own.select("book_id", F.col("node").alias("b"), F.col("c").alias("to"))
    toward = links.filter("a <> b").join(other, ["book_id", "b"]).groupBy("book_id", F.col("a").alias("node"), "to").agg(F.sum("w").alias("into"))
    # the community a node is in always stands for comparison, linked or not
    options = toward.unionByName(own.select("book_id", "node", F.col("c").alias("to"), F.lit(0.0).alias("into")))
    options = options.groupBy("book_id", "node", "to").agg(F.sum("into").alias("into"))
    options = options.join(placed, ["book_id", "node"]).join(size.select("book_id", F.col("c").alias("to"), "tot"), ["book_id", "to"])
    stays = F.col("to") == F.col("c")
    gain = F.col("into") - F.lit(resolution) * F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / F.col("m2")
    best = (
        options.withColumn("gain", gain)
        .groupBy("book_id", "node", "c")
        .agg(F.max(F.when(stays, F.col("gain"))).alias("stay"), F.max(F.when(~stays, F.struct("gain", "to"))).alias("go"))
        .withColumn("plus", F.col("go.gain") - F.col("stay"))
        .filter(F.col("plus") > EPS)
        .select("book_id", "node", "c", F.col("go.to").alias("new"), F.struct("plus", "node").alias("rank"))
    )
    touched = best.select("book_id", F.explode(F.array("c", "new")).alias("t"), "rank").groupBy("book_id", "t").agg(F.max("rank").alias("top"))
    leave = touched.select("book_id", F.col("t").alias("c"), F.col("top").alias("top_c"))
    enter = touched.select("book_id", F.col("t").alias("new"), F.col("top").alias("top_n"))
    return best.join(leave, ["book_id", "c"]).join(enter, ["book_id", "new"]).filter("rank = top_c and rank = top_n").select("book_id", "node", "c", "new")


def communities_by_rounds(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(book_id, symbol, cluster_id) of the graphs of all books, ``edges`` (book_id, src, dst, weight) once per pair.

    Nodes without edges get a cluster of their own; clusters are numbered by their first symbol.
    """
    ends = edges.filter("src <> dst and weight > 0")
    links = ends.select("book_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))
    links = links.unionByName(links.select("book_id", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    links = stage(links.groupBy("book_id", "a", "b").agg(F.sum("w").alias("w")), "graph")
    found = stage(links.select("book_id", F.col("a").alias("symbol"), F.col("a").alias("node")).distinct(), "members")
    while True:
        own = stage(links.select("book_id", F.col("a").alias("node"), F.col("a").alias("c")).distinct(), "places")
        moved = False
        while True:
            moves = stage(_moves(links, own, resolution), "moves")
            if moves.isEmpty():
                break
            moved = True
            own = own.join(moves.select("book_id", "node", "new"), ["book_id", "node"], "left")
            own = stage(own.select("book_id", "node", F.coalesce("new", "c").alias("c")), "places")
        if not moved:
            break
        found = stage(found.join(own, ["book_id", "node"]).select("book_id", "symbol", F.col("c").alias("node")), "members")
        a, b = (own.select("book_id", F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
        links = links.join(a, ["book_id", "a"]).join(b, ["book_id", "b"])
        links = stage(links.groupBy("book_id", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "graph")
    every = nodes.select("book_id", "symbol").distinct().join(found, ["book_id", "symbol"], "full_outer")
    every = every.withColumn("node", F.coalesce(F.col("node"), F.concat(F.lit("\0"), "symbol")))
    first = every.groupBy("book_id", "node").agg(F.min("symbol").alias("first"))
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("first")) - 1
    return every.join(first.withColumn("cluster_id", number), ["book_id", "node"]).select("book_id", "symbol", "cluster_id")


def held_edges(books: DataFrame, edges: DataFrame) -> DataFrame:
    """(book_id, src, dst, weight): the edges of the universe (a, b, z) both ends of which a book holds."""
    a = books.select("book_id", F.col("symbol").alias("a"))
    b = books.select("book_id", F.col("symbol").alias("b"))
    return a.join(edges, "a").join(b, ["book_id", "b"]).select("book_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("z").alias("weight"))

"""Communities of packed books equal those of the edges as rows."""

import pytest
from pyspark.sql import functions as F

from bookheat.operators import graph as G
from bookheat.operators import metrics as M
from bookheat.operators.communities import held_edges
from bookheat.plans import graph_queries as GQ
from bookheat.sources import tables as T

SF = "/root/testdata/sf0.01"


def test_packed_communities_equal_those_of_edge_rows(spark):
    books = T.books(spark, SF).filter("book_id % 10 = 0").select("book_id", "symbol")
    books = books.unionByName(spark.createDataFrame([(-1, "Brand#11"), (-2, "Brand#11"), (-2, "Brand#12")], "book_id long, symbol string"))
    edges = held_edges(books, GQ._universe_edges(spark, SF))
    parts = G.communities(books, edges).persist()
    want = {(r.book_id, r.symbol): r.cluster_id for r in parts.collect()}
    quality = {r.book_id: r.modularity for r in G.modularity(edges, parts).collect()}
    got = G.book_communities(books, GQ._symbol_links(spark, SF)).collect()
    assert len(got) == len(want) and {(r.book_id, r.symbol): r.cluster_id for r in got} == want
    assert all(r.modularity == pytest.approx(quality[r.book_id], abs=1e-12) for r in got) and len(set(quality.values())) > 5


def test_moments_equal_the_exploded_ones(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.5), (2, "b", 2.0), (3, "none", 1.0)]
    books = spark.createDataFrame(rows, "book_id int, symbol string, weight double")
    vectors = spark.createDataFrame([("a", [1.0, 2.0, 4.0]), ("b", [0.5, -1.0, 3.0])], "symbol string, x array<double>")
    flat = books.join(vectors, "symbol").select("book_id", "weight", F.posexplode("x").alias("k", "v"))
    per = flat.groupBy("book_id", "k").agg(F.sum(F.col("weight") * F.col("v")).alias("p"))
    want = {r.book_id: (r.mu, r.v) for r in per.groupBy("book_id").agg(F.avg("p").alias("mu"), F.var_samp("p").alias("v")).collect()}
    got = {r.book_id: (r.mu, r.v) for r in M.moments(books, vectors).collect()}
    assert set(got) == {1, 2} and all(got[k] == pytest.approx(want[k]) for k in got)

"""Registered queries: correlation networks, trees, communities and risk parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookheat.functions import rules as R
from bookheat.operators import graph as G
from bookheat.operators import metrics as M
from bookheat.operators import moments as MM
from bookheat.operators.communities import held_edges
from bookheat.plans import heat_queries as HQ
from bookheat.plans.action_queries import universe_communities
from bookheat.plans.oracle import define, with_ctes
from bookheat.plans.registry import query
from bookheat.session import rounded as r
from bookheat.session import staged
from bookheat.sources import tables as T


@query(
    "mantegna_distance",
    with_ctes("lpairs", "SELECT a, b, round(sqrt(greatest(2 * (1 - corr), 0)), 6) + 0.0 AS distance FROM lpairs"),
)
def mantegna_distance(spark, sf):
    v = MM.ewma_vectors(MM.series(T.returns(spark, sf), "ret", 252))
    return MM.pair_values(v, [], ["z"]).select("a", "b", r(R.mantegna_distance(F.col("z"))).alias("distance"))


# an edge is in the tree iff no path joins its ends using only shorter edges
define(
    "mst_reach",
    """WITH RECURSIVE d AS (SELECT a, b, sqrt(greatest(2 * (1 - corr), 0)) AS w, corr FROM lpairs),
o AS (SELECT *, row_number() OVER (ORDER BY w, a, b) AS rk FROM d),
u AS (SELECT a, b, rk FROM o UNION ALL SELECT b, a, rk FROM o),
reach(rk, target, node) AS (SELECT rk, b, a FROM o
   UNION SELECT r.rk, r.target, u.b FROM reach r JOIN u ON u.a = r.node AND u.rk < r.rk)
SELECT o.a, o.b, o.w, o.corr FROM o ANTI JOIN (SELECT rk FROM reach WHERE node = target) x USING (rk)""",
    "lpairs",
)


@query(
    "mst_edges",
    with_ctes(
        "mst_reach",
        "SELECT a AS source, b AS target, round(w, 4) + 0.0 AS distance, round(corr, 4) + 0.0 AS correlation FROM mst_reach",
    ),
)
def mst_edges(spark, sf):
    v = MM.ewma_vectors(MM.series(T.returns(spark, sf), "ret", 252)).withColumn("book_id", F.lit("all"))
    return G.minimum_spanning_tree(v.select("book_id", "symbol", "z"), ["book_id"]).select(
        "source", "target", r("distance", 4).alias("distance"), r("correlation", 4).alias("correlation")
    )


@query("communities")
def communities(spark, sf):
    return universe_communities(spark, sf).select("symbol", "cluster_id")


@query("community_summary")
def community_summary(spark, sf):
    return G.community_summary(universe_communities(spark, sf)).select("cluster_id", "members", "size")


# a fixed partition (brand number mod 4 by name) gives modularity an SQL-expressible input
_GROUP = "CAST(substr(symbol, 7) AS INTEGER) % 4"


@query(
    "modularity",
    with_ctes(
        "lpairs",
        """, e AS (SELECT a, b, abs(corr) AS w FROM lpairs WHERE abs(corr) >= 0.2), n AS (SELECT a, CAST(substr(a, 7) AS INTEGER) % 4 AS c FROM (SELECT a FROM lpairs UNION SELECT b FROM lpairs)),
deg AS (SELECT n.c, sum(w) AS d FROM (SELECT a, w FROM e UNION ALL SELECT b, w FROM e) x JOIN n USING (a) GROUP BY 1),
ins AS (SELECT na.c, sum(w) AS i FROM e JOIN n na ON na.a = e.a JOIN n nb ON nb.a = e.b WHERE na.c = nb.c GROUP BY 1)
SELECT round(sum(coalesce(i, 0) / m - pow(d / (2 * m), 2)), 6) + 0.0 AS modularity
FROM deg LEFT JOIN ins USING (c), (SELECT sum(w) AS m FROM e)""",
    ),
)
def modularity(spark, sf):
    v = MM.ewma_vectors(MM.series(T.returns(spark, sf), "ret", 252))
    edges = MM.pair_values(v, [], ["z"], keep="edges", threshold=0.2).select(
        F.lit("all").alias("book_id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("z").alias("weight")
    )
    parts = T.symbols(spark, sf).select(
        F.lit("all").alias("book_id"), "symbol", F.expr(_GROUP).alias("cluster_id")
    )
    return G.modularity(edges, parts).select(r("modularity").alias("modularity"))


@query("book_communities")
def book_communities(spark, sf):
    """Communities of the reference book at every replay day and their modularity."""
    snaps = staged(spark, sf, "snapshots", lambda: _snapshots(spark, sf))
    return snaps.groupBy("snapshot").agg(
        F.countDistinct("cluster_id").alias("clusters"), F.count("*").alias("symbols")
    )


def _snapshots(spark, sf):
    from bookheat.functions import arrays as A

    w = HQ.replay_windows(spark, sf).join(T.reference_book(spark), "symbol", "left_semi")
    z = A.with_unit(A.with_ewma_centered(w, "x", "c", 60), "c", "z")
    edges = MM.pair_values(z.select("t", "symbol", "z"), ["t"], ["z"], keep="edges", threshold=0.2)
    e = edges.select(F.col("t").alias("book_id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("z").alias("weight"))
    n = w.select(F.col("t").alias("book_id"), "symbol")
    return G.communities(n, e).select(
        F.lit("reference").alias("book_id"), F.col("book_id").alias("snapshot"), "symbol", "cluster_id"
    )


# SQL-expressible snapshots: symbols clustered by the sign pattern of the week's returns
_CLUSTER_SQL = """snaps AS (SELECT 'all' AS book_id, t AS snapshot, symbol,
     CASE WHEN simple > 0.3 THEN 0 WHEN simple > 0 THEN 1 WHEN simple > -0.3 THEN 2 ELSE 3 END AS cluster_id FROM rets),
recent AS (SELECT * FROM snaps WHERE snapshot >= (SELECT max(snapshot) FROM snaps) - 20),
peers AS (SELECT a.snapshot, a.symbol, list_sort(list(b.symbol)) AS p FROM recent a JOIN recent b ON a.snapshot = b.snapshot
          AND a.cluster_id = b.cluster_id AND a.symbol <> b.symbol GROUP BY 1, 2),
moved AS (SELECT n.symbol, p.snapshot AS compared_to, len(list_intersect(n.p, p.p)) / len(list_distinct(list_concat(n.p, p.p))) AS overlap
          FROM peers n JOIN peers p ON n.symbol = p.symbol AND p.snapshot < n.snapshot
          WHERE n.snapshot = (SELECT max(snapshot) FROM snaps) AND n.p <> p.p),
kept AS (SELECT symbol, max(compared_to) AS compared_to, arg_max(overlap, compared_to) AS overlap FROM moved WHERE overlap < 0.5 GROUP BY 1)"""


def _return_snapshots(spark, sf):
    s = F.col("simple")
    cl = F.when(s > 0.3, 0).when(s > 0, 1).when(s > -0.3, 2).otherwise(3)
    return T.returns(spark, sf).select(
        F.lit("all").alias("book_id"), F.col("t").alias("snapshot"), "symbol", cl.alias("cluster_id")
    )


@query(
    "migrations",
    with_ctes(
        "rets",
        ", " + _CLUSTER_SQL + " SELECT symbol, CAST(compared_to AS BIGINT) AS compared_to, round(overlap, 3) + 0.0 AS overlap FROM kept",
    ),
)
def migrations(spark, sf):
    return G.migrations(_return_snapshots(spark, sf)).select("symbol", HQ.big("compared_to"), r("overlap", 3).alias("overlap"))


@query(
    "migration_risk",
    with_ctes(
        "rets",
        ", "
        + _CLUSTER_SQL
        + """ SELECT round((SELECT count(*) FROM kept) / (SELECT count(*) FROM snaps WHERE snapshot = (SELECT max(snapshot) FROM snaps)), 6) + 0.0 AS migration_risk""",
    ),
)
def migration_risk(spark, sf):
    s = _return_snapshots(spark, sf)
    return G.migration_risk(s, G.migrations(s)).select(r("migration_risk").alias("migration_risk"))


@query("community_migrations")
def community_migrations(spark, sf):
    """Symbols of the reference book that changed their peers, on the communities found at every replay day."""
    snaps = staged(spark, sf, "snapshots", lambda: _snapshots(spark, sf))
    return G.migrations(snaps).select("book_id", "symbol", HQ.big("compared_to"), r("overlap", 3).alias("overlap"))


@query("community_migration_risk")
def community_migration_risk(spark, sf):
    snaps = staged(spark, sf, "snapshots", lambda: _snapshots(spark, sf))
    return G.migration_risk(snaps, G.migrations(snaps)).select("book_id", r("migration_risk").alias("migration_risk"))


def _universe_edges(spark, sf):
    """Pairs of symbols whose correlation is at least .2 either way: (a, b, z), staged."""

    def build():
        v = MM.ewma_vectors(MM.series(T.returns(spark, sf), "ret", 252))
        return MM.pair_values(v, [], ["z"], keep="edges", threshold=0.2)

    return staged(spark, sf, "universe-edges", build)


def _symbol_links(spark, sf):
    """(symbol, w): absolute correlations of every symbol with all symbols in their order, zero where there is no edge."""
    e = _universe_edges(spark, sf).select("a", "b", F.abs("z").alias("w"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    near = both.groupBy(F.col("a").alias("symbol")).agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
    symbols = T.symbols(spark, sf)
    every = symbols.agg(F.array_sort(F.collect_set("symbol")).alias("all"))
    w = F.transform("all", lambda s: F.coalesce(F.try_element_at(F.col("m"), s), F.lit(0.0)))
    return symbols.join(near, "symbol", "left").crossJoin(every).select("symbol", w.alias("w"))


def community_lists(spark, sf):
    """(book_id, modularity, clusters) of every customer book, ``clusters`` the list of its symbols and their clusters; staged."""

    def build():
        if T.symbols(spark, sf).count() ** 2 <= M.MAX_SHIPPED_NUMBERS:
            made = G.community_lists(T.packed_books(spark, sf), _symbol_links(spark, sf))
            pair = F.zip_with("symbol", "cluster_id", lambda s, c: F.struct(s.alias("symbol"), c.alias("cluster_id")))
            return made.select("book_id", "modularity", pair.alias("clusters"))
        books = T.books(spark, sf)
        edges = held_edges(books, _universe_edges(spark, sf))
        parts = G.communities(books, edges)
        lists = parts.groupBy("book_id").agg(F.collect_list(F.struct("symbol", "cluster_id")).alias("clusters"))
        return lists.join(G.modularity(edges, parts), "book_id").select("book_id", "modularity", "clusters")

    return staged(spark, sf, "customer-communities", build)


def _customer_communities(spark, sf):
    """(book_id, symbol, cluster_id, modularity) of every customer book."""
    return community_lists(spark, sf).select("book_id", "modularity", F.inline("clusters")).select("book_id", "symbol", "cluster_id", "modularity")


@query("customer_communities")
def customer_communities(spark, sf):
    """Communities of every customer book in the graph of the symbols it holds."""
    return _customer_communities(spark, sf).select("book_id", "symbol", "cluster_id")


@query("customer_modularity")
def customer_modularity(spark, sf):
    per = _customer_communities(spark, sf).groupBy("book_id").agg(F.max("modularity").alias("modularity"))
    return per.select("book_id", r("modularity").alias("modularity"))


@query(
    "held_edges",
    with_ctes(
        ["books", "lpairs"],
        """SELECT x.book_id, p.a AS src, p.b AS dst, round(abs(p.corr), 5) + 0.0 AS weight
FROM books x JOIN lpairs p ON p.a = x.symbol JOIN books y ON y.book_id = x.book_id AND y.symbol = p.b WHERE abs(p.corr) >= 0.2""",
    ),
)
def held_edges_query(spark, sf):
    return held_edges(T.books(spark, sf), _universe_edges(spark, sf)).select("book_id", "src", "dst", r("weight", 5).alias("weight"))


def _hrp(spark, sf):
    return staged(spark, sf, "hrp", lambda: G.hrp_weights(T.packed_books(spark, sf), HQ.latest_windows(spark, sf, 60)))


@query("hrp_weights_books")
def hrp_weights_books(spark, sf):
    return _hrp(spark, sf).select("book_id", "symbol", r("weight").alias("weight"))


@query(
    "weight_hhi",
    with_ctes("books", "SELECT book_id, round(sum(weight * weight) / pow(sum(weight), 2), 6) + 0.0 AS hhi FROM books GROUP BY 1"),
)
def weight_hhi(spark, sf):
    return G.weight_hhi(T.books(spark, sf)).select("book_id", r("hhi").alias("hhi"))


@query("hrp_vs_actual")
def hrp_vs_actual(spark, sf):
    from bookheat.operators.books import compare_weights

    return compare_weights(T.books(spark, sf), _hrp(spark, sf)).select(
        "book_id", "symbol", r("actual_pct", 4).alias("actual_pct"), r("target_pct", 4).alias("target_pct")
    )


@query("cluster_state")
def cluster_state(spark, sf):
    """Reference book: communities, modularity, tree and risk parity weights on one row."""
    ref = T.reference_book(spark)
    w = HQ.latest_windows(spark, sf, 60)
    z = MM.ewma_vectors(w.join(ref, "symbol", "left_semi")).withColumn("book_id", F.lit("reference"))
    pairs = MM.pair_values(z.select("book_id", "symbol", "z"), ["book_id"], ["z"], keep="edges", threshold=0.2)
    edges = pairs.select("book_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("z").alias("weight"))
    parts = G.communities(ref, edges)
    tree = G.minimum_spanning_tree(z.select("book_id", "symbol", "z"), ["book_id"])
    state = G.cluster_state(parts, G.modularity(edges, parts), tree, G.hrp_weights(ref, w))
    return state.select(
        "book_id",
        F.to_json("communities").alias("communities"),
        r("modularity").alias("modularity"),
        F.to_json("mst").alias("mst"),
        F.to_json("hrp_weights").alias("hrp_weights"),
    )

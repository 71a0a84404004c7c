"""Correlation networks: communities, modularity, spanning trees, migrations, risk parity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookheat.functions import arrays as A
from bookheat.functions import linalg as L
from bookheat.functions import rules as R
from bookheat.operators import moments as MM
from bookheat.operators.metrics import map_books, packed_books
from bookheat.session import spread, stage


def _louvain(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float) -> np.ndarray:
    """Greedy modularity labels of a small weighted graph; nodes are visited in order."""
    label = np.arange(n)
    adj = np.zeros((n, n))
    np.add.at(adj, (src, dst), w)
    np.add.at(adj, (dst, src), w)
    while True:
        m = len(adj)
        degree, total = adj.sum(axis=1), adj.sum()
        own = np.arange(m)
        weight = degree.copy()
        moved = True
        any_move = False
        while moved:
            moved = False
            for v in range(m):
                links = np.zeros(m)
                row = adj[v].copy()
                row[v] = 0.0
                np.add.at(links, own, row)
                weight[own[v]] -= degree[v]
                gain = links - resolution * weight * degree[v] / total
                best = int(np.argmax(np.where((links > 0) | (np.arange(m) == own[v]), gain, -np.inf)))
                if gain[best] <= gain[own[v]] + 1e-12:
                    best = int(own[v])
                if best != own[v]:
                    own[v] = best
                    moved = any_move = True
                weight[best] += degree[v]
        _, compact = np.unique(own, return_inverse=True)
        label = compact[label]
        if not any_move:
            return label
        fold = np.zeros((compact.max() + 1, m))
        fold[compact, np.arange(m)] = 1.0
        adj = fold @ adj @ fold.T


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(book_id, symbol, cluster_id): modularity clusters of each book's correlation graph.

    Nodes without edges get a cluster of their own. A book's nodes and thresholded edges are one
    packed row; books run in parallel.
    """
    half = edges.select("book_id", F.col("src").alias("symbol"), F.col("dst").alias("other"), "weight")
    loose = nodes.select("book_id", "symbol").distinct().withColumns(
        {"other": F.lit(""), "weight": F.lit(0.0)}
    )

    def one(rec: dict) -> list[tuple]:
        names = sorted(set(rec["symbol"]) | {o for o in rec["other"] if o})
        at = {s: i for i, s in enumerate(names)}
        keep = [i for i, o in enumerate(rec["other"]) if o]
        if not keep:
            return [(s, i) for i, s in enumerate(names)]
        src = np.array([at[rec["symbol"][i]] for i in keep])
        dst = np.array([at[rec["other"][i]] for i in keep])
        found = _louvain(len(names), src, dst, rec["weight"][keep], resolution)
        order: dict[int, int] = {}
        ids = [order.setdefault(int(c), len(order)) for c in found]
        return list(zip(names, ids))

    return L.map_groups(
        half.unionByName(loose), ["book_id"], ["symbol", "other", "weight"], one, "symbol string, cluster_id int"
    )


def _once_per_set(books: DataFrame, vectors: DataFrame, cols: list[str], one, out: str) -> DataFrame:
    """(book_id, *out): ``one`` follows from the symbols of a book alone, so every set of symbols is solved once.

    Solved sets are staged, so that books meet them by broadcast where they are few. ``books`` may be packed.
    """
    if "items" not in books.columns:
        books = packed_books(books.select("book_id", "symbol", F.lit(1.0).alias("weight")))
    held = books.select("book_id", F.transform("items", lambda e: e["symbol"]).alias("_set"))
    one_each = F.transform("_set", lambda s: F.struct(s.alias("symbol"), F.lit(1.0).alias("weight")))
    # few bytes, much to solve: hashed once more, or adaptive execution would fold the partitions of the distinct sets
    sets = spread(held.select("_set").distinct().withColumn("_n", F.xxhash64("_set")), "_n").select(F.col("_set").alias("book_id"), one_each.alias("items"))
    solved = stage(map_books(sets, vectors, cols, one, out).withColumnRenamed("book_id", "_set"), "sets")
    return held.join(solved, "_set").drop("_set")


def book_communities(books: DataFrame, links: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(book_id, symbol, cluster_id, modularity): ``community_lists`` as rows."""
    each = community_lists(books, links, resolution)
    return each.select("book_id", "modularity", F.inline(F.arrays_zip("symbol", "cluster_id"))).select("book_id", "symbol", "cluster_id", "modularity")


def community_lists(books: DataFrame, links: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(book_id, symbol, cluster_id, modularity): ``communities`` and ``modularity`` of the graph of the symbols a book holds, one row per
    book with the lists of its symbols and their clusters.

    ``links`` (symbol, w) has one row per symbol, ``w`` its weights to all symbols in order of symbols, zero where there is no
    edge. Books with the same symbols have the same communities, which are found once.
    """
    order = {s: k for k, s in enumerate(sorted((r.symbol for r in links.select("symbol").collect()), key=str.encode))}

    def one(rec: dict) -> list[tuple]:
        key = rec["symbol"]
        names = sorted(set(key))
        at = [key.index(s) for s in names]
        adj = rec["w"][at][:, [order[s] for s in names]]
        # edges in the order in which rows of (symbol, other) would come
        src, dst = np.nonzero(np.triu(adj, 1))
        ids, quality = list(range(len(names))), 0.0
        if len(src):
            number: dict[int, int] = {}
            found = _louvain(len(names), src, dst, adj[src, dst], resolution)
            ids = [number.setdefault(int(c), len(number)) for c in found]
            member = (np.array(ids)[:, None] == np.unique(ids)[None, :]).astype(float)
            total = adj[src, dst].sum()
            inside, degree = np.einsum("ic,ij,jc->c", member, adj, member) / 2, member.T @ adj.sum(axis=1)
            quality = float((inside / total - (degree / (2 * total)) ** 2).sum())
        return [(names, ids, quality)]

    return _once_per_set(books, links, ["w"], one, "symbol array<string>, cluster_id array<int>, modularity double")


def community_summary(parts: DataFrame) -> DataFrame:
    return parts.groupBy("book_id", "cluster_id").agg(
        F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("members"), F.count("*").alias("size")
    )


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Weighted modularity of each book's partition; zero without edges."""
    cl = parts.select("book_id", "symbol", "cluster_id")
    total = edges.groupBy("book_id").agg(F.sum("weight").alias("m"))
    ends = (
        edges.select("book_id", F.col("src").alias("symbol"), "weight")
        .unionByName(edges.select("book_id", F.col("dst").alias("symbol"), "weight"))
        .join(cl, ["book_id", "symbol"])
        .groupBy("book_id", "cluster_id")
        .agg(F.sum("weight").alias("degree"))
    )
    a = cl.select("book_id", F.col("symbol").alias("src"), F.col("cluster_id").alias("ca"))
    b = cl.select("book_id", F.col("symbol").alias("dst"), F.col("cluster_id").alias("cb"))
    inside = (
        edges.join(a, ["book_id", "src"])
        .join(b, ["book_id", "dst"])
        .filter("ca = cb")
        .groupBy("book_id", F.col("ca").alias("cluster_id"))
        .agg(F.sum("weight").alias("inside"))
    )
    terms = ends.join(inside, ["book_id", "cluster_id"], "left").join(total, "book_id")
    part = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return (
        parts.select("book_id").distinct()
        .join(terms.groupBy("book_id").agg(F.sum(part).alias("modularity")), "book_id", "left")
        .select("book_id", F.coalesce("modularity", F.lit(0.0)).alias("modularity"))
    )


def _tree(names: list[str], a: np.ndarray, b: np.ndarray, d: np.ndarray) -> list[int]:
    """Kruskal on one bounded edge list; ties break by the names."""
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    keep = []
    for e in sorted(range(len(d)), key=lambda e: (d[e], names[a[e]], names[b[e]])):
        x, y = root(int(a[e])), root(int(b[e]))
        if x != y:
            parent[x] = y
            keep.append(e)
    return keep


def minimum_spanning_tree(vectors: DataFrame, keys: list[str], block: int = MM.BLOCK) -> DataFrame:
    """Spanning tree on sqrt(2(1 - corr)): (keys, source, target, distance, correlation).

    An edge of the whole tree is also in the tree of any edge subset that holds it, so each pair
    of symbol blocks sends only its own tree on, and the union of those is reduced again: by
    block row, then per key. Pairs are never rows.
    """
    packed = (
        spread(MM._blocked(vectors, keys, block), *keys, "bi", "bj")
        .groupBy(*keys, "bi", "bj")
        .agg(F.array_sort(F.collect_list(F.struct("symbol", "own", "bi", "bj", "z"))).alias("items"))
    )

    def local(rec: dict) -> list[tuple]:
        names, own, bi, bj = rec["symbol"], rec["own"], rec["bi"][0], rec["bj"][0]
        if bi == bj:
            i, j = np.triu_indices(len(names), 1)
        else:
            li, ri = np.nonzero(own == bi)[0], np.nonzero(own == bj)[0]
            i, j = (v.ravel() for v in np.meshgrid(li, ri, indexing="ij"))
            i, j = np.minimum(i, j), np.maximum(i, j)
        if len(i) == 0:
            return []
        c = (rec["z"] @ rec["z"].T)[i, j]
        d = np.sqrt(np.maximum(2 * (1 - c), 0))
        return [(names[i[e]], names[j[e]], float(d[e]), float(c[e])) for e in _tree(names, i, j, d)]

    def merge(rec: dict) -> list[tuple]:
        names = sorted(set(rec["source"]) | set(rec["target"]))
        at = {s: k for k, s in enumerate(names)}
        a = np.array([at[s] for s in rec["source"]])
        b = np.array([at[s] for s in rec["target"]])
        return [
            (rec["source"][e], rec["target"][e], float(rec["distance"][e]), float(rec["correlation"][e]))
            for e in _tree(names, a, b, rec["distance"])
        ]

    out = "source string, target string, distance double, correlation double"
    cols = ["source", "target", "distance", "correlation"]
    edges = L.map_packed(packed, [*keys, "bi", "bj"], local, out).drop("bj")
    rows = L.map_groups(edges, [*keys, "bi"], cols, merge, out).drop("bi")
    return L.map_groups(rows, keys, cols, merge, out)


def migrations(snapshots: DataFrame, lookback: int = 20) -> DataFrame:
    """Symbols whose cluster peers in the newest snapshot overlap less than half with an earlier one.

    ``snapshots``: (book_id, snapshot, symbol, cluster_id), ``snapshot`` an increasing ordinal. The
    most recent such comparison is kept per symbol. Peer sets are never built: their overlap follows
    from cluster sizes and the number of symbols two clusters share.
    """
    newest = snapshots.groupBy("book_id").agg(F.max("snapshot").alias("newest"))
    recent = snapshots.join(newest, "book_id").filter(F.col("snapshot") >= F.col("newest") - lookback)
    now = recent.filter("snapshot = newest").select("book_id", "symbol", F.col("cluster_id").alias("to_cluster"))
    then = recent.filter("snapshot < newest").select(
        "book_id", "symbol", F.col("snapshot").alias("compared_to"), F.col("cluster_id").alias("from_cluster")
    )
    to_size = now.groupBy("book_id", "to_cluster").agg(F.count("*").alias("na"))
    from_size = then.groupBy("book_id", "compared_to", "from_cluster").agg(F.count("*").alias("nb"))
    both = now.join(then, ["book_id", "symbol"])
    cell = ["book_id", "compared_to", "to_cluster", "from_cluster"]
    a, b, ab = F.col("na"), F.col("nb"), F.col("ab")
    moved = (
        both.groupBy(*cell)
        .agg(F.count("*").alias("ab"))
        .join(to_size, ["book_id", "to_cluster"])
        .join(from_size, ["book_id", "compared_to", "from_cluster"])
        .filter((a > 1) & (b > 1))
        .withColumn("overlap", (ab - 1) / (a + b - ab - 1))
        .filter("overlap < 0.5")
        .select(*cell, "overlap")
    )
    w = Window.partitionBy("book_id", "symbol").orderBy(F.col("compared_to").desc())
    return both.join(moved, cell).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def migration_risk(snapshots: DataFrame, moved: DataFrame) -> DataFrame:
    """Share of the newest snapshot's symbols that migrated; zero with fewer than two snapshots."""
    newest = snapshots.groupBy("book_id").agg(F.max("snapshot").alias("newest"))
    size = (
        snapshots.join(newest, "book_id")
        .groupBy("book_id")
        .agg(F.count_if(F.col("snapshot") == F.col("newest")).alias("n"))
    )
    hits = moved.groupBy("book_id").agg(F.countDistinct("symbol").alias("m"))
    return size.join(hits, "book_id", "left").select(
        "book_id",
        R.clip(F.coalesce("m", F.lit(0)) / F.greatest("n", F.lit(1)), 0.0, 1.0).alias("migration_risk"),
    )


def _single_linkage_order(d: np.ndarray) -> list[int]:
    """Leaf order of single-linkage clusters (merging nearest first, the cluster with the smaller index left).

    Single linkage is the spanning tree replayed by length: the tree takes n² steps, the replay a chain of lists per merge.
    """
    n = len(d)
    best, link, left = d[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    left[0], edges = False, []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(left, best, np.inf)))
        edges.append((float(best[j]), min(int(link[j]), j), max(int(link[j]), j)))
        left[j] = False
        closer = left & (d[j] < best)
        best[closer], link[closer] = d[j][closer], j
    parent = list(range(n))
    after, last = [-1] * n, list(range(n))  # a cluster is a chain from its root

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, i, j in sorted(edges):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
        after[last[a]], last[a] = b, last[b]
    out, at = [], root(0)
    while at >= 0:
        out.append(at)
        at = after[at]
    return out


def risk_parity(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity weights by recursive inverse-variance bisection."""
    s = np.sqrt(np.diag(cov))
    s[s == 0] = 1e-10
    corr = np.clip(cov / np.outer(s, s), -1, 1)
    order = _single_linkage_order(np.sqrt(np.maximum(0.5 * (1 - corr), 0)))
    w = np.ones(len(cov))

    def variance(idx: list[int]) -> float:
        sub = cov[np.ix_(idx, idx)]
        inv = 1 / np.maximum(np.diag(sub), 1e-300)
        inv = inv / inv.sum()
        return float(inv @ sub @ inv)

    stack = [order]
    while stack:
        part = stack.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        vl, vr = variance(left), variance(right)
        share = 1 - vl / (vl + vr) if vl + vr > 0 else 0.5
        w[left] *= share
        w[right] *= 1 - share
        stack += [left, right]
    return w / w.sum()


def parity_or_equal(cov: np.ndarray) -> np.ndarray:
    """Risk parity weights; equal ones where the covariances do not allow any (not finite, or no variance at all)."""
    n = len(cov)
    if n == 1:
        return np.ones(1)
    if not np.isfinite(cov).all() or not (np.diag(cov) > 0).any():
        return np.full(n, 1.0 / n)
    w = risk_parity(cov)
    return w if np.isfinite(w).all() and w.sum() > 0 else np.full(n, 1.0 / n)


def hrp_lists(books: DataFrame, windowed: DataFrame) -> DataFrame:
    """(book_id, symbol, weight): ``hrp_weights`` from the sample covariances, one row per book with the lists of its symbols and weights."""
    vectors = A.with_centered(windowed, "x", "c").select("symbol", "c")

    def one(rec: dict) -> list[tuple]:
        return [(list(rec["symbol"]), parity_or_equal(rec["c"] @ rec["c"].T).tolist())]

    return _once_per_set(books, vectors, ["c"], one, "symbol array<string>, weight array<double>")


def hrp_weights(books: DataFrame, windowed: DataFrame, covariances: DataFrame | None = None) -> DataFrame:
    """(book_id, symbol, weight) by hierarchical risk parity.

    ``covariances`` (book_id, a, b, cov; both ways round or one, variances included) takes the place of the sample covariances of
    ``windowed`` for the books it names; a pair it lacks counts as zero. A book of one symbol holds it whole; where the
    covariances allow no weights they are equal.
    """
    given = None
    if covariances is not None:
        named = covariances.select("book_id").distinct()
        own = books.select("book_id", "symbol").join(named, "book_id", "left_semi")
        given = _given_parity(own, covariances)
        books = books.join(named, "book_id", "left_anti")
    sampled = hrp_lists(books, windowed).select("book_id", F.inline(F.arrays_zip("symbol", "weight")))
    return sampled if given is None else sampled.unionByName(given)


def _given_parity(books: DataFrame, covariances: DataFrame) -> DataFrame:
    """Weights from given covariances, one packed row per book."""
    pairs = covariances.select("book_id", F.col("a").alias("symbol"), F.col("b").alias("other"), "cov")
    known = pairs.join(books, ["book_id", "symbol"], "left_semi").unionByName(
        books.select("book_id", "symbol", F.lit(None).cast("string").alias("other"), F.lit(0.0).alias("cov"))
    )

    def one(rec: dict) -> list[tuple]:
        names = sorted(set(rec["symbol"]))
        at = {s: k for k, s in enumerate(names)}
        cov = np.zeros((len(names), len(names)))
        for a, b, v in zip(rec["symbol"], rec["other"], rec["cov"]):
            if b in at:
                cov[at[a], at[b]] = cov[at[b], at[a]] = v
        return list(zip(names, parity_or_equal(cov).tolist()))

    return L.map_groups(known, ["book_id"], ["symbol", "other", "cov"], one, "symbol string, weight double")


def weight_hhi(weights: DataFrame) -> DataFrame:
    """Concentration of absolute weights per book."""
    a = F.abs("weight")
    s = F.sum(a)
    return weights.groupBy("book_id").agg(
        F.when(s > 0, F.sum(a * a) / (s * s)).otherwise(0.0).alias("hhi")
    )


def cluster_state(parts: DataFrame, quality: DataFrame, tree: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per book: communities, modularity, tree edges and target weights."""
    com = community_summary(parts).groupBy("book_id").agg(
        F.array_sort(F.collect_list(F.struct("cluster_id", "members", "size"))).alias("communities")
    )
    edges = tree.groupBy("book_id").agg(
        F.array_sort(F.collect_list(F.struct("distance", "source", "target", "correlation"))).alias("mst")
    )
    hrp = weights.groupBy("book_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "weight")))).alias("hrp_weights")
    )
    return com.join(quality, "book_id").join(edges, "book_id", "left").join(hrp, "book_id", "left")

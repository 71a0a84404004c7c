"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted in numpy on a bounded sample (``SAMPLE`` rows, those with the smallest hash of their
id) and has at most ``SAMPLE / LEAF_SAMPLE`` leaves, so it travels with the tasks. Every row is indexed:
it descends to one leaf and the index is written by leaf. A query walks the tree with a priority queue,
nearest centre first, and visits leaves until the calibrated number is reached and the leaves hold
enough rows. Calibration takes ``PROBES`` rows of the sample, finds their exact neighbours among all
rows in blocks, looks up at which visit the walk reaches the leaf of each, and takes the number of
visits that reaches ``RECALL`` of them. Neighbouring leaves are packed into shards, one task each, and a
leaf above the size of a shard is cut into several, so a hot leaf is many tasks; queries beyond ``PART``
are parts of their own. A query goes once to each shard that holds leaves it visits; the shard gives its
best k over these leaves with exact distances and ties by the smaller id, and the best k of all remain.

Cases: vectors that are null, zero, or with null or non-finite components take no part, nor do rows without id; vectors of
different length are not compared (``neighbours`` makes a tree per length). A repeated id counts once per query (its nearest vector), and an id
asked twice is one query. With fewer than k candidates all are returned. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookheat.llm.common import fan_out
from bookheat.llm.vectors import lengths, matrix, usable
from bookheat.session import stage

SAMPLE = 20_000
LEAF_ROWS = 256
LEAF_SAMPLE = 16
BRANCHES = 8
LLOYD = 8
PROBES = 256
RECALL = 0.97
SHARD = 32_768
PART = 16_384


class Tree(NamedTuple):
    centres: np.ndarray  # of all nodes; node 0 is the root
    children: list[list[int]]
    leaf: list[int]  # number of the leaf, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster of each row; empty clusters vanish."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(LLOYD):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        centres = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
    own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
    return np.unique(own, return_inverse=True)[1]


def grow(sample: np.ndarray, leaf_sample: int, seed: int = 5) -> Tree:
    """Tree over the sample; nodes of ``leaf_sample`` rows and less, or of equal rows, are leaves."""
    rng = np.random.default_rng(seed)
    centres, children, leaf, todo, leaves = [sample.mean(0)], [[]], [-1], [(0, np.arange(len(sample)))], 0
    while todo:
        node, rows = todo.pop()
        own = _kmeans(sample[rows], min(BRANCHES, len(rows)), rng) if len(rows) > leaf_sample else np.zeros(len(rows), int)
        if own.max() == 0:
            leaf[node] = leaves
            leaves += 1
            continue
        for c in range(own.max() + 1):
            inside = rows[own == c]
            children[node].append(len(centres))
            centres.append(sample[inside].mean(0))
            children.append([])
            leaf.append(-1)
            todo.append((len(centres) - 1, inside))
    return Tree(np.stack(centres), children, leaf)


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each row: the nearest child at every level."""
    out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if tree.leaf[node] >= 0:
            out[rows] = tree.leaf[node]
        elif len(rows):
            c = tree.centres[tree.children[node]]
            own = np.argmin((c**2).sum(1) - 2 * x[rows] @ c.T, 1)
            todo += [(kid, rows[own == n]) for n, kid in enumerate(tree.children[node])]
    return out


def walk(tree: Tree, q: np.ndarray) -> Iterator[int]:
    """Leaves in best-bin-first order."""
    queue = [(0.0, 0)]
    while queue:
        _, node = heapq.heappop(queue)
        if tree.leaf[node] >= 0:
            yield tree.leaf[node]
        else:
            kids = tree.children[node]
            for d, kid in zip(((tree.centres[kids] - q) ** 2).sum(1).tolist(), kids):
                heapq.heappush(queue, (d, kid))


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest rows of each query; each id once, none its own."""
    out = ([], [], [])
    norms = (x**2).sum(1)
    for n in range(len(q)):
        rough = norms - 2 * (x @ q[n]) + (q[n] ** 2).sum()
        rough[ids == q_ids[n]] = np.inf
        # spare room for repeated ids; ties and rounding stay inside the margin
        kth = np.partition(rough, min(2 * k, len(rough) - 1))[min(2 * k, len(rough) - 1)]
        if not np.isfinite(kth):
            kth = rough[np.isfinite(rough)].max(initial=-np.inf)
        at = np.flatnonzero(rough <= kth + 1e-9 * max(1.0, abs(kth)))
        d = np.sqrt(((x[at] - q[n]) ** 2).sum(1))
        order = np.lexsort((ids[at], d))
        once = np.sort(np.unique(ids[at][order], return_index=True)[1])
        if len(once) < k and len(at) < np.isfinite(rough).sum():
            at = np.flatnonzero(np.isfinite(rough))
            d = np.sqrt(((x[at] - q[n]) ** 2).sum(1))
            order = np.lexsort((ids[at], d))
            once = np.sort(np.unique(ids[at][order], return_index=True)[1])
        pick = order[once[:k]]
        out[0].append(np.full(len(pick), q_ids[n]))
        out[1].append(ids[at][pick])
        out[2].append(d[pick])
    return tuple(np.concatenate(o) for o in out)


def _doubles(column) -> np.ndarray:
    """Matrix from a column of packed vectors."""
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


class Index(NamedTuple):
    tree: Tree
    rows: DataFrame  # id, vec (packed doubles), leaf
    counts: np.ndarray  # rows by leaf
    visits: int


def _usable(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    base = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("vec"))
    return base.filter(F.col("id").isNotNull() & usable(F.col("vec")))


def neighbours(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vec: str = "embedding", k: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows of ``vectors`` that ``queries``, a condition on ``id``, picks.

    Vectors of each length are a space of their own, with its own tree.
    """
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in lengths(_usable(vectors, vec_id, vec), "vec"):
        index = build(vectors, vec_id, vec, k, width=width)
        out = out.unionAll(search(index, index.rows.filter(queries).select("id", "vec"), k))
    return out


def build(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", k: int = 10, recall: float = RECALL, width: int | None = None) -> Index | None:
    """Fit, index and calibrate over the vectors of ``width`` components (of the only length, if not given); None without any."""
    part = _usable(vectors, vec_id, vec)
    if width is None:
        known = lengths(part, "vec")
        if not known:
            return None
        if len(known) > 1:
            raise ValueError(f"vectors of {len(known)} lengths: name one")
        width = known[0]
    part = part.filter(F.size("vec") == width)
    sample = part.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    x = matrix(sample.column("vec").combine_chunks(), width)
    total = part.count()
    tree = grow(x, max(LEAF_SAMPLE, len(x) * LEAF_ROWS // max(total, 1)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = matrix(b.column("vec"), width)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([v.tobytes() for v in y], pa.binary()), pa.array(route(tree, y))], ["id", "vec", "leaf"])

    rows = stage(part.mapInArrow(index, "id long, vec binary, leaf int"), "ann-index")
    counts = np.zeros(tree.leaves, np.int64)
    for r in rows.groupBy("leaf").count().collect():  # one row per leaf
        counts[r["leaf"]] = r["count"]
    probes = np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int)
    return Index(tree, rows, counts, calibrate(tree, rows, sample.column("id").to_numpy()[probes], x[probes], k, recall))


def calibrate(tree: Tree, rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> int:
    """Visits after which the walks have reached ``recall`` of the probes' exact neighbours."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 8192):
                p = b.slice(lo, 8192)
                n, i, d = _best(q_ids, q, p.column("id").to_numpy(), _doubles(p.column("vec")), k)
                leaf = dict(zip(p.column("id").to_pylist(), p.column("leaf").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64()), pa.array([leaf[v] for v in i.tolist()], pa.int32())], ["q", "id", "d", "leaf"])

    found = rows.mapInArrow(nearest, "q long, id long, d double, leaf int")
    rank = F.row_number().over(W.partitionBy("q").orderBy("d", "id"))
    true = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "leaf").collect()  # probes times k
    seen = {int(i): {leaf: n for n, leaf in enumerate(walk(tree, v))} for i, v in zip(q_ids, q)}
    steps = sorted(seen[r["q"]][r["leaf"]] + 1 for r in true)
    return steps[min(len(steps) - 1, int(np.ceil(recall * len(steps))) - 1)] if steps else tree.leaves


def shards(counts: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each leaf; neighbouring leaves share one up to its size."""
    most = max(1, min(SHARD, int(np.ceil(counts.sum() / tasks))))
    first, parts, shard, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if held and held + n > most:
            shard, held = shard + 1, 0
        first[leaf], parts[leaf] = shard, max(1, -(-n // most))
        held += n
        if parts[leaf] > 1:
            shard, held = shard + int(parts[leaf]), 0
    return first, parts


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for ``queries`` (id, packed vec), rows of the index."""
    tree, counts, visits = index.tree, index.counts, index.visits
    first, parts = shards(counts, fan_out(queries.sparkSession))
    queries = queries.dropDuplicates(["id"])
    batches_of_queries = max(1, -(-queries.count() // PART))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("vec").to_pylist()):
                by_shard, held, seen = {}, 0, 0
                for leaf in walk(tree, np.frombuffer(v, np.float64)):
                    if seen >= visits and held > k:
                        break
                    seen, held = seen + 1, held + counts[leaf]
                    for shard in range(first[leaf], first[leaf] + parts[leaf]):
                        by_shard.setdefault(shard, []).append(leaf)
                n = len(by_shard)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array([v] * n, pa.binary()), pa.array(list(by_shard), pa.int32()), pa.array(list(by_shard.values()), pa.list_(pa.int32()))],
                    ["id", "vec", "shard", "leaves"],
                )

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if asked.num_rows and held.num_rows:
            held = held.sort_by("leaf")
            ids, x, leaf = held.column("id").to_numpy(), _doubles(held.column("vec")), held.column("leaf").to_numpy()
            for i, v, leaves in zip(asked.column("id").to_pylist(), asked.column("vec").to_pylist(), asked.column("leaves").to_pylist()):
                lo, hi = np.searchsorted(leaf, leaves, "left"), np.searchsorted(leaf, leaves, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
                if len(at):
                    for o, got in zip(out, _best(np.array([i]), np.frombuffer(v, np.float64)[None, :], ids[at], x[at], k)):
                        o.append(got)
        return pa.table([pa.array(np.concatenate(o), t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    asked = queries.mapInArrow(ask, "id long, vec binary, shard int, leaves array<int>")
    left = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(batches_of_queries)).cast("int"))
    # leaf to shard as two short lists in the plan; every part of the queries meets every row of its shard
    own = F.element_at(F.lit(first.tolist()), F.col("leaf") + 1) + F.pmod(F.xxhash64("id"), F.element_at(F.lit(parts.tolist()), F.col("leaf") + 1))
    right = index.rows.withColumn("shard", own.cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(batches_of_queries - 1))))
    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

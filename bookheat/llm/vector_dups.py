"""Near-duplicate vectors by random hyperplanes, exact cosines and distributed components.

Vectors that are equal in every component are one node with a count. Every node is hashed in several
tables by the signs of its inner products with random hyperplanes; the number of bits grows with the
logarithm of the number of nodes, the number of tables follows from the bits so that a pair right at the
threshold meets in some table with probability ``RECALL``. A bucket of more than ``BLOCK`` nodes is cut
into blocks and every two blocks meet in a cell of their own, so a bucket with a third of all rows is
many cells and no task holds it. In a cell the exact cosine decides; a pair that meets in several tables
counts in the first. A cell sends on sums of links per node and, instead of its pairs, a forest with the
same components.

Vectors of one length are a space of their own, with its own hyperplanes and tables.

Cases: vectors that are null, zero, or with null or non-finite components
link with nothing, as do rows without id (their component is null, not kept). Rows with one id and
different vectors are one node to reachability. Repeated rows link with each other. An empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookheat.llm.components import components, local_roots
from bookheat.llm.vectors import lengths, matrix, usable
from bookheat.session import stage

THRESHOLD = 0.95
RECALL = 0.995
BUCKET = 32
BLOCK = 1024
GROUP_ROWS = 8192
LINKS = "g long, n long, a long, b long"


def plan(nodes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many nodes."""
    bits = min(30, max(6, math.ceil(math.log2(max(1, nodes) / BUCKET)) if nodes > BUCKET else 6))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _hashed(nodes: DataFrame, width: int, bits: int, tables: int) -> DataFrame:
    """A row per node and table: ``t``, ``sig`` and the node's signatures in all tables."""
    planes = np.random.default_rng(11).normal(size=(width, bits * tables))
    powers = (1 << np.arange(bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                x = matrix(part.column("vec"), width)
                sigs = ((x @ planes) > 0).reshape(len(x), tables, bits) @ powers
                packed = pa.array([s.tobytes() for s in sigs.astype("<i4")], pa.binary())
                vec = pa.array([v.tobytes() for v in x], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("g"), part.column("rep"), part.column("m"), vec, packed, pa.array(np.full(len(x), t, np.int32)), pa.array(sigs[:, t].astype(np.int32))],
                        ["g", "rep", "m", "vec", "sigs", "t", "sig"],
                    )

    return nodes.mapInArrow(run, "g long, rep long, m long, vec binary, sigs binary, t int, sig int")


def _verify(width: int, threshold: float):
    def one(cell: dict) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs (places in the cell) that meet in this table first."""
        x, k, t = cell["x"], cell["k"], cell["t"]
        a, b = (np.arange(len(x)),) * 2 if cell["i"] == cell["j"] else (np.flatnonzero(k == cell["i"]), np.flatnonzero(k == cell["j"]))
        close = x[a] @ x[b].T >= threshold
        if cell["i"] == cell["j"]:
            close = np.triu(close, 1)
        p, q = np.nonzero(close)
        p, q = a[p], b[q]
        if t:
            new = np.ones(len(p), bool)
            for u in range(t):
                new &= cell["sigs"][p, u] != cell["sigs"][q, u]
            p, q = p[new], q[new]
        return p, q

    def run(group: pa.Table) -> pa.Table:
        t, sig, i, j, k, g, rep, m = (group.column(c).to_numpy() for c in ("t", "sig", "i", "j", "k", "g", "rep", "m"))
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float64).reshape(-1, width)
        sigs = np.frombuffer(b"".join(group.column("sigs").to_pylist()), "<i4").reshape(len(x), -1)
        order = np.lexsort((g, k, j, i, sig, t))
        keys = np.stack([t, sig, i, j])[:, order]
        cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))
        out_g, out_n, out_a, out_b = [], [], [], []
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2:
                continue
            at = order[lo:hi]
            y = x[at] / np.linalg.norm(x[at], axis=1, keepdims=True)
            p, q = one({"x": y, "k": k[at], "t": int(t[at[0]]), "i": i[at[0]], "j": j[at[0]], "sigs": sigs[at]})
            if not len(p):
                continue
            links = np.bincount(p, m[at][q], len(at)) + np.bincount(q, m[at][p], len(at))
            root = local_roots(p, q, len(at))
            has = np.flatnonzero(links)
            out_g.append(g[at][has])
            out_n.append(links[has].astype(np.int64))
            out_a.append(rep[at][has])
            out_b.append(rep[at][root[has]])
        flat = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_g, out_n, out_a, out_b)]
        return pa.table([pa.array(f, pa.int64()) for f in flat], ["g", "n", "a", "b"])

    return run


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    base = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("vec"))
    keyed = base.withColumn("ok", F.col("id").isNotNull() & usable(F.col("vec")))
    # 128 bits that stand for all components; rows without part have none and join with nothing
    keyed = keyed.withColumn("h1", F.when(F.col("ok"), F.xxhash64("vec"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit("second"), F.col("vec"))))
    nodes = keyed.filter("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("vec").alias("vec"))
    nodes = stage(nodes.withColumn("g", F.monotonically_increasing_id()), "vectors")
    found = [_links(nodes.filter(F.size("vec") == width), width, threshold, recall) for width in lengths(nodes, "vec")]
    found = stage(reduce(DataFrame.unionAll, found, nodes.sparkSession.createDataFrame([], LINKS)), "vector-links")
    reach = components(found, "a", "b")
    links = found.groupBy("g").agg(F.sum("n").alias("n"))
    known = nodes.select("h1", "h2", "g", "rep", "m").join(links, "g", "left").join(reach, F.col("rep") == F.col("node"), "left")
    known = known.select("h1", "h2", F.col("m"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = keyed.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce(F.col("n") + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _links(nodes: DataFrame, width: int, threshold: float, recall: float) -> DataFrame:
    """Of nodes with ``width`` components: sums of links per node, and pairs with the same components as all links."""
    count = nodes.count()
    bits, tables = plan(count, threshold, recall)
    hashed = _hashed(nodes, width, bits, tables)
    sizes = hashed.groupBy("t", "sig").count().filter("count > 1")
    blocks = sizes.select("t", "sig", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = hashed.join(blocks, ["t", "sig"]).withColumn("k", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("g", "rep", "m", "vec", "sigs", "t", "sig", "k", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"))
    groups = max(1, count * tables // GROUP_ROWS)
    grouped = cells.withColumn("cell", F.pmod(F.xxhash64("t", "sig", "i", "j"), F.lit(groups))).groupBy("cell")
    return grouped.applyInArrow(_verify(width, threshold), LINKS)

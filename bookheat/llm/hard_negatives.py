"""Hard negatives from Hilbert-ordered candidate blocks with zone maps.

Rows are sorted by label and by their place on a Hilbert curve through the dimensions of largest spread, and written
as Parquet, one row per block of ``BLOCK_ROWS`` vectors of one label, with the smallest and largest value of each
dimension (the zone map). For an anchor, interval arithmetic on a zone map bounds the scores in its block from
both sides. A search runs in two steps: it first reads the ``FIRST`` blocks of largest bound, whose best rows give a floor,
and then every block whose bounds reach a window of scores above its floor. The zone maps alone decide which
blocks are read; the vectors of other blocks never leave their files.

Positives are a search in one window without ends among the blocks of the anchor's label, negatives one in a window per positive
among those of all other labels. Anchors meet zone maps and blocks in parts of bounded size, so neither side
is broadcast; a block is cut by rows, so a label or a vector with a third of all rows is many blocks.

Cases: rows without id or label, with a null vector or a null or non-finite component take no part; vectors
of different length never meet; of rows with one id, the smallest by label, then components, stands for all; equal scores go by smaller id; a
negative positive score has an empty window; scores beyond 64 bits are cut off there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookheat.llm.common import fan_out
from bookheat.session import stage

BLOCK_ROWS = 256
CURVE_DIMS = 16
CURVE_BITS = 4
FIRST = 4
#: Neighbouring blocks that a task reads together, and zone maps and anchors that meet in a task.
READ_BLOCKS = 64
ZONES = 4096
ANCHORS = 1024
K = 5
_MIN, _MAX = -(1 << 63), (1 << 63) - 1
_WINDOWS = "array<struct<tag:long,low:long,high:long,floor:long,floor_id:long>>"


def quantised(vec: Column) -> Column:
    """Each component ``x`` as ``floor(256 x)``."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def complete(vec: Column) -> Column:
    """Not null, without null or non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exact, cut off at 64 bits."""
    size = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if size < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    wide = a.astype(object) @ b.T.astype(object)
    return np.clip(wide, _MIN, _MAX).astype(np.int64) if a.shape[1] else np.zeros((len(a), len(b)), np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest inner product of each row of ``a`` with a vector inside each box."""
    pos, neg = np.maximum(a, 0), np.minimum(a, 0)
    both = np.concatenate([pos, neg], 1)
    return products(both, np.concatenate([lo, hi], 1)), products(both, np.concatenate([hi, lo], 1))


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits per dimension (at most 64 bits together)."""
    x = x.astype(np.uint64).copy()
    dims = x.shape[1]
    one = np.uint64(1)
    for q in (np.uint64(1 << k) for k in range(bits - 1, 0, -1)):
        p = q - one
        for i in range(dims):
            turn = (x[:, i] & q) != 0
            swap = np.where(turn, 0, (x[:, 0] ^ x[:, i]) & p).astype(np.uint64)
            x[:, 0] ^= np.where(turn, p, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint64)
    for q in (np.uint64(1 << k) for k in range(bits - 1, 0, -1)):
        flip ^= np.where(x[:, -1] & q, q - one, np.uint64(0))
    x ^= flip[:, None]
    out = np.zeros(len(x), np.uint64)
    for k in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[:, i] >> np.uint64(k)) & one)
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d) if d else np.zeros((len(column), 0), np.int64)


def _curves(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: the dimensions of largest spread, and the range of each."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                x = _matrix(b.column("vec").filter(pa.array(sizes == d)), d).astype(np.float64)
                cols = [np.full(d, d), np.arange(d), np.full(d, len(x)), x.sum(0), (x**2).sum(0), x.min(0), x.max(0)]
                kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["d", "at", "n", "s", "ss", "lo", "hi"])

    parts = rows.select("d", "vec").mapInArrow(partial, "d int, at int, n long, s double, ss double, lo double, hi double")
    each = parts.groupBy("d", "at").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spread = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2
    rank = F.row_number().over(W.partitionBy("d").orderBy(spread.desc(), "at"))
    top = each.withColumn("rank", rank).filter(F.col("rank") <= CURVE_DIMS).orderBy("d", "rank").collect()  # CURVE_DIMS rows per vector length
    out: dict[int, list] = {}
    for r in top:
        out.setdefault(r["d"], []).append((r["at"], r["lo"], r["hi"]))
    return {d: (np.array([v[0] for v in x]), np.array([v[1] for v in x]), np.array([v[2] for v in x])) for d, x in out.items()}


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (``id``, ``label``, ``d``, ``vec``) with ``place``, theirs on the curve."""
    curves = _curves(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, place = b.column("d").to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(sizes[sizes > 0]).tolist():
                pick, (at, lo, hi) = sizes == d, curves[d]
                x = _matrix(b.column("vec").filter(pa.array(pick)), d)[:, at]
                cells = ((x - lo) / np.maximum(hi - lo, 1) * ((1 << CURVE_BITS) - 1e-9)).astype(np.int64).clip(0, (1 << CURVE_BITS) - 1)
                place[pick] = (hilbert(cells, CURVE_BITS) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], [*b.schema.names, "place"])

    return rows.mapInArrow(run, "id long, label int, d int, vec array<long>, place long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows; a block ends where label or length change, or when it is full."""
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["d", "label", "lo", "hi", "least", "ids", "flat"]

    def block(d: int, label: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        values = [d, label, x.min(0), x.max(0), ids.min(), ids, x.ravel()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    held: tuple | None = None  # d, label, ids, vectors
    for b in batches:
        if not b.num_rows:
            continue
        d, label, ids = (b.column(c).to_numpy() for c in ("d", "label", "id"))
        edge = np.concatenate([[0], np.flatnonzero((np.diff(d) != 0) | (np.diff(label) != 0)) + 1, [b.num_rows]])
        for lo, hi in zip(edge.tolist(), edge[1:].tolist()):
            kind = (int(d[lo]), int(label[lo]))
            own, x = ids[lo:hi], _matrix(b.column("vec").slice(lo, hi - lo), kind[0])
            if held and held[:2] == kind:
                own, x = np.concatenate([held[2], own]), np.concatenate([held[3], x])
            elif held:
                yield block(*held)
            full = len(own) // BLOCK_ROWS * BLOCK_ROWS
            for k in range(0, full, BLOCK_ROWS):
                yield block(*kind, own[k : k + BLOCK_ROWS], x[k : k + BLOCK_ROWS])
            held = (*kind, own[full:], x[full:]) if full < len(own) else None
    if held:
        yield block(*held)


def index(rows: DataFrame) -> DataFrame:
    """Staged blocks of ``rows`` (``id``, ``label``, ``d``, ``vec``): ``block``, zone map, ids and vectors."""
    order = ["d", "label", "place", "id"]
    sorted_ = _placed(rows).repartitionByRange(fan_out(rows.sparkSession), *order).sortWithinPartitions(*order)
    cut = sorted_.select("id", "label", "d", "vec").mapInArrow(_cut, "d int, label int, lo array<long>, hi array<long>, least long, ids array<long>, flat array<long>")
    return stage(cut.withColumn("block", F.monotonically_increasing_id()), "candidate-blocks")


def _reaches(low: np.ndarray, high: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, lb: np.ndarray, ub: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a block (columns) can hold a row for a window (rows)."""
    inside = (ub >= low[:, None]) & (lb <= high[:, None])
    return inside & ((ub > floor[:, None]) | ((ub == floor[:, None]) & (least[None, :] <= floor_id[:, None])))


def _flat_windows(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(anchor of each window, its fields)."""
    ends = column.offsets.to_numpy()
    table = pa.RecordBatch.from_struct_array(column.flatten())
    return np.repeat(np.arange(len(column)), np.diff(ends)), {c: table.column(c).to_numpy() for c in table.schema.names}


def _ask(same: bool, first: bool):
    """Per anchor and part of blocks, the blocks to read."""

    def run(anchors: pa.Table, zones: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and zones.num_rows:
            d = anchors.column("d")[0].as_py()
            of, win = _flat_windows(anchors.column("windows").combine_chunks())
            a = _matrix(anchors.column("vec").combine_chunks(), d)
            lo, hi = (_matrix(zones.column(c).combine_chunks(), d) for c in ("lo", "hi"))
            lb, ub = bounds(a, lo, hi)
            block, least = zones.column("block").to_numpy(), zones.column("least").to_numpy()
            fits = (anchors.column("label").to_numpy()[:, None] == zones.column("label").to_numpy()[None, :]) == same
            ends = np.searchsorted(of, np.arange(len(a) + 1))
            for k in range(len(a)):
                w = slice(ends[k], ends[k + 1])
                may = fits[k] & _reaches(*(win[c][w] for c in ("low", "high", "floor", "floor_id")), lb[k], ub[k], least).any(0)
                pick = np.flatnonzero(may)
                if first and len(pick) > FIRST:
                    pick = pick[np.lexsort((block[pick], -ub[k][pick]))[:FIRST]]
                own = np.sort(block[pick])
                for part in np.split(own, np.flatnonzero(np.diff(own // READ_BLOCKS)) + 1):
                    if len(part):
                        out.append((k, int(part[0]) // READ_BLOCKS, part))
        at = pa.array([o[0] for o in out], pa.int64())
        cols = [anchors.column(c).take(at).combine_chunks() for c in ("anchor", "part", "d", "vec", "windows")]
        return pa.table([*cols, pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["anchor", "part", "d", "vec", "windows", "shelf", "blocks"])

    return run


def _read(k: int):
    """Best ``k`` rows of each window in the blocks asked for."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if asked.num_rows and held.num_rows:
            d = asked.column("d")[0].as_py()
            where = {b: n for n, b in enumerate(held.column("block").to_pylist())}
            ids = held.column("ids").combine_chunks()
            rows_of = np.diff(ids.offsets.to_numpy())
            base = np.cumsum(rows_of) - rows_of
            ids, x = ids.flatten().to_numpy(), held.column("flat").combine_chunks().flatten().to_numpy().reshape(int(rows_of.sum()), d)
            of, win = _flat_windows(asked.column("windows").combine_chunks())
            ends = np.searchsorted(of, np.arange(asked.num_rows + 1))
            a, anchor = _matrix(asked.column("vec").combine_chunks(), d), asked.column("anchor").to_numpy()
            for n, blocks in enumerate(asked.column("blocks").to_pylist()):
                at = np.concatenate([np.arange(base[p], base[p] + rows_of[p]) for p in (where[b] for b in blocks)])
                at = at[ids[at] != anchor[n]]
                score, own = products(a[n : n + 1], x[at])[0], ids[at]
                for w in range(ends[n], ends[n + 1]):
                    inside = np.flatnonzero((score >= win["low"][w]) & (score <= win["high"][w]))
                    if len(inside) > k:
                        kth = -np.partition(-score[inside], k - 1)[k - 1]
                        inside = inside[score[inside] >= kth]
                    best = inside[np.lexsort((own[inside], -score[inside]))[:k]]
                    for o, v in zip(out, (np.full(len(best), anchor[n]), np.full(len(best), win["tag"][w]), own[best], score[best])):
                        o.append(v)
        return pa.table([pa.array(np.concatenate(o) if o else [], pa.int64()) for o in out], ["anchor", "tag", "id", "score"])

    return run


def _search(tasks: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """Best ``k`` rows (``anchor``, ``tag``, ``rank``, ``id``, ``score``) of each window of ``tasks`` (``anchor``, ``label``, ``d``, ``vec``, ``windows``)."""
    zones = blocks.select("block", "d", "label", "lo", "hi", "least")
    shares = max(1, -(-zones.count() // ZONES))
    parts = max(1, -(-tasks.count() // ANCHORS))
    share = F.pmod(F.xxhash64(F.floor(F.col("block") / READ_BLOCKS)), F.lit(shares))
    zones = zones.withColumn("share", share).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tasks = tasks.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int"))
    tasks = stage(tasks, "anchors")

    def found(tasks: DataFrame, first: bool) -> DataFrame:
        left = tasks.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
        asked = left.groupBy("d", "part", "share").cogroup(zones.groupBy("d", "part", "share"))
        asked = asked.applyInArrow(_ask(same, first), f"anchor long, part int, d int, vec array<long>, windows {_WINDOWS}, shelf long, blocks array<long>")
        asked = stage(asked, "asked-blocks")
        wanted = asked.select(F.col("part").alias("p"), F.explode("blocks").alias("block")).distinct()
        shelf = F.floor(F.col("block") / READ_BLOCKS).alias("s")
        held = blocks.select("block", F.col("d").alias("e"), "ids", "flat").join(wanted, "block").select("e", "p", shelf, "block", "ids", "flat")
        read = asked.groupBy("d", "part", "shelf").cogroup(held.groupBy("e", "p", "s")).applyInArrow(_read(k), "anchor long, tag long, id long, score long")
        rank = F.row_number().over(W.partitionBy("anchor", "tag").orderBy(F.desc("score"), "id"))
        return stage(read.withColumn("rank", rank).filter(F.col("rank") <= k), "found-rows")

    floors = found(tasks, True).filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("score", "id")))).alias("floors"))
    raised = tasks.join(floors, "anchor", "left").withColumn(
        "windows",
        F.transform(
            "windows",
            lambda w: F.struct(
                w["tag"].alias("tag"),
                w["low"].alias("low"),
                w["high"].alias("high"),
                F.coalesce(F.col("floors")[w["tag"]]["score"], w["floor"]).alias("floor"),
                F.coalesce(F.col("floors")[w["tag"]]["id"], w["floor_id"]).alias("floor_id"),
            ),
        ),
    )
    return found(stage(raised.drop("floors"), "anchors"), False)


def _window(tag: Column, low: Column, high: Column) -> Column:
    return F.struct(tag.cast("long").alias("tag"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(_MIN).alias("floor"), F.lit(_MAX).alias("floor_id"))


def mine(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", label: str = "label", vec: str = "embedding", k: int = K) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` is a condition on ``id``. For each of the ``k`` best rows of an anchor's label (positives), the best ``k`` rows of other
    labels with a score between four fifths of the positive's and the positive's.
    """
    base = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & complete(F.col(vec)))
    base = base.select(F.col(vec_id).cast("long").alias("id"), F.struct(F.col(label).cast("int").alias("label"), quantised(F.col(vec)).alias("vec")).alias("row"))
    base = base.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", F.size("row.vec").alias("d"), "row.vec")
    base = stage(base, "quantised")
    blocks = index(base)
    asking = base.filter(anchors).select(F.col("id").alias("anchor"), "label", "d", "vec")
    whole = F.array(_window(F.lit(0), F.lit(_MIN), F.lit(_MAX)))
    positives = _search(asking.withColumn("windows", whole), blocks, True, k)
    # the smallest whole number that is not below four fifths of the score
    low = F.col("score") - F.expr("score div 5")
    windows = positives.filter("score >= 0").groupBy("anchor").agg(F.collect_list(_window(F.col("id"), low, F.col("score"))).alias("windows"))
    negatives = _search(asking.join(windows, "anchor"), blocks, False, k)
    known = positives.select("anchor", F.col("id").alias("tag"), F.col("score").alias("positive_score"))
    out = negatives.join(known, ["anchor", "tag"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

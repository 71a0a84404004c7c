"""Join of documents by the Jaccard similarity of their word n-grams, with signature trees.

A document's set holds the hashes of its distinct n-grams. Equal sets are one node. Two sets can only be
similar if they share one of their first ``n - ceil(t * n) + 1`` tokens in an order common to all, so such
tokens route sets to cells, and cells to tasks. The order puts tokens with few frequent words first (the
top bits of a token say how many it has), because n-grams of frequent words meet by chance; which words
count as frequent changes the work and never the result. A first verification compares each set with one leader of
each cell, which settles large groups of copies in linear work. Cells that still hold several components
are cut by size band, and further by hash into blocks, every two of which meet; a task builds a signature
tree (``signature_trees``) over its sets and descends it against itself. Of the pairs that the bounds
leave, all are verified; where a tree leaves very many, each set's best first and then all that still join
different components. So every pair
of different sets that could be similar is verified, pruned by a bound, or already connected by links.

Sizes: shuffled are the first tokens (a tenth of all at 0.9), counted on the map side, bitmaps of a quarter
byte per token for sets in open cells, and whole sets only for pairs that pass the bounds; a filter of
fixed size picks them at the second reading of the texts. Sets and tokens are told apart by 64-bit hashes.

Cases: a null text has no words; a document without words has size 0 and links with nothing; with fewer
words than n its whole sequence is one token; rows without id get no component and link nothing; repeated
rows share a component; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookheat.llm.common import chunks, lean, lean_group
from bookheat.llm.components import components
from bookheat.llm.hashing import WordHashes, grams, member, membership, mix
from bookheat.llm.signature_trees import Tree, common, demanded, signature
from bookheat.session import stage

FREQUENT_WORDS = 4096
LEAST_IN_CHUNK = 4
CLASS_BITS = 3
FEW = 4
BLOCK = 1024
GROUP_ROWS = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def frequent_words(docs: DataFrame, text: str) -> np.ndarray:
    """Hashes of the most frequent words, ascending; at most ``FREQUENT_WORDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in chunks(batches, "text"):
            times = Counter(chain.from_iterable(_split(t) for t in b.column("text").to_pylist()))
            often = [w for w, k in times.items() if k >= LEAST_IN_CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.of(often).view(np.int64)), pa.array([times[w] for w in often], pa.int64())], ["word", "times"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(lean(run), "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    top = counts.orderBy(F.desc("times"), "word").limit(FREQUENT_WORDS).select("word").toArrow()
    return np.sort(top.column("word").to_numpy().view(np.uint64))


def token_sets(texts: list[str | None], n: int, hashes: WordHashes, frequent: np.ndarray) -> list[np.ndarray]:
    """Distinct n-grams of each text as hashes under the number of their frequent words, ascending."""
    parts = [hashes.of(_split(t)) for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    h = np.concatenate(parts)
    known = np.zeros(len(h) + 1, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        known[1:] = np.cumsum(frequent[at] == h)

    def tokens(lo: int, hi: int, width: int) -> np.ndarray:
        level = np.minimum(known[lo + width : hi + 1] - known[lo : hi + 1 - width], (1 << CLASS_BITS) - 1).astype(np.uint64)
        return (grams(h[lo:hi], width) >> np.uint64(CLASS_BITS)) | (level << np.uint64(64 - CLASS_BITS))

    # laid end to end; the grams that reach over an end belong to no text
    every = tokens(0, len(h), n) if len(h) >= n else h[:0]
    out = []
    for end, p in zip(ends.tolist(), parts):
        lo = end - len(p)
        out.append(np.unique(every[lo : end - n + 1] if len(p) >= n else tokens(lo, end, len(p)) if len(p) else h[:0]))
    return out


def set_key(tokens: np.ndarray) -> int:
    total = mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total]))[0].astype(np.int64))


def profiles(docs: DataFrame, n: int, num: int, den: int, frequent: np.ndarray, doc_id: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """``id``, ``n`` (size), ``s`` (key of the set), ``first`` (routing tokens), ``sig`` of every document.

    With ``hashed`` also ``h``, the hash of the text.
    """
    more = ["h"] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in chunks(batches, "text"):
            sets = token_sets(b.column("text").to_pylist(), n, hashes, frequent)
            sizes = np.array([len(x) for x in sets])
            first = [x[: len(x) + (-num * len(x)) // den + 1 if len(x) else 0] for x in sets]
            ends = np.cumsum([0, *map(len, first)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first).view(np.int64)))
            keys = pa.array([set_key(x) if len(x) else None for x in sets], pa.int64())
            sigs = pa.array([signature(x) if len(x) else None for x in sets], pa.binary())
            cols = [b.column("id"), pa.array(sizes, pa.int64()), keys, lists, sigs, *[b.column(c) for c in more]]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "s", "first", "sig", *more])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), *[F.xxhash64(text).alias(c) for c in more])
    return stage(rows.mapInArrow(lean(run), "id long, n long, s long, first array<long>, sig binary" + ", h long" * hashed), "profiles")


def cells(rows: DataFrame) -> DataFrame:
    """``tok``, ``s``, ``n``, ``leader``, ``leader_n`` of the sets that share a routing token with another.

    Of the tokens that the very same sets have, such as those of one passage, the smallest stands for all.
    """
    known = rows.filter("id is not null and n > 0")
    each = known.select("s", "n", F.explode("first").alias("tok")).groupBy("tok")
    ends = each.agg(F.min(F.struct("s", "n")).alias("low"), F.max("s").alias("high")).filter("low.s <> high")
    shared = stage(ends.select("tok", F.col("low.s").alias("leader"), F.col("low.n").alias("leader_n")), "shared-tokens")
    words = rows.sparkSession.sparkContext.broadcast(membership(shared, "tok"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("first")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            keep = np.flatnonzero(member(words.value, flat.view(np.uint64)))
            at = pa.array(at[keep])
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), b.column("s").take(at), b.column("n").take(at)], ["tok", "s", "n"])

    sent = known.select("first", "s", "n").mapInArrow(lean(pick), "tok long, s long, n long")
    rows = stage(sent.groupBy("tok", "s").agg(F.first("n").alias("n")).join(shared, "tok"), "cells")
    same = rows.groupBy("tok").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "s")).alias("y"))
    one = same.groupBy("m", "x", "y").agg(F.min("tok").alias("tok")).select("tok")
    return stage(rows.join(one, "tok", "left_semi"), "cells")


def _overlap_possible(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, nb, x, y in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))):
                bits = common([x, y])
                count = np.bitwise_count(bits).sum(1, dtype=np.int64)
                most = int(np.bitwise_count(bits[0] & bits[1]).sum()) + min(na - int(count[0]), nb - int(count[1]))
                keep.append(min(most, na, nb) >= demanded(np.array([na + nb]), num, den)[0])
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _beside(pairs: DataFrame, sets: DataFrame, *cols: str) -> DataFrame:
    """``pairs`` (a, b) with the columns of both sets, named with a and b."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("s").alias(side), *[F.col(c).alias(c[0] + side) for c in cols]), side)
    return pairs


class Verifier:
    """Exact check of pairs of set keys; reads the sets of the pairs it is given from the texts."""

    def __init__(self, docs: DataFrame, rows: DataFrame, n: int, num: int, den: int, frequent: np.ndarray, doc_id: str, text: str):
        self.docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
        self.owners = rows.filter("id is not null and n > 0").groupBy("s").agg(F.min("id").alias("id"))
        self.n, self.num, self.den, self.frequent = n, num, den, frequent

    def sets(self, keys: DataFrame) -> DataFrame:
        """``s`` and ``x`` (packed tokens) of the keys asked for."""
        n, frequent, spark = self.n, self.frequent, keys.sparkSession
        owners = self.owners.join(keys, "s", "left_semi").select(F.xxhash64("id").alias("h"))
        words = spark.sparkContext.broadcast(membership(owners, "h"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in chunks(batches, "text"):
                b = b.filter(pa.array(member(words.value, b.column("h").to_numpy().view(np.uint64))))
                if not b.num_rows:
                    continue
                found = [t for t in token_sets(b.column("text").to_pylist(), n, hashes, frequent) if len(t)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(t) for t in found], pa.int64()), pa.array([t.tobytes() for t in found], pa.binary())], ["s", "x"])

        got = self.docs.select(F.xxhash64("id").alias("h"), "text").mapInArrow(lean(run), "s long, x binary")
        return stage(got.join(keys, "s", "left_semi").groupBy("s").agg(F.first("x").alias("x")), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar."""
        pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        keys = pairs.select(F.col("a").alias("s")).unionAll(pairs.select(F.col("b").alias("s"))).distinct()
        both = _beside(pairs, self.sets(keys), "x").select("a", "b", "xa", "xb")
        return stage(both.mapInArrow(lean(_similar(self.num, self.den)), "a long, b long"), "set-links")


def open_pairs(cell: DataFrame, sets: DataFrame, reach: DataFrame, num: int, den: int, few: bool) -> DataFrame:
    """Pairs (a, b) of sets of one cell, in different components, that signature trees leave.

    With ``few`` a tree that leaves more than ``FEW`` pairs per set gives only each set's pair with the
    largest bound, and a row without ``b`` that names its ``tok``, to be asked again.
    """
    step = math.log(den / num) * (1 + 1e-9)
    named = cell.join(reach, F.col("s") == F.col("node"), "left").select("tok", "s", "n", F.coalesce("component", "s").alias("c"))
    mixed = named.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("tok")
    # sets whose sizes allow a link lie in one band or in neighbouring ones, and meet in the upper band's group
    band = F.floor(F.log("n") / step).cast("int")
    rows = named.join(mixed, "tok").withColumn("own", band).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    size = rows.groupBy("tok", "band").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("own").alias("top"))
    # pairs of the lower band alone meet in that band's own group
    size = size.filter("lo <> hi and top = band").select("tok", "band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(size, ["tok", "band"]).withColumn("k", F.pmod(F.xxhash64("s"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tok", "band", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "k", "s", "n", "c")
    rows = stage(rows, "tree-members")
    groups = max(1, rows.count() // GROUP_ROWS)

    def run(group: pa.Table) -> pa.Table:
        tok, band, i, j, k, s, n, c = (group.column(x).to_numpy() for x in ("tok", "band", "i", "j", "k", "s", "n", "c"))
        sig = group.column("sig").to_pylist()
        order = np.lexsort((s, n, c, j, i, band, tok))
        keys = np.stack([tok, band, i, j])[:, order]
        cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))
        out_a, out_b, again = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for lo, hi in zip(cuts, cuts[1:]):
            at = order[lo:hi]
            if hi - lo < 2 or c[at[0]] == c[at[-1]]:
                continue
            found = list(Tree(common([sig[x] for x in at]), n[at], c[at]).pairs(num, den))
            if not found:
                continue
            a, b, slack = (np.concatenate(x) for x in zip(*found))
            if few and len(a) > FEW * len(at):
                again.append(tok[at[0]])
                ends, others, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([slack, slack])
                rank = np.lexsort((others, -value, ends))
                head = rank[np.flatnonzero(np.diff(ends[rank], prepend=-1))]
                a, b = ends[head], others[head]
            out_a.append(s[at[a]])
            out_b.append(s[at[b]])
        a, b = pa.array([*np.concatenate(out_a), *again], pa.int64()), pa.array([*np.concatenate(out_b), *[None] * len(again)], pa.int64())
        return pa.table([a, b], ["a", "b"])

    placed = rows.join(sets.select("s", "sig"), "s").withColumn("g", F.pmod(F.xxhash64("tok", "band", "i", "j"), F.lit(groups)))
    found = placed.groupBy("g").applyInArrow(lean_group(run), "a long, b long")
    ordered = [F.when(F.col("b").isNull(), F.col("a")).otherwise(F.least("a", "b")), F.when(F.col("b").isNotNull(), F.greatest("a", "b"))]
    return stage(found.select(ordered[0].alias("a"), ordered[1].alias("b")).distinct(), "open-pairs")


def join_components(docs: DataFrame, n: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` of every row of ``docs`` for a similarity of num / den."""
    rows, owners = _joined(docs, n, num, den, doc_id, text, False)
    least = owners.groupBy("c").agg(F.min("own").alias("component_id"))
    named = owners.join(least, "c").select("s", "component_id")
    out = rows.select("id", "n", "s").join(named, "s", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def kept_texts(docs: DataFrame, n: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``h`` (xxhash64 of the text) of one document of each component of sets: the smallest id, then hash.

    An id may stand with several texts; each text belongs to the component of its own set. Documents
    without words are all kept, rows without id are not.
    """
    rows, owners = _joined(docs, n, num, den, doc_id, text, True)
    found = rows.filter("id is not null").select("id", "h", "s").join(owners.select("s", "c"), "s", "left")
    best = found.filter("c is not null").groupBy("c").agg(F.min(F.struct("id", "h")).alias("k")).select("k.*")
    return best.unionAll(found.filter("c is null").select("id", "h")).distinct()


def _joined(docs: DataFrame, n: int, num: int, den: int, doc_id: str, text: str, hashed: bool) -> tuple[DataFrame, DataFrame]:
    """Profiles of the rows, and ``s``, ``own`` (its smallest id), ``c`` (component of sets) of every set."""
    frequent = frequent_words(docs, text)
    rows = profiles(docs, n, num, den, frequent, doc_id, text, hashed)
    cell = cells(rows)
    routed = cell.select("s").distinct()
    sets = rows.filter("n > 0").join(routed, "s", "left_semi").groupBy("s").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = stage(sets, "signatures")
    check = Verifier(docs, rows, n, num, den, frequent, doc_id, text)
    fit = cell.filter(f"s <> leader and {den} * n >= {num} * leader_n and {den} * leader_n >= {num} * n")
    stars = fit.select(F.col("s").alias("a"), F.col("leader").alias("b")).distinct()
    near = _beside(stars, sets.withColumnRenamed("sig", "x"), "n", "x")
    near = near.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(lean(_overlap_possible(num, den)), "a long, b long")
    links = check.links(near)
    reach = components(links, "a", "b")
    for few in (True, False):
        pairs = open_pairs(cell, sets, reach, num, den, few)
        links = links.unionAll(check.links(pairs.filter("b is not null")))
        reach = components(links, "a", "b")
        cell = cell.join(pairs.filter("b is null").select(F.col("a").alias("tok")), "tok", "left_semi")
    owners = rows.filter("id is not null and n > 0").groupBy("s").agg(F.min("id").alias("own"))
    return rows, owners.join(reach, F.col("s") == F.col("node"), "left").select("s", "own", F.coalesce("component", "s").alias("c"))

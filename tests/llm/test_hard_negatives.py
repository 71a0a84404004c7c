import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookheat.llm import hard_negatives
from bookheat.llm.hard_negatives import bounds, hilbert, mine, products

SCHEMA = "vec_id long, label int, embedding array<float>, id string, windows int, Label2 int"


def brute(rows, step, k=5):
    import math

    best = {}
    for i, label, vec in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in vec]
        if i not in best or (label, q) < best[i]:
            best[i] = (label, q)
    out = []
    for a, (label, q) in best.items():
        if a % step:
            continue
        score = {b: sum(x * y for x, y in zip(q, r)) for b, (_, r) in best.items() if b != a and len(r) == len(q)}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if best[b][0] == label][:k]:
            fit = [b for b in order if best[b][0] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:k]
            out += [(a, p, n, b, score[p], score[b]) for n, b in enumerate(fit, 1)]
    return sorted(out)


def found(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def clustered(seed, n, dims):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, rng.randint(0, 3), [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("seed, dims, block", [(1, 8, 16), (2, 3, 4), (3, 20, 256)])
def test_brute_force(spark, monkeypatch, seed, dims, block):
    # small parts, so that anchors, zone maps and blocks meet in many tasks
    for name, value in (("BLOCK_ROWS", block), ("ZONES", 8), ("ANCHORS", 3), ("READ_BLOCKS", 2), ("FIRST", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(seed, 400, dims)
    got = found(mine(frame(spark, rows), F.col("id") % 25 == 0))
    assert got == brute(rows, 25) and got


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 8)
    rows = clustered(5, 60, 4)
    rows += [(100 + i, i % 3, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]  # ties
    rows += [(200, None, [1.0] * 4), (201, 1, None), (202, 1, [1.0, None, 1.0, 1.0]), (203, 1, [float("nan"), 1.0, 1.0, 1.0]), (204, 2, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, 1, [1.0] * 4), (210, 1, []), (220, 1, []), (211, 2, []), (230, 0, [0.0] * 4)]
    rows += [(300 + i, i % 2, [i / 7, 1 - i / 9]) for i in range(20)]  # another length
    rows += [(10, 3, [9.0, 9.0, 9.0, 9.0]), (10, 0, [1.0, 2.0, 3.0, 4.0]), rows[0]]  # repeated ids and rows
    got = found(mine(frame(spark, rows), F.col("id") % 10 == 0))
    assert got == brute(rows, 10)
    assert any(r[0] == 300 for r in got) and any(r[0] == 110 for r in got)
    assert mine(frame(spark, rows).limit(0), F.col("id") % 10 == 0).collect() == []
    assert mine(frame(spark, [(1, 1, None)]), F.lit(True)).collect() == []


def test_large_components(spark):
    rows = [(i, i % 2, [3e37 * (-1) ** i, 1e6 * i]) for i in range(12)]
    assert len(found(mine(frame(spark, rows), F.col("id") == 0))) >= 0
    assert found(mine(frame(spark, [(i, i % 2, [2.0**20 * (i + 1), 2.0**18]) for i in range(12)]), F.col("id") % 2 == 0)) == brute([(i, i % 2, [2.0**20 * (i + 1), 2.0**18]) for i in range(12)], 2)


def test_few_blocks_are_read(spark, monkeypatch):
    """On clustered vectors, an anchor's search leaves most blocks unread."""
    read = Counter()
    real = hard_negatives.stage

    def watch(df, tag):
        out = real(df, tag)
        if tag == "asked-blocks":
            read["asked"] += out.select(F.sum(F.size("blocks"))).first()[0] or 0
            read["anchors"] += out.select("anchor").distinct().count()
        if tag == "candidate-blocks":
            read["blocks"] += out.count()
        return out

    monkeypatch.setattr(hard_negatives, "stage", watch)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (40, 6)) * 3
    rows = [(i, int(i % 40 % 4), (centres[i % 40] + rng.normal(0, 0.02, 6)).tolist()) for i in range(4000)]
    got = found(mine(frame(spark, rows), F.col("id") % 500 == 0))
    assert got == brute(rows, 500)
    # four searches, each at most two fifths of the blocks of an anchor
    assert read["asked"] < 0.4 * read["anchors"] * read["blocks"]


def test_bounds_and_products():
    rng = np.random.default_rng(2)
    x, a = rng.integers(-300, 300, (50, 7)), rng.integers(-300, 300, (9, 7))
    lb, ub = bounds(a, x.min(0)[None, :], x.max(0)[None, :])
    s = products(a, x)
    assert (s == a @ x.T).all() and (lb <= s).all() and (s <= ub).all()
    big = np.array([[2**40, 1]])
    assert products(big, big)[0, 0] == (1 << 63) - 1
    assert products(np.array([[2**30, 3]]), np.array([[2**30, 5]]))[0, 0] == 2**60 + 15


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 2), (4, 2)])
def test_hilbert_curve(dims, bits):
    """Every point once, and neighbours on the curve are neighbours in space."""
    side = 1 << bits
    points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = hilbert(points, bits)
    assert sorted(place.tolist()) == list(range(side**dims))
    walk = points[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()

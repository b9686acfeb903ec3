"""Hard negatives and centroid clustering against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import clustering, hard_negatives
from wakeline.llm.vectors import LIMIT

KINDS = "vec_id bigint, embedding array<float>, label int"
CLASHES = ["v", "block", "score", "rank", "cluster", "distance", "x", "tie"]


def vectors(n, size, seed, spread=0.4):
    rng = random.Random(seed)
    return [(k, [round(rng.uniform(-spread, spread + 0.2), 3) for _ in range(size)], rng.randrange(4)) for k in range(n)]


def awkward(size):
    rows = vectors(700, size, 1)
    one = rows[50][1]
    return rows + [
        (1000, one, 1), (1050, one, 1), (1001, one, 2), (1002, one, 2),  # ties
        (1100, None, 1), (1150, [0.1] * (size - 1) + [None], 1), (1200, [0.1] * (size - 1) + [math.nan], 2),
        (1250, [math.inf] + [0.2] * (size - 1), 0), (1300, [0.3] * size, None), (None, [0.3] * size, 1),
        (1350, [], 1), (1400, [0.5] * (size + 3), 2), (1450, [0.0] * size, 3), (1500, [-9.0] * size, 1),
        (1550, [3e38] + [0.0] * (size - 1), 2), (100, rows[100][1], rows[100][2]), (150, one, 1), (-50, one, 3),
    ]


def with_clashes(frame):
    return frame.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def scaled(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(max(-LIMIT, min(LIMIT, 256.0 * float(np.float32(x))))) for x in vector]


def plain_negatives(rows):
    taken = []
    for i, v, label in rows:
        v = scaled(v)
        if i is not None and v is not None and label is not None:
            row = (i, v, (label + 1) % 10 if i % 7 == 0 else label)
            if row not in taken:
                taken.append(row)
    out = []
    for anchor in taken:
        if anchor[0] % 50:
            continue
        score = lambda r: sum(a * b for a, b in zip(anchor[1], r[1]))
        ranked = sorted((r for r in taken if r is not anchor), key=lambda r: (-score(r), r[0], r[1]))
        for p in [r for r in ranked if r[2] == anchor[2]][:5]:
            s = score(p)
            fits = [r for r in ranked if r[2] != anchor[2] and 50 * s <= 100 * score(r) <= 95 * s]
            out += [(anchor[0], p[0], k, r[0], s, score(r)) for k, r in enumerate(fits[:3], 1)]
    return out


def collected(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("size", [1, 5, 37])
def test_hard_negatives(spark, size, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 300)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    rows = awkward(size)
    found = hard_negatives.hard_negatives(with_clashes(spark.createDataFrame(rows, KINDS).repartition(5)))
    assert collected(found) == sorted(plain_negatives(rows))


def test_hard_negatives_in_one_cell(spark):
    rows = vectors(1500, 6, 4)
    assert collected(hard_negatives.hard_negatives(spark.createDataFrame(rows, KINDS))) == sorted(plain_negatives(rows))


def test_equal_vectors_everywhere(spark):
    rows = [(k, [0.5, 0.25], k % 3) for k in range(400)]
    assert collected(hard_negatives.hard_negatives(spark.createDataFrame(rows, KINDS))) == sorted(plain_negatives(rows))


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 64, 33), (40, 7, 90), (128, 64, 256), (33, 0, 40)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(3)
    n, k, m = shape
    a, b = rng.integers(-LIMIT, LIMIT, (n, k)), rng.integers(-LIMIT, LIMIT, (k, m))
    whole = a.astype(object) @ b.astype(object) if k else np.zeros((n, m), object)
    assert (hard_negatives.strassen(a, b).astype(object) == whole).all()


def test_strassen_recurses(monkeypatch):
    seen = []
    real = hard_negatives._halves
    monkeypatch.setattr(hard_negatives, "_halves", lambda a, b, depth: seen.append(depth) or real(a, b, depth))
    hard_negatives.strassen(np.ones((64, 64), np.int64), np.ones((64, 64), np.int64))
    assert [seen.count(d) for d in (2, 1, 0)] == [1, 7, 49]


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(5)
    slot, score, order = rng.integers(0, 6, 500), rng.integers(0, 9, 500), rng.permutation(500)
    whole = hard_negatives.Heap(6, 4)
    whole.merge(slot, score, order)
    parts = hard_negatives.Heap(6, 4)
    for lot in np.array_split(rng.permutation(500), 7):
        parts.merge(slot[lot], score[lot], order[lot])
    assert (whole.order == parts.order).all() and (whole.score == parts.score).all()


def plain_clusters(rows, size, k, rounds):
    kept = [(i, scaled(v)) for i, v, _ in rows if v is not None and len(v) == size and scaled(v) is not None]
    name = lambda i: hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((name(i), v) for i, v in kept)][:k]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for c, m in zip(centroids, members)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, c in found if c == n) for n in range(len(centroids))}
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha(c)) for i, d, c in found), key=str)


@pytest.mark.parametrize("size, k, rounds", [(3, 40, 5), (8, 7, 2), (1, 12, 3), (5, 2000, 1)])
def test_clustering(spark, size, k, rounds):
    rows = awkward(size)
    frame = with_clashes(spark.createDataFrame(rows, KINDS).repartition(5))
    found = clustering.cluster_report(frame, size=size, k=k, rounds=rounds)
    assert sorted(map(tuple, found.collect()), key=str) == plain_clusters(rows, size, k, rounds)


def test_equal_centroids_take_the_smaller_number(spark):
    rows = [(k, [0.5, 0.5], 0) for k in range(60)] + [(100 + k, [0.9, 0.1], 0) for k in range(5)]
    found = clustering.cluster_report(spark.createDataFrame(rows, KINDS), size=2, k=30, rounds=2)
    assert sorted(map(tuple, found.collect()), key=str) == plain_clusters(rows, 2, 30, 2)


def test_the_tree_prunes():
    rng = np.random.default_rng(1)
    centroids = np.repeat(np.arange(40) * 10_000, 8).reshape(40, 8) + rng.integers(0, 50, (40, 8))
    tree = clustering.VantageTree(centroids)
    near = centroids[rng.integers(0, 40, 200)] + rng.integers(-20, 20, (200, 8))
    visits = []
    real = tree._visit
    tree._visit = lambda at, rows, *rest: visits.append(len(rows) * len(tree.nodes[at].items)) or real(at, rows, *rest)
    who, squared = tree.nearest(near)
    whole = ((near[:, None] - centroids[None]) ** 2).sum(2)
    assert (who == whole.argmin(1)).all() and (squared == whole.min(1)).all()
    assert sum(visits) < 0.5 * whole.size


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], KINDS)
    useless = spark.createDataFrame([(1, None, 1), (50, [math.nan], 2)], KINDS)
    for frame in (nothing, useless):
        assert hard_negatives.hard_negatives(frame).count() == 0
        assert clustering.cluster_report(frame, size=1).count() == 0

"""Centroid clustering against plain Python integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from pitpanel.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, v string"


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    points = [v for _, v in order[:k]]
    for done in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, p, strict=True)) for p in points] for _, v in kept]
        own = [d.index(min(d)) for d in far]
        if done < rounds:
            for j in range(len(points)):
                if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                    points[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    top, inertia = (1 << 63) - 1, Counter()
    for d, o in zip(far, own, strict=True):
        inertia[o] += min(d[o], top)
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, o, min(d[o], top), min(inertia[o], top), min(sum(inertia.values()), top), digest[o]) for (i, _), d, o in zip(kept, far, own, strict=True)), key=str)


def vectors(n, seed, spread):
    rnd = random.Random(seed)
    middles = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(7)]
    return [(i, [x + rnd.uniform(-spread, spread) for x in middles[i % 7]]) for i in range(n)]


def ties():
    """Vectors on a coarse grid with many equal distances and repeats."""
    rnd = random.Random(3)
    return [(i, [rnd.choice([0.0, 1 / 64]) if j < 4 else 0.0 for j in range(64)]) for i in range(120)]


ODD = [
    (900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.5] * 63 + [None]), (905, [float("nan")] * 64), (906, [0.1] * 63 + [float("inf")]),
    (None, [0.25] * 64), (907, [-0.0] * 64), (907, [-0.0] * 64), (908, [1e-300] * 64),
]


@pytest.mark.parametrize("rows", [vectors(150, 1, 0.4) + ODD, ties(), vectors(5, 2, 0.1), vectors(60, 4, 0.2) + [(500, [1e30] * 64), (501, [-3e25] * 64), (502, [70000.0] * 64)]])
def test_cluster(spark, rows):
    given = spark.createDataFrame([(i, e, 1, 7, "clash") for i, e in rows], SCHEMA).repartition(3)
    got = centroids.cluster(given)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_no_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, [0.5], 1, 1, "")], SCHEMA)).collect() == []


def test_bounds_skip_and_keep_ties():
    rnd = np.random.default_rng(0)
    v = np.floor(rnd.normal(size=(400, 64)) * 3 + 40 * rnd.integers(0, 4, (400, 1)))
    points = [[int(x) for x in v[i]] for i in range(16)]
    at = centroids.Centroids(points)
    cluster, _, upper, lower, looked = centroids.assign(v, at)
    assert looked == 400 * 16
    moved = centroids.Centroids([[x + (j % 3) for x in p] for j, p in enumerate(points)], points)
    got, best, upper, lower, looked = centroids.assign(v, moved, cluster, upper, lower)
    every = ((v[:, None, :] - moved.at[None]) ** 2).sum(axis=2)
    assert (got == every.argmin(axis=1)).all() and looked < 400 * 16 / 2
    assert (upper.astype(float) >= np.sqrt(every[np.arange(400), got])).all() and (lower.astype(float) <= np.sqrt(every)).all()
    # two centroids at the same place: the smaller number wins although bounds would let either pass
    same = centroids.Centroids([points[0], points[0]], [points[0], points[0]])
    got, *_ = centroids.assign(v, same, np.ones(400, np.int32), np.full(400, 1e6, np.float32), np.zeros((400, 2), np.float32))
    assert (got == 0).all()

"""Exact clusters against a plain version, with magnitudes beyond float64 and beyond 64 bits."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

centroids = pytest.importorskip("timberline.llm.centroids")

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, size, k, rounds):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda p: (hashlib.sha256(f"2:{p[0]}".encode()).hexdigest() if p[0] is not None else "~", p[1])
    held = [v for _, v in sorted(kept, key=rank)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(held))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(held)):
            if members := [v for (_, v), c in zip(kept, own, strict=True) if c == j]:
                held[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [near(v) for _, v in kept]
    long = lambda x: x if x < 1 << 63 else None
    total = sum(d for d, _ in found)
    out = [(i, c, long(d), long(sum(x for x, y in found if y == c)), long(total), hashlib.sha256(",".join(map(str, held[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, found, strict=True)]
    return sorted(out, key=repr)


def found(spark, rows, size, k, rounds):
    got = centroids.clustered(spark.createDataFrame(rows, SCHEMA).repartition(3), size, k, rounds)
    return sorted((tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("scale", [1.0, 3e7, 1e15, 1e30])
def test_magnitudes(spark, scale):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, scale) for _ in range(6)]) for i in range(120)]
    assert found(spark, rows, 6, 9, 3) == plain(rows, 6, 9, 3)


def test_mixed_magnitudes_meet_in_one_table(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 10.0 ** rng.choice([0, 3, 12, 40])) for _ in range(4)]) for i in range(80)]
    assert found(spark, rows, 4, 7, 3) == plain(rows, 4, 7, 3)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [5.0, -1.0]), (None, [2.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, []), (8, [-0.001, -1e-300])]
    for k in (1, 2, 4, 40):
        assert found(spark, rows, 2, k, 2) == plain(rows, 2, k, 2)
    assert found(spark, [(1, [1.0])], 2, 3, 2) == []
    assert found(spark, [], 2, 3, 2) == []
    same = [(i, [1.0, 2.0]) for i in range(30)]
    assert found(spark, same, 2, 4, 3) == plain(same, 2, 4, 3)


def test_the_guard_chooses_exact_arithmetic():
    rng = np.random.default_rng(1)
    for most in (1 << 20, 1 << 24, 1 << 28, 1 << 33):
        x, c = rng.integers(-most, most, (40, 16)), rng.integers(-most, most, (5, 16))
        got = centroids.distances(x, c.astype(object))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        assert [[int(v) for v in row] for row in got] == want

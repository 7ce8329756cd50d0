"""Centroid clustering against all distances in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from rasterloom.llm import clustering


def plain(rows, k, rounds, scale, dims):
    kept = [(key, [math.floor(scale * x) for x in v]) for key, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{'' if key is None else key}".encode()).hexdigest(), x) for key, x in kept)
    centres = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        centres = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    found = [(key, *near(x)[::-1]) for key, x in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centres))}
    return sorted(((key, j, d, inertia[j], sum(inertia.values()), digest[j]) for key, j, d in found), key=repr)


def report(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as x", "2 as id", "3 as cluster", "4 as short")
    return sorted((tuple(r) for r in clustering.cluster_report(df, **options).collect()), key=repr)


def test_equals_all_distances(spark):
    rng = np.random.default_rng(1)
    spots = rng.normal(0, 1, (6, 12))
    rows = [(i, (spots[i % 6] + rng.normal(0, 0.2, 12)).tolist()) for i in range(300)]
    rows += [(300, [math.nan] * 12), (301, [math.inf] * 12), (302, [0.0] * 11), (303, None), (304, [None] * 12), (None, [0.5] * 12), (305, [0.25] * 12), (305, [0.25] * 12)]
    options = {"k": 9, "rounds": 3, "scale": 16, "dimensions": 12}
    assert report(spark, rows, **options) == plain(rows, 9, 3, 16, 12)


def test_ties_and_few_rows(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(12)]  # equal centroids, equal distances
    for k in (1, 5, 12, 40):
        assert report(spark, rows, k=k, rounds=2, scale=2, dimensions=2) == plain(rows, k, 2, 2, 2)


def test_empty_and_huge(spark):
    assert report(spark, [], k=3, rounds=2, scale=2, dimensions=2) == []
    out = report(spark, [(0, [1e300, 0.0]), (1, [-1e300, 0.0])], k=1, rounds=1, scale=256, dimensions=2)
    most = clustering.limit_of(2)
    assert [r[2] for r in out] == [most * most] * 2 and out[0][4] == min(2 * most * most, clustering.LONGEST)


@pytest.mark.parametrize("spread", [1, 40, 1 << 20])
def test_bounds_never_exceed_distances(spread):
    rng = np.random.default_rng(spread)
    x, c = (rng.integers(-spread, spread + 1, (n, 64)) for n in (200, 30))
    a, b = (clustering.compressed(m).astype(float) for m in (x, c))
    far = np.sqrt(np.square(a[:, None] - b).sum(2))
    true = np.sqrt(np.square((x[:, None] - c).astype(float)).sum(2))
    assert (far <= true * (1 + 1e-6) + 1e-6).all()


def test_screening_saves_distances():
    rng = np.random.default_rng(3)
    centres = rng.integers(-100, 100, (40, 64))
    x = centres[rng.integers(0, 40, 5000)] + rng.integers(-8, 9, (5000, 64))
    screen = clustering.Screen(centres)
    label, distance = screen.nearest(x, clustering.compressed(x))
    every = np.square(x[:, None] - centres).sum(2)
    assert (label == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert screen.tested < 0.1 * every.size

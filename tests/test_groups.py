"""Poses and fits of groups: whole in tasks, in few jobs, with the rows of the way that keeps groups spread."""

import uuid

import numpy as np
import pytest

from rasterloom.operators import estimation, groups

K = [[800.0, 0.0, 320.0], [0.0, 800.0, 240.0], [0.0, 0.0, 1.0]]
LENS = (-0.2, 0.05, 0.001, -0.002, 0.01, 0.02, -0.01, 0.005)
POSE = np.array([0.1, -0.2, 0.05, 0.1, -0.1, 6.0])


def jobs(spark, run):
    """The number of Spark jobs of ``run``, and its result."""
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, "")
    found = run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), found


def scene(spark, planes=False, lens=(), outliers=False):
    """Group 1 of 60 points (in a plane, if asked for), 2 of 40 in space, 3 of three points, and points without a group."""
    rng, rows = np.random.default_rng(5), []
    for group, n in ((1, 60), (2, 40), (3, 3), (None, 2)):
        x = rng.uniform(-1, 1, (n, 3))
        if planes and group == 1:
            x[:, 2] = 0.3 * x[:, 0] - 0.2 * x[:, 1] + 0.1
        seen = estimation.project(x, POSE, estimation.Camera(np.array(K), lens)) + rng.normal(0, 0.3, (n, 2))
        if outliers:
            seen[::8, 0] += 70.0
        rows += [(group, *map(float, p), *map(float, q)) for p, q in zip(x, seen)]
    return spark.createDataFrame(rows, "group long, x double, y double, z double, u double, v double").repartition(3)


def poses(spark, planes=False, lens=(), outliers=False, guess=False):
    points = scene(spark, planes, lens, outliers)
    given = spark.createDataFrame([(g, [float(v) + 0.05 for v in POSE]) for g in (1, 2, 9)], "group long, model array<double>") if guess else None
    rows = estimation.solve_pnp(points, K, "ransac" if outliers else "iterative", guess=given, lens=lens).collect()
    return {r["group"]: (r["model"], r["n_points"], r["n_inliers"]) for r in rows}


VARIANTS = {
    "plain": {},
    "ransac": dict(outliers=True),
    "planes": dict(planes=True),
    "lens": dict(lens=LENS),
    "guess": dict(guess=True),
    "ransac_planes_lens": dict(planes=True, lens=LENS, outliers=True),
}


@pytest.mark.parametrize("name", VARIANTS)
def test_poses_in_tasks(spark, monkeypatch, name):
    n, got = jobs(spark, lambda: poses(spark, **VARIANTS[name]))
    assert n <= 15  # however many rounds a refinement takes
    monkeypatch.setattr(groups, "WHOLE", 3)  # groups 1 and 2 go in rounds
    want = poses(spark, **VARIANTS[name])
    assert set(got) == set(want) == {1, 2, 3, None}
    for group in got:
        assert got[group][1:] == want[group][1:]
        assert (got[group][0] is None) == (want[group][0] is None) == (group in (3, None))
        if group in (1, 2):
            assert np.allclose(got[group][0], want[group][0], atol=1e-6) and np.allclose(got[group][0], POSE, atol=0.02)


@pytest.mark.parametrize("lens", [(), LENS[:4], LENS[:5], LENS])
def test_pose_sums_against_differences(lens):
    camera, rng = estimation.Camera(np.array(K), lens), np.random.default_rng(7)
    x = rng.uniform(-1, 1, (50, 3))
    seen = estimation.project(x, POSE, camera) + rng.normal(0, 2, (50, 2))
    off = lambda p, rows: (estimation.project(x, p, camera) - seen).ravel()
    for pose in (POSE + 0.05, np.array([0, 0, 0, 0.1, 0.2, 5.0]), np.array([1e-6, -2e-6, 0, 0.1, 0.2, 5.0])[:6]):
        got, want = estimation._pose_sums(camera, np.column_stack([x, seen]).T)(pose), estimation.normal_sums(pose, None, off)
        assert np.allclose(got, want, rtol=1e-5, atol=1e-3 * np.abs(want).max() * 1e-3)


def test_lm_fit_in_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(g, float(x), float(g + 0.5 * x + e)) for g, n in ((1, 50), (2, 30), (3, 1)) for x, e in zip(rng.uniform(0, 9, n), rng.normal(0, 0.1, n))]
    points = spark.createDataFrame([*rows, (None, 1.0, 2.0)], "group long, x double, y double").repartition(3)
    line = lambda p, df: p[0] + p[1] * df["x"].to_numpy() - df["y"].to_numpy()
    fitted = lambda: {r["group"]: (r["model"], r["n_points"]) for r in estimation.lm_fit(points, [0.0, 0.0], line).collect()}
    n, got = jobs(spark, fitted)
    assert n <= 15
    monkeypatch.setattr(groups, "WHOLE", 3)
    want = fitted()
    assert set(got) == set(want) == {1, 2, 3} and all(got[g][1] == want[g][1] for g in got)
    for g in (1, 2):
        x, y = np.array([r[1:] for r in rows if r[0] == g]).T
        assert np.allclose(got[g][0], want[g][0], atol=1e-6) and np.allclose(got[g][0], np.polyfit(x, y, 1)[::-1], atol=1e-6)

"""Segments by rounds, against a plain version of the same law."""

import math
from collections import defaultdict

import numpy as np
import pytest

from rasterloom.operators import segments
from rasterloom.types import MatrixError, Shape


def plain(pixels, rho, theta, threshold, min_length, max_gap):
    """The rounds, pixel by pixel and cell by cell."""
    angles = [n * theta for n in range(int(math.pi / theta + 0.5))]
    left, out = set(pixels), []

    def cell(y, x, n):
        d = round(x * (math.cos(angles[n]) / rho) + y * (math.sin(angles[n]) / rho), 6)
        return n, int(math.copysign(math.floor(abs(d) + 0.5), d))

    while True:
        cells = defaultdict(list)
        for y, x in left:
            for n in range(len(angles)):
                cells[cell(y, x, n)].append((y, x))
        full = {c: p for c, p in cells.items() if len(p) >= threshold}
        choice = {}
        for (n, r), points in full.items():
            for p in points:
                choice[p] = min(choice.get(p, (0, 0, 0)), (-len(points), n, r))
        if not full:
            return sorted(out)
        left = set(choice)
        for (n, r), points in full.items():
            flat = abs(math.sin(angles[n])) > abs(math.cos(angles[n])) - 1e-9
            points, runs = sorted((x, y) if flat else (y, x) for y, x in points), []
            for p in points:
                if not runs or p[0] - runs[-1][-1][0] - 1 > max_gap:
                    runs.append([])
                runs[-1].append(p)
            for run in runs:
                members = [p[::-1] if flat else p for p in run]  # (y, x)
                if all(choice[p] == (-len(points), n, r) for p in members):
                    left -= set(members)
                    (y1, x1), (y2, x2) = members[0], members[-1]
                    if max(abs(x2 - x1), abs(y2 - y1)) >= min_length:
                        out.append((x1, y1, x2, y2))


def drawn(seed, noise, size=24):
    rng = np.random.default_rng(seed)
    m = rng.random((size, size)) < noise
    for _ in range(4):
        a, b = rng.integers(0, size, 2), rng.integers(0, size, 2)
        for t in np.linspace(0, 1, 2 * size):
            y, x = np.rint(a + t * (b - a)).astype(int)
            m[y, x] = rng.random() < 0.9
    return [(int(y), int(x)) for y, x in zip(*np.nonzero(m))]


def table(spark, images):
    return spark.createDataFrame([(i, y, x, 0, 255.0) for i, points in images.items() for y, x in points], "img long, y int, x int, c int, v double")


def found(df, images):
    rows = df.collect()
    return {i: sorted((r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows if r["img"] == i) for i in images}


@pytest.mark.parametrize("law", [(1.0, math.pi / 12, 6, 4, 1), (1.3, math.pi / 30, 8, 6, 2), (2.0, math.pi / 4, 3, 0, 0)])
def test_tasks_give_the_law(spark, monkeypatch, law):
    images = {i: drawn(i, (0.0, 0.05, 0.3, 1.0)[i % 4]) for i in range(8)} | {2**40: drawn(99, 0.1), 77: []}
    want = {i: plain(points, *law) for i, points in images.items()}
    assert sum(map(len, want.values())) > 20
    px = table(spark, images)
    assert found(segments.hough_lines_p(px, Shape(24, 24), *law), images) == want
    few = segments.WORK
    monkeypatch.setattr(segments, "WORK", 24 * 24 * 61)  # stacks of few images
    assert found(segments.hough_lines_p(px, Shape(24, 24), *law), images) == want
    assert few > segments.WORK


def test_rounds_of_shuffles_give_the_law(spark, monkeypatch):
    law = (1.0, math.pi / 12, 6, 4, 1)
    images = {i: drawn(i, (0.0, 0.3)[i % 2], 16) for i in range(4)}
    monkeypatch.setattr(segments, "WORK", 1)
    assert found(segments.hough_lines_p(table(spark, images), Shape(16, 16), *law), images) == {i: plain(p, *law) for i, p in images.items()}


@pytest.mark.parametrize("work", [1, segments.WORK])
def test_odd_input(spark, monkeypatch, work):
    monkeypatch.setattr(segments, "WORK", work)
    line = [(5, x) for x in range(4, 20)]
    px = table(spark, {1: line + line[:5] + [(5, 40), (-1, 3)], 2: line[:3]})
    px = px.unionByName(spark.createDataFrame([(1, 5, 3, 0, None), (1, 5, 2, 0, 0.0), (1, 5, 1, 1, 9.0)], px.schema))
    assert segments.hough_lines_p(px, Shape(24, 24), 1.0, math.pi / 2, 4, 3, 0).collect() == [(1, 4, 5, 19, 5)]
    assert segments.hough_lines_p(px.limit(0), Shape(24, 24), 1.0, math.pi / 2, 4, 3, 0).collect() == []
    with pytest.raises(MatrixError):
        segments.hough_lines_p(px, Shape(24, 24), 0.0, 1.0, 4, 3, 0)

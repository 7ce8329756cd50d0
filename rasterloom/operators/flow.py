"""Pyramidal Lucas-Kanade tracking between frames.

A point's window (bilinear, on both frames) gives a 2 x 2 system each round; a level is ``Criteria.max_count`` rounds
at most; levels go from coarse to fine, and a point stops where it rests. Frames of one tile meet their points in one task;
larger ones stay spread, and each round joins the points that still move, as rows, with the pixels of their windows. Both ways have
the same law: a missing pixel counts as 0 beside others, and is outside where no other is near.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.pixels import KEYS
from ..sources.spool import durable
from ..plans import taps as T
from ..types import Border, Criteria, Shape
from . import dense
from .neighbourhood import pyr_down, scharr


def build_optical_flow_pyramid(px: DataFrame, shape: Shape, win: tuple[int, int], levels: int, derivatives: bool = True) -> list[dict]:
    """Levels with their shape, image and Scharr derivatives, until the next would be no larger than the window."""
    out, now = [], px.select(*KEYS, "v")
    for level in range(levels + 1):
        entry = {"level": level, "shape": shape, "image": now}
        if derivatives:
            entry |= {"dx": scharr(now, shape, 1, 0, border=Border.CONSTANT), "dy": scharr(now, shape, 0, 1, border=Border.CONSTANT)}
        out.append(entry)
        small = Shape((shape.rows + 1) // 2, (shape.cols + 1) // 2)
        if small.cols <= win[0] or small.rows <= win[1]:
            break
        now, shape = pyr_down(now, shape)
    return out


def _window(points: DataFrame, px: DataFrame, x: str, y: str, win: tuple[int, int], columns: list[str]) -> DataFrame:
    """Bilinear values of ``columns`` in the window about (x, y): (img, id, _j, _i, columns)."""
    w, h = win
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in range(h) for i in range(w)])
    at = points.withColumn("_c", F.explode(cells)).withColumn("_x", F.col(x) - (w - 1) / 2.0 + F.col("_c.i")).withColumn("_y", F.col(y) - (h - 1) / 2.0 + F.col("_c.j"))
    x0, y0 = F.floor("_x"), F.floor("_y")
    dx, dy = F.col("_x") - x0, F.col("_y") - y0
    tap = lambda b, a, k: F.struct((y0 + b).cast("int").alias("y"), (x0 + a).cast("int").alias("x"), k.alias("w"))
    four = F.array(tap(0, 0, (1 - dx) * (1 - dy)), tap(0, 1, dx * (1 - dy)), tap(1, 0, (1 - dx) * dy), tap(1, 1, dx * dy))
    taps = at.withColumn("_t", F.explode(four)).select("img", "id", F.col("_c.j").alias("_j"), F.col("_c.i").alias("_i"), F.col("_t.y").alias("y"), F.col("_t.x").alias("x"), F.col("_t.w").alias("_w"))
    return taps.join(px, ["img", "y", "x"]).groupBy("img", "id", "_j", "_i").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in columns])


def calc_optical_flow_pyramid_lk(prev: DataFrame, nxt: DataFrame, shape: Shape, points: DataFrame, win: tuple[int, int] = (5, 5), levels: int = 2, criteria: Criteria = Criteria(10, 0.03), min_eigen: float = 1e-4, initial: bool = False) -> DataFrame:
    """(img, id, x, y, status, error) of points (img, id, x, y[, next_x, next_y]) of ``prev`` found in ``nxt``."""
    if dense.one_tile(shape):
        columns = ["x", "y", *(("next_x", "next_y") if initial else ("x", "y"))]
        kernel = lambda images, there, asked, _: tracked(*images, *there, asked, win, levels, criteria, min_eigen)
        return _told(dense.at_points([prev, nxt], shape, points, columns, kernel, ("x", "y", "status", "error")))
    a = build_optical_flow_pyramid(prev, shape, win, levels)
    b = build_optical_flow_pyramid(nxt, shape, win, levels, derivatives=False)
    return track_with_pyramids(a, b, points, win, criteria, min_eigen, initial)


def _told(found: DataFrame) -> DataFrame:
    return found.select("img", "id", "x", "y", F.col("status").cast("int").alias("status"), F.when(F.col("status") == 1, F.col("error")).alias("error"))


def _halved(a: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    taps = [T.half_taps(n) for n in a.shape[::-1]]
    half, seen = (dense.separable(m[None, :, :, None], *t)[0, :, :, 0] for m, t in ((a, taps), (there.astype(float), taps)))
    return np.sign(half) * np.floor(np.abs(half) + 0.5), seen > 0


Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # before, its derivatives across and down, after; where pixels are before and after


def tracked(prev: np.ndarray, nxt: np.ndarray, prev_there: np.ndarray, nxt_there: np.ndarray, asked: np.ndarray, win: tuple[int, int], levels: int, criteria: Criteria, min_eigen: float) -> np.ndarray:
    """(x, y, status, error) of the points (x, y, and where to begin) of one frame; a point stops when it rests."""
    pyramids = [(prev, nxt, prev_there, nxt_there)]
    for _ in range(levels):
        if min((s + 1) // 2 - w for s, w in zip(prev.shape, win[::-1])) <= 0:
            break
        (prev, prev_there), (nxt, nxt_there) = _halved(prev, prev_there), _halved(nxt, nxt_there)
        pyramids.append((prev, nxt, prev_there, nxt_there))
    smooth, slope = [3.0, 10.0, 3.0], [-1.0, 0.0, 1.0]
    steps = []
    for first, second, first_there, second_there in pyramids:
        taps = [[T.kernel_taps(n, k, border=Border.CONSTANT) for n, k in zip(first.shape[::-1], pair)] for pair in ((slope, smooth), (smooth, slope))]
        steps.append((first, *(dense.separable(first[None, :, :, None], *t)[0, :, :, 0] for t in taps), second, first_there, second_there))
    return followed(steps, asked, win, criteria, min_eigen)


def followed(steps: list[Level], asked: np.ndarray, win: tuple[int, int], criteria: Criteria, min_eigen: float) -> np.ndarray:
    """The same from the levels of a frame, the finest first."""
    top, area = len(steps) - 1, win[0] * win[1]
    j, i = (g.ravel() for g in np.mgrid[0 : win[1], 0 : win[0]])
    now, status, error = asked[:, 2:4] / 2.0**top, np.ones(len(asked)), np.zeros(len(asked))
    around = lambda p: (p[:, 1:2] - (win[1] - 1) / 2.0 + j, p[:, 0:1] - (win[0] - 1) / 2.0 + i)
    for level in range(top, -1, -1):
        first, dx, dy, second, first_there, second_there = steps[level]
        window, seen = dense.bilinear(first, *around(asked[:, :2] / 2.0**level), first_there)
        gx, gy = (dense.bilinear(d, *around(asked[:, :2] / 2.0**level), first_there)[0] / 32 for d in (dx, dy))
        a, b, d = (gx * gx).sum(1), (gx * gy).sum(1), (gy * gy).sum(1)
        det = a * d - b * b
        good = seen.all(1) & (det > 1e-7) & ((a + d - np.sqrt((a - d) ** 2 + 4 * b * b)) / (2 * area) >= min_eigen)
        moving = np.ones(len(now), bool)
        for _ in range(criteria.max_count):
            there, inside = dense.bilinear(second, *around(now), second_there)
            off = np.where(seen & inside, window - there, 0.0)
            e, f = (off * gx).sum(1), (off * gy).sum(1)
            ok = good & inside.any(1)
            if level == 0:
                status[moving & ~ok] = 0
            step = np.where((ok & moving)[:, None], np.column_stack([d * e - b * f, a * f - b * e]) / np.where(good, det, 1.0)[:, None], 0.0)
            now = now + step
            moving &= (step**2).sum(1) > criteria.epsilon**2
            if not moving.any():
                break
        if level:
            now = now * 2
        else:
            there, inside = dense.bilinear(second, *around(now), second_there)
            error = np.where(seen & inside, np.abs(window - there), 0.0).sum(1) / area
    found = status[:, None] == 1
    return np.column_stack([np.where(found, now, asked[:, :2]), status, error])


def track_with_pyramids(a: list[dict], b: list[dict], points: DataFrame, win: tuple[int, int] = (5, 5), criteria: Criteria = Criteria(10, 0.03), min_eigen: float = 1e-4, initial: bool = False) -> DataFrame:
    """The same from pyramids that the caller keeps: the next frame's pyramid serves again as the one before. Levels of frames of one tile meet their points in one task.

    Points whose window has too little structure are lost (status 0) and stay where they were.
    """
    top = len(a) - 1
    start = ("next_x", "next_y") if initial else ("x", "y")
    if dense.one_tile(a[0]["shape"]):
        sizes = [(e["shape"].rows, e["shape"].cols) for e in a]
        tables = [t for e, f in zip(a, b) for t in (e["image"], e["dx"], e["dy"], f["image"])]

        def kernel(images: list[np.ndarray], there: list[np.ndarray], asked: np.ndarray, _: tuple[int, int]) -> np.ndarray:
            steps = []
            for n, (rows, cols) in enumerate(sizes):
                (first, dx, dy, second), on = ([m[:rows, :cols] for m in side[4 * n : 4 * n + 4]] for side in (images, there))
                steps.append((first, dx, dy, second, on[0] & on[1] & on[2], on[3]))
            return followed(steps, asked, win, criteria, min_eigen)

        return _told(dense.at_points(tables, a[0]["shape"], points, ["x", "y", *start], kernel, ("x", "y", "status", "error")))
    state = points.select("img", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col(start[0]).cast("double") / 2.0**top).alias("_nx"), (F.col(start[1]).cast("double") / 2.0**top).alias("_ny"), F.lit(1).alias("status"))
    area = win[0] * win[1]
    for level in range(top, -1, -1):
        k = 2.0**level
        flat = lambda e, n: e.where("c = 0").select("img", "y", "x", F.col("v").alias(n))
        source = flat(a[level]["image"], "_i0").join(flat(a[level]["dx"], "_gx"), ["img", "y", "x"]).join(flat(a[level]["dy"], "_gy"), ["img", "y", "x"])
        here = state.select("img", "id", (F.col("x") / k).alias("_px"), (F.col("y") / k).alias("_py"))
        window = durable(_window(here, source, "_px", "_py", win, ["_i0", "_gx", "_gy"]).withColumn("_gx", F.col("_gx") / 32).withColumn("_gy", F.col("_gy") / 32))
        gx, gy = F.col("_gx"), F.col("_gy")
        normal = durable(window.groupBy("img", "id").agg(F.sum(gx * gx).alias("_a"), F.sum(gx * gy).alias("_b"), F.sum(gy * gy).alias("_d"), F.count("*").alias("_cells")))
        target = flat(b[level]["image"], "_i1")
        det = F.col("_a") * F.col("_d") - F.col("_b") * F.col("_b")
        eigen = ((F.col("_a") + F.col("_d")) - F.sqrt((F.col("_a") - F.col("_d")) ** 2 + 4 * F.col("_b") * F.col("_b"))) / (2.0 * area)
        good = (F.col("_cells") == area) & (det > 1e-7) & (eigen >= min_eigen)
        state = state.withColumn("_moves", F.lit(True))
        for _ in range(criteria.max_count):
            seen = _window(state.where("_moves").select("img", "id", "_nx", "_ny"), target, "_nx", "_ny", win, ["_i1"])
            diff = window.join(seen, ["img", "id", "_j", "_i"]).groupBy("img", "id").agg(F.sum((F.col("_i0") - F.col("_i1")) * gx).alias("_e"), F.sum((F.col("_i0") - F.col("_i1")) * gy).alias("_f"))
            j = state.join(normal, ["img", "id"], "left").join(diff, ["img", "id"], "left")
            safe = F.when(good, det).otherwise(1.0)
            ok = F.coalesce(good & F.col("_e").isNotNull(), F.lit(False))
            sx = F.when(ok & F.col("_moves"), (F.col("_d") * F.col("_e") - F.col("_b") * F.col("_f")) / safe).otherwise(0.0)
            sy = F.when(ok & F.col("_moves"), (F.col("_a") * F.col("_f") - F.col("_b") * F.col("_e")) / safe).otherwise(0.0)
            lost = F.when(~ok & F.col("_moves") & F.lit(level == 0), 0).otherwise(F.col("status"))
            state = durable(j.select("img", "id", "x", "y", (F.col("_nx") + sx).alias("_nx"), (F.col("_ny") + sy).alias("_ny"), lost.cast("int").alias("status"), (F.col("_moves") & (sx * sx + sy * sy > criteria.epsilon**2)).alias("_moves")))
            if state.where("_moves").isEmpty():
                break
        state = state.drop("_moves")
        if level:
            state = state.withColumn("_nx", F.col("_nx") * 2).withColumn("_ny", F.col("_ny") * 2)
        else:
            seen = _window(state.select("img", "id", "_nx", "_ny"), target, "_nx", "_ny", win, ["_i1"])
            error = window.join(seen, ["img", "id", "_j", "_i"]).groupBy("img", "id").agg((F.sum(F.abs(F.col("_i0") - F.col("_i1"))) / area).alias("error"))
            state = state.join(error, ["img", "id"], "left")
    found = F.col("status") == 1
    return state.select("img", "id", F.when(found, F.col("_nx")).otherwise(F.col("x")).alias("x"), F.when(found, F.col("_ny")).otherwise(F.col("y")).alias("y"), "status", F.when(found, F.col("error")).alias("error"))

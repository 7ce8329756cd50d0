"""Corners, edges, lines, circles and keypoints: images become rows.

Responses, votes and non-maximum suppression are tap joins, aggregations and windows; only what depends on the
order of one image's few candidates (greedy spacing, iterative refinement) runs in a grouped kernel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import taps as T
from ..sources.local import small_table
from ..sources.pixels import KEYS
from ..sources.spool import durable
from ..types import Border, Criteria, MatrixError, Shape
from . import dense
from .components import components
from .neighbourhood import gaussian_blur, resize, sobel
from .segments import hough_lines_p


def val() -> Column:
    return F.col("v")



def structure_tensor(px: DataFrame, shape: Shape, block: int, ksize: int = 3, border: Border = Border.REFLECT_101) -> DataFrame:
    """(img, y, x, c, ixx, ixy, iyy): block means of the products of the derivatives."""
    kernels = [T.sobel_kernels(ksize, dx, dy) for dx, dy in ((1, 0), (0, 1))]
    r, q = len(kernels[0][0]) // 2, block // 2  # of the derivatives and of the means
    ones = [0.0] * (block % 2 == 0) + [1.0] * block
    ones = ones[::-1] if block % 2 == 0 else ones  # an even block reaches further up and left

    def tensors(f: dense.Frame) -> dict[str, np.ndarray]:
        gx, gy = (f.correlated(f.v, *k) for k in kernels)
        near = f.near()
        # Sums of whole numbers are exact, so they are divided last: equal products of 8-bit images stay equal, and a tie of ixx and iyy a tie.
        out = {n: f.correlated(f.bordered(p, q), ones, ones) / block**2 for n, p in (("ixx", gx * gx), ("ixy", gx * gy), ("iyy", gy * gy))}
        return out if near is None else out | {"_keep": near}

    return dense.filtered(px, shape, (r + q, r + q), border, tensors, ("ixx", "ixy", "iyy"))


def tensor() -> tuple[Column, Column, Column]:
    return F.col("ixx"), F.col("ixy"), F.col("iyy")



def _eigen() -> tuple[Column, Column]:
    a, b, d = tensor()
    half = (a + d) / 2
    root = F.sqrt((a - d) * (a - d) / 4 + b * b)
    return half + root, half - root


def corner_eigen_vals_and_vecs(px: DataFrame, shape: Shape, block: int, ksize: int = 3, border: Border = Border.REFLECT_101) -> DataFrame:
    """(img, y, x, l1, l2, x1, y1, x2, y2): eigenvalues, larger first, and unit eigenvectors."""
    l1, l2 = _eigen()
    a, b, d = tensor()
    flat, up = F.abs(b) <= 1e-12 * (1 + a + d), F.when(a >= d, 1.0).otherwise(0.0)

    def vector(lam: Column, first: bool) -> tuple[Column, Column]:
        # (lam - d, b), or where that nearly vanishes the same direction from the matrix's other row
        other = (a < d) if first else (a >= d)
        ex = F.when(other, F.abs(b) if first else -F.abs(b)).otherwise(lam - d)
        ey = F.when(other, F.signum(b) * F.abs(lam - a)).otherwise(b)
        n = F.sqrt(ex * ex + ey * ey)
        return F.when(flat, up if first else 1 - up).otherwise(ex / n), F.when(flat, 1 - up if first else up).otherwise(ey / n)

    (x1, y1), (x2, y2) = vector(l1, True), vector(l2, False)
    t = structure_tensor(px, shape, block, ksize, border)
    return t.select("img", "y", "x", l1.alias("l1"), l2.alias("l2"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def corner_min_eigen_val(px: DataFrame, shape: Shape, block: int, ksize: int = 3, border: Border = Border.REFLECT_101) -> DataFrame:
    return structure_tensor(px, shape, block, ksize, border).select(*KEYS, _eigen()[1].alias("v"))


def corner_harris(px: DataFrame, shape: Shape, block: int, ksize: int = 3, k: float = 0.04, border: Border = Border.REFLECT_101) -> DataFrame:
    a, b, d = tensor()
    return structure_tensor(px, shape, block, ksize, border).select(*KEYS, (a * d - b * b - k * (a + d) * (a + d)).alias("v"))


def pre_corner_detect(px: DataFrame, shape: Shape, ksize: int = 3, border: Border = Border.REFLECT_101) -> DataFrame:
    """Ix^2 Iyy + Iy^2 Ixx - 2 Ix Iy Ixy."""
    kernels = [T.sobel_kernels(ksize, dx, dy) for dx, dy in ((1, 0), (0, 1), (2, 0), (0, 2), (1, 1))]
    r = len(kernels[0][0]) // 2

    def curvature(f: dense.Frame) -> dict[str, np.ndarray]:
        x, y, xx, yy, xy = (f.correlated(f.v, *k) for k in kernels)
        near = f.near()
        out = {"v": x * x * yy + y * y * xx - 2 * x * y * xy}
        return out if near is None else out | {"_keep": near}

    return dense.filtered(px, shape, (r, r), border, curvature)


def local_maxima(px: DataFrame, shape: Shape, strict: bool, margin: int = 1) -> DataFrame:
    """Pixels at least ``margin`` from the edge that no (strict: not even an equal) 3 x 3 neighbour tops."""


    def peaks(f: dense.Frame) -> dict[str, np.ndarray]:
        a, top = f.shift(f.v, 0, 0), dense.top_around(f, f.v)
        return {"v": a, "_keep": f.present(f.inner(margin) & (a > top if strict else a >= top))}

    return dense.filtered(px, shape, (1, 1), Border.CONSTANT, peaks, fill=-math.inf, outside=-math.inf)


#: Places a side of the tiles in which candidates are spaced.
SPACED_TILE = 512


def _decide(x: np.ndarray, y: np.ndarray, v: np.ndarray, kept: np.ndarray, own: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of a tile's own candidates are kept or still open, and which are kept, from all candidates within reach of it.

    In order of merit, a candidate near a kept one goes; one near a better open one stays open; any other own one is
    kept. One from around the tile stays open, as it may have better ones near it that this tile doesn't see.
    """
    cells = list(zip(np.floor(y / reach).astype(int).tolist(), np.floor(x / reach).astype(int).tolist()))
    held: dict[tuple[int, int], list[int]] = {}  # kept and open candidates by cells as wide as the reach
    kept, stays = kept.copy(), kept.copy()
    for n in np.flatnonzero(kept).tolist():  # what earlier rounds kept counts from the start
        held.setdefault(cells[n], []).append(n)
    for n in np.lexsort((x, y, -v)).tolist():
        if kept[n]:
            continue
        j, i = cells[n]
        near = [m for dj in (-1, 0, 1) for di in (-1, 0, 1) for m in held.get((j + dj, i + di), ()) if (x[m] - x[n]) ** 2 + (y[m] - y[n]) ** 2 < reach**2]
        if any(kept[m] for m in near):
            continue
        kept[n], stays[n] = own[n] and not near, True
        held.setdefault((j, i), []).append(n)
    return stays & own, kept


def _decided(near: DataFrame, reach: float) -> DataFrame:
    """``_decide`` for every tile; a task reads its tiles one after the other and holds one of them at a time."""
    names, keys = ("x", "y", "v", "kept", "own"), ("img", "_ty", "_tx")

    def whole(cols: list[np.ndarray]) -> pa.RecordBatch:
        new = np.flatnonzero(dense.changes(*cols[:3]))
        both = [_decide(*(c[a:b] for c in cols[3:]), reach) for a, b in zip(new, np.append(new[1:], len(cols[0])))]
        stays, kept = (np.concatenate(p) for p in zip(*both))
        return pa.RecordBatch.from_arrays([pa.array(c[stays]) for c in (cols[0], *cols[3:6], kept)], names=["img", "x", "y", "v", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in keys + names]
            cut = int(np.flatnonzero(dense.changes(*cols[:3]))[-1])  # the last tile may go on
            ends = held and any(h[-1] != c[0] for h, c in zip(held[-1][:3], cols))
            if held and (cut or ends):
                held.append([c[:cut] for c in cols])
                yield whole([np.concatenate(c) for c in zip(*held)])
                held = []
            elif cut:
                yield whole([c[:cut] for c in cols])
            held.append([c[cut:] for c in cols])
        if held:
            yield whole([np.concatenate(c) for c in zip(*held)])

    dealt = near.repartition(*keys).sortWithinPartitions(*keys).select(*keys, *names)
    return dealt.mapInArrow(run, "img long, x double, y double, v double, kept boolean")


def spaced(candidates: DataFrame, min_distance: float, most: int = 0, extent: Shape | None = None) -> DataFrame:
    """Candidates (img, x, y, v) taken greedily by v (ties: row-major) with a least distance; adds ``rank``.

    Tiles decide side by side, each with the candidates within ``min_distance`` around it, in rounds until none is
    open; the result is that of the serial order. Images within an ``extent`` of one tile need one round.
    """
    now = candidates.select(F.col("img").cast("long").alias("img"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").cast("double").alias("v"), F.lit(False).alias("kept"))
    reach = float(min_distance)
    if reach > 0:
        side = max(SPACED_TILE, 2 * math.ceil(reach))
        small = extent is not None and max(extent.rows, extent.cols) <= side
        tile = lambda p, by=0.0: F.floor((F.col(p) + by) / side)
        while True:
            if small:
                near = now.withColumn("_ty", F.lit(0)).withColumn("_tx", F.lit(0)).withColumn("own", F.lit(True))
            else:
                near = now.withColumn("_ty", F.explode(F.sequence(tile("y", -reach), tile("y", reach)))).withColumn("_tx", F.explode(F.sequence(tile("x", -reach), tile("x", reach))))
                near = near.withColumn("own", (F.col("_ty") == tile("y")) & (F.col("_tx") == tile("x")))
            now = _decided(near, reach)
            if small:
                break
            now = durable(now)
            if now.where("not kept").isEmpty():
                break
    ranked = now.withColumn("rank", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("v"), "y", "x")) - 1).drop("kept")
    return ranked.where(F.col("rank") < most) if most else ranked


def good_features_to_track(px: DataFrame, shape: Shape, max_corners: int, quality: float, min_distance: float, block: int = 3, use_harris: bool = False, k: float = 0.04) -> DataFrame:
    r = corner_harris(px, shape, block, 3, k) if use_harris else corner_min_eigen_val(px, shape, block)
    best = r.withColumn("_best", F.max("v").over(Window.partitionBy("img")))
    strong = local_maxima(r, shape, False).join(best.where(val() > F.col("_best") * quality).select(*KEYS), list(KEYS), "left_semi")
    return spaced(strong, min_distance, max_corners, shape)


def corner_sub_pix(px: DataFrame, shape: Shape, corners: DataFrame, win: int = 2, criteria: Criteria = Criteria(10, 1e-3)) -> DataFrame:
    """Corners (img, id, x, y) moved to where all gradients around are orthogonal to the way to them.

    Each round joins the corners with their window's pixels and solves the 2 x 2 normal equations from sums.
    """
    gx = sobel(px, shape, 1, 0).withColumnRenamed("v", "_gx")
    gy = sobel(px, shape, 0, 1).withColumnRenamed("v", "_gy")
    grads = gx.join(gy, list(KEYS)).where("c = 0").select("img", F.col("y").alias("_py"), F.col("x").alias("_px"), "_gx", "_gy")
    now = corners.select("img", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    cells = [(dy, dx) for dy in range(-win, win + 1) for dx in range(-win, win + 1)]
    for _ in range(criteria.max_count):
        around = now.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in cells])))
        around = around.withColumn("_py", (F.rint("y") + F.col("_o.dy")).cast("int")).withColumn("_px", (F.rint("x") + F.col("_o.dx")).cast("int"))
        j = around.join(grads, ["img", "_py", "_px"])
        w = F.exp(-(F.col("_o.dx") * F.col("_o.dx") + F.col("_o.dy") * F.col("_o.dy")) / float(win * win))
        a, b, c = w * F.col("_gx") * F.col("_gx"), w * F.col("_gx") * F.col("_gy"), w * F.col("_gy") * F.col("_gy")
        s = j.groupBy("img", "id").agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(c).alias("d"), F.sum(a * F.col("_px") + b * F.col("_py")).alias("p"), F.sum(b * F.col("_px") + c * F.col("_py")).alias("q"))
        det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
        safe = F.when(F.abs(det) < 1e-12, 1.0).otherwise(det)
        solved = s.select("img", "id", F.when(F.abs(det) >= 1e-12, (F.col("d") * F.col("p") - F.col("b") * F.col("q")) / safe).alias("_nx"), F.when(F.abs(det) >= 1e-12, (F.col("a") * F.col("q") - F.col("b") * F.col("p")) / safe).alias("_ny"))
        j = now.join(solved, ["img", "id"], "left")
        far = (F.abs(F.col("_nx") - F.col("x")) > win) | (F.abs(F.col("_ny") - F.col("y")) > win)
        stop = F.col("_nx").isNull() | far
        now = j.select("img", "id", F.when(stop, F.col("x")).otherwise(F.col("_nx")).alias("x"), F.when(stop, F.col("y")).otherwise(F.col("_ny")).alias("y"))
    return now


def _thinning(low: float, high: float, aperture: int, l2: bool) -> tuple[int, Callable[[dense.Frame], tuple[np.ndarray, np.ndarray]]]:
    """The reach of, and a kernel for, thinned edges of a tile and their strength, before hysteresis."""
    kernels = [T.sobel_kernels(aperture, dx, dy) for dx, dy in ((1, 0), (0, 1))]

    def thin(f: dense.Frame) -> tuple[np.ndarray, np.ndarray]:
        gx, gy = (f.correlated(f.v, *k) for k in kernels)
        m = np.hypot(gx, gy) if l2 else np.abs(gx) + np.abs(gy)
        angle = np.degrees(np.arctan2(gy, gx)) % 180
        line = np.where((angle < 22.5) | (angle >= 157.5), 0, np.where(angle < 67.5, 1, np.where(angle < 112.5, 2, 3)))
        m = f.bordered(m, 1, Border.CONSTANT)
        at = lambda dy, dx: f.shift(m, dy, dx, (1, 1))
        sides = [np.maximum(at(dy, dx), at(-dy, -dx)) for dy, dx in ((0, 1), (-1, 1), (1, 0), (1, 1))]
        own, near = at(0, 0), f.near()
        keep = f.inner(1) & (own >= low) & (own >= np.choose(f.shift(line, 0, 0, (1, 1)), sides))
        return own, keep if near is None else keep & near

    return len(kernels[0][0]) // 2 + 1, thin


def canny_candidates(px: DataFrame, shape: Shape, low: float, high: float, aperture: int = 3, l2: bool = False) -> DataFrame:
    """(img, y, x, strong): thinned edge pixels, before hysteresis."""
    low, high = min(low, high), max(low, high)
    r, thin = _thinning(low, high, aperture, l2)
    found = dense.filtered(px.where("c = 0"), shape, (r, r), Border.REFLECT_101, lambda f: dict(zip(("v", "_keep"), thin(f))))
    return found.select("img", "y", "x", (val() >= high).alias("strong"))


def _touching(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``mask`` (planes, rows, cols, 1) is set, as flat places, and for each the number of the first one that it hangs together with."""
    at = np.flatnonzero(mask)
    number = np.full(mask.shape[:3], -1)
    number.ravel()[at] = np.arange(len(at))
    pairs = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        rows, cols = mask.shape[1] - dy, mask.shape[2]
        left, right = max(0, -dx), cols - max(0, dx)
        a, b = number[:, :rows, left:right], number[:, dy:, left + dx : right + dx]
        both = (a >= 0) & (b >= 0)
        pairs.append((a[both], b[both]))
    a, b = (np.concatenate(side) for side in zip(*pairs))
    label = np.arange(len(at))
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return at, label


def canny(px: DataFrame, shape: Shape, low: float, high: float, aperture: int = 3, l2: bool = False) -> DataFrame:
    """255 on edges: candidates whose component (by 8-neighbourhood) has a strong one; one row for each pixel of the image.

    Candidates are labelled inside their tile; of larger images only labels that meet at tile edges go through the
    search for components.
    """
    low, high, single = min(low, high), max(low, high), dense.one_tile(shape)
    r, thin = _thinning(low, high, aperture, l2)

    def label(f: dense.Frame) -> dict[str, np.ndarray]:
        own, keep = thin(f)
        keep = np.broadcast_to(keep, own.shape)
        at, first = _touching(keep)
        strong = np.bincount(first, own.ravel()[at] >= high, len(at)) > 0
        y, x = (p.ravel()[at[first]] for p in np.broadcast_arrays(*np.ogrid[: own.shape[0], f.y : f.y + f.height, f.x : f.x + f.width, :1])[1:3])
        labels, marks = np.full(own.shape, -1.0), np.zeros(own.shape)
        labels.ravel()[at], marks.ravel()[at] = y * float(f.cols) + x, strong[first]
        there = np.broadcast_to(f.present(np.ones(own.shape, bool)), own.shape)
        return {"label": labels, "strong": marks, "there": there.astype(float), "_keep": there if single else there | keep}

    found = dense.filtered(px.where("c = 0"), shape, (r, r), Border.REFLECT_101, label, ("label", "strong", "there"))
    if single:
        return found.select(*KEYS, (F.col("strong") * 255).alias("v"))
    found = durable(found)
    edges = found.where("label >= 0")
    down, across = (dense.reaching(n, r, Border.REFLECT_101).starts for n in (shape.rows, shape.cols))
    begins = lambda p, starts: (F.col(p) > 0) & (F.col(p) % starts[1] == 0)
    ends = lambda p, starts: F.col(p) % starts[1] == starts[1] - 1
    over = lambda places: F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in places])
    none = over([(0, 0)])
    looks = F.array_union(F.when(begins("y", down), over([(-1, -1), (-1, 0), (-1, 1)])).otherwise(none), F.when(begins("x", across), over([(-1, -1), (0, -1), (1, -1)])).otherwise(none))
    asks = edges.where(begins("y", down) | begins("x", across)).select("img", F.col("label").alias("_from"), F.explode(looks).alias("_o"), "y", "x").where("_o.dy <> 0 or _o.dx <> 0")
    asks = asks.select("img", "_from", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"))
    met = asks.join(edges.where(ends("y", down) | ends("x", across)), ["img", "y", "x"])
    links = met.select(F.struct("img", F.col("_from").alias("label")).alias("a"), F.struct("img", "label").alias("b")).where("a <> b").distinct()
    labels = components(links)
    marked = edges.where("strong > 0").select(F.struct("img", "label").alias("node")).distinct()
    strong = labels.join(marked, "node", "left_semi").select("component").distinct()
    more = labels.join(strong, "component", "left_semi").select("node.img", "node.label", F.lit(1.0).alias("_more"))
    # Pixels that are no candidates have one label in common: they don't take part in the join.
    grown = edges.join(more, ["img", "label"], "left").withColumn("strong", F.greatest("strong", F.coalesce("_more", F.lit(0.0)))).select(*KEYS, "strong", "there")
    return grown.unionByName(found.where("label < 0").select(*KEYS, "strong", "there")).where("there > 0").select(*KEYS, (F.col("strong") * 255).alias("v"))


def _half_away(v: Column) -> Column:
    return F.signum(v) * F.floor(F.abs(v) + 0.5)


def hough_angles(theta: float, low: float, high: float) -> list[float]:
    """The grid of angles from ``low`` on; its last one goes where it would be the same line as angle 0."""
    grid = [low + n * theta for n in range(int((high - low) / theta) + 1)]
    return grid[:-1] if len(grid) > 1 and abs(grid[-1] - low - math.pi) < theta / 2 else grid


def hough_votes(px: DataFrame, shape: Shape, rho: float, theta: float, min_theta: float = 0.0, max_theta: float = math.pi) -> DataFrame:
    """(img, n, r, votes) of set pixels: n counts angles, r distances in steps of rho (of either sign)."""
    table = [(n, math.cos(a) / rho, math.sin(a) / rho) for n, a in enumerate(hough_angles(theta, min_theta, max_theta))]
    lines = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c"), F.lit(s).alias("s")) for n, c, s in table])
    votes = px.where("c = 0 and v <> 0").withColumn("_l", F.explode(lines))
    r = _half_away(F.round(F.col("x") * F.col("_l.c") + F.col("y") * F.col("_l.s"), 6))
    return votes.groupBy("img", F.col("_l.n").alias("n"), r.cast("int").alias("r")).agg(F.count("*").alias("votes"))


def hough_lines(px: DataFrame, shape: Shape, rho: float, theta: float, threshold: int, min_theta: float = 0.0, max_theta: float = math.pi) -> DataFrame:
    """(img, rho, theta, votes): cells above the threshold that top their four neighbours (ties: the first)."""
    votes = hough_votes(px, shape, rho, theta, min_theta, max_theta)
    for along, across in (("r", "n"), ("n", "r")):
        w = Window.partitionBy("img", across).orderBy(along)
        for name, step, to in (("before", F.lag, -1), ("after", F.lead, 1)):
            near = step(F.struct(along, "votes")).over(w)
            votes = votes.withColumn(f"_{along}_{name}", F.when(near[along] == F.col(along) + to, near["votes"]).otherwise(0))
    v = F.col("votes")
    best = votes.where((v > threshold) & (v > F.col("_r_before")) & (v >= F.col("_r_after")) & (v > F.col("_n_before")) & (v >= F.col("_n_after")))
    return best.select("img", (F.col("r") * float(rho)).alias("rho"), (F.col("n") * theta + min_theta).alias("theta"), "votes")


def hough_circle_votes(px: DataFrame, shape: Shape, dp: float, threshold: float, min_radius: int, max_radius: int) -> tuple[DataFrame, DataFrame]:
    """Votes (img, y, x, v) for centres along the gradients of edge pixels, and those pixels."""
    kernels = [T.sobel_kernels(3, dx, dy) for dx, dy in ((1, 0), (0, 1))]

    def steep(f: dense.Frame) -> dict[str, np.ndarray]:
        gx, gy = (f.correlated(f.v, *k) for k in kernels)
        m = np.sqrt(gx * gx + gy * gy)
        return {"_gx": gx, "_gy": gy, "_m": m, "_keep": f.present(m > max(threshold, 1.0))}

    edges = dense.filtered(px, shape, (1, 1), Border.REPLICATE, steep, ("_gx", "_gy", "_m"))
    steps = edges.withColumn("_r", F.explode(F.array(*[F.lit(float(s * r)) for s in (-1, 1) for r in range(min_radius, max_radius + 1)])))
    place = lambda p, g: _half_away(F.round((F.col(p) + F.col("_r") * F.col(g) / F.col("_m")) / dp, 6)).cast("int")
    votes = steps.select("img", place("y", "_gy").alias("y"), place("x", "_gx").alias("x"))
    h, w = math.ceil(shape.rows / dp), math.ceil(shape.cols / dp)
    inside = votes.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    return inside.groupBy("img", "y", "x").agg(F.count("*").cast("double").alias("v")).withColumn("c", F.lit(0)).select(*KEYS, "v"), edges.select("img", "y", "x")


def hough_circles(px: DataFrame, shape: Shape, dp: float, min_dist: float, param1: float, param2: float, min_radius: int, max_radius: int) -> DataFrame:
    """(img, x, y, radius, votes): strict local maxima of the votes, spaced, with the commonest distance of edge pixels."""
    votes, edges = hough_circle_votes(px, shape, dp, param1, min_radius, max_radius)
    frame = Shape(math.ceil(shape.rows / dp), math.ceil(shape.cols / dp))
    centres = local_maxima(votes, frame, True).where(val() > max(int(param2), 0))
    kept = spaced(centres.select("img", (F.col("x") * dp).alias("x"), (F.col("y") * dp).alias("y"), "v"), min_dist, extent=shape)
    # Pixels meet centres by cells as wide as the largest radius: a centre asks its own and the eight around.
    wide = float(max_radius + 1)
    cell = lambda p: F.floor(F.col(p) / wide)
    around = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (-1, 0, 1) for i in (-1, 0, 1)])
    asking = kept.withColumn("_a", F.explode(around)).withColumn("_cy", cell("y") + F.col("_a.j")).withColumn("_cx", cell("x") + F.col("_a.i")).drop("_a")
    answering = edges.select("img", F.col("x").alias("_ex"), F.col("y").alias("_ey")).withColumn("_cy", cell("_ey")).withColumn("_cx", cell("_ex"))
    far = F.sqrt((F.col("_ex") - F.col("x")) * (F.col("_ex") - F.col("x")) + (F.col("_ey") - F.col("y")) * (F.col("_ey") - F.col("y")))
    near = asking.join(answering, ["img", "_cy", "_cx"]).withColumn("_d", far).where(F.col("_d").between(min_radius, max_radius))
    counts = near.groupBy("img", "rank", "x", "y", "v", F.floor(F.col("_d") + 0.5).cast("int").alias("radius")).agg(F.count("*").alias("n"))
    best = counts.withColumn("_k", F.row_number().over(Window.partitionBy("img", "rank").orderBy(F.desc("n"), "radius"))).where((F.col("_k") == 1) & (F.col("n") >= int(param2) // 2))
    return best.select("img", "x", "y", "radius", F.col("v").alias("votes"))


# Rings of FAST: (dx, dy) round the centre, in order (fixed values).
RINGS = {
    "9_16": ([(0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1), (-3, 0), (-3, 1), (-2, 2), (-1, 3)], 9, 3),
    "7_12": ([(0, 2), (1, 2), (2, 1), (2, 0), (2, -1), (1, -2), (0, -2), (-1, -2), (-2, -1), (-2, 0), (-2, 1), (-1, 2)], 7, 3),
    "5_8": ([(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)], 5, 1),
}


def _arcs(f: dense.Frame, ring: list[tuple[int, int]], arc: int, margin: int, threshold: int, nonmax: bool = False) -> dict[str, np.ndarray]:
    more = int(nonmax)
    a = f.shift(f.v, 0, 0, more=more)
    d = [p - a for p in f.shifts([(dy, dx) for dx, dy in ring], more)]
    runs = [[d[(s + k) % len(ring)] for k in range(arc)] for s in range(len(ring))]
    v = np.maximum(np.maximum.reduce([np.minimum.reduce(r) for r in runs]), -np.minimum.reduce([np.maximum.reduce(r) for r in runs])) - 1
    found = f.inner(margin, more) & (v >= threshold)
    if not nonmax:
        return {"v": v, "_keep": found}
    top = dense.top_around(f, np.where(found, v, -np.inf))
    own = f.shift(v, 0, 0, (1, 1))
    return {"v": own, "_keep": f.shift(found, 0, 0, (1, 1)) & (own > top)}


def fast_scores(px: DataFrame, shape: Shape, threshold: int, kind: str = "9_16", nonmax: bool = False) -> DataFrame:
    """(img, y, x, c, v) of corners: v is the largest threshold that a contiguous arc still passes; ``nonmax``: only those
    that top the corners around them. A place with a missing pixel on its ring is no corner."""
    ring, arc, margin = RINGS[kind]
    reach = max(abs(n) for place in ring for n in place) + int(nonmax)
    return dense.filtered(px, shape, (reach, reach), Border.REPLICATE, lambda f: _arcs(f, ring, arc, margin, threshold, nonmax), fill=math.nan)


def fast(px: DataFrame, shape: Shape, threshold: int = 10, nonmax: bool = True, kind: str = "9_16") -> DataFrame:
    """FAST keypoints (img, y, x, response, size, angle)."""
    found = fast_scores(px, shape, threshold, kind, nonmax)
    return found.select("img", "y", "x", val().alias("response"), F.lit(7.0).alias("size"), F.lit(-1.0).alias("angle"))


def umax(half: int) -> list[int]:
    """Half widths of the rows of a round patch that its diagonal mirrors onto itself."""
    disc = [round(math.sqrt(half * half - v * v)) for v in range(half + 1)]
    return [w if v <= w else max(u for u in range(half + 1) if u <= disc[u] and disc[u] >= v) for v, w in enumerate(disc)]


def orientation(px: DataFrame, keypoints: DataFrame, half: int = 15) -> DataFrame:
    """Keypoints (img, y, x, ...) with the angle (degrees) of the intensity centroid of their round patch."""
    reach = umax(half)
    cells = [(dy, dx) for dy in range(-half, half + 1) for dx in range(-reach[abs(dy)], reach[abs(dy)] + 1)]
    patch = F.broadcast(small_table(px.sparkSession, cells, "_dy int, _dx int"))
    rows = sorted({dy for dy, _ in cells})
    asked = keypoints.select("img", F.col("y").alias("_ky"), F.col("x").alias("_kx")).distinct().withColumn("_dy", F.explode(F.array(*[F.lit(r) for r in rows]))).join(patch, "_dy")
    asked = asked.withColumn("y", F.col("_ky") + F.col("_dy")).withColumn("x", F.col("_kx") + F.col("_dx"))
    m = asked.join(px.where("c = 0"), ["img", "y", "x"]).groupBy("img", F.col("_ky").alias("y"), F.col("_kx").alias("x")).agg(F.sum(val() * F.col("_dy")).alias("_m01"), F.sum(val() * F.col("_dx")).alias("_m10"))
    angle = F.degrees(F.atan2("_m01", "_m10"))
    return keypoints.drop("angle").join(m, ["img", "y", "x"], "left").withColumn("angle", F.when(angle < 0, angle + 360).otherwise(F.coalesce(angle, F.lit(0.0)))).drop("_m01", "_m10")


def brief_pattern(half: int = 15, pairs: int = 256, seed: int = 31) -> list[tuple[int, int, int, int]]:
    """Pairs of places in a patch, normally distributed about its centre (drawn once from the seed)."""
    p = np.clip(np.rint(np.random.default_rng(seed).normal(0, half / 2.5, (pairs, 4))), -half + 2, half - 2).astype(int)
    return [tuple(r) for r in p.tolist()]


def describe(px: DataFrame, shape: Shape, keypoints: DataFrame, half: int = 15) -> DataFrame:
    """Keypoints (img, id, y, x, angle) with ``descriptor``: 32 bytes of turned comparisons on the smoothed image."""
    smooth = gaussian_blur(px.where("c = 0"), shape, (7, 7), 2.0, 2.0).select("img", F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.round(val(), 6).alias("_s"))
    pattern = [(2 * k + e, p[2 * e], p[2 * e + 1]) for k, p in enumerate(brief_pattern(half)) for e in (0, 1)]
    spots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, a, b in pattern])
    t = F.radians("angle")
    asked = keypoints.withColumn("_p", F.explode(spots)).withColumn("_c", F.cos(t)).withColumn("_n", F.sin(t))
    turn_x = F.rint(F.col("_p.a") * F.col("_c") - F.col("_p.b") * F.col("_n"))
    turn_y = F.rint(F.col("_p.a") * F.col("_n") + F.col("_p.b") * F.col("_c"))
    clip = lambda v, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), v.cast("int")))
    asked = asked.select("img", "id", F.col("_p.k").alias("_k"), clip(F.col("y") + turn_y, shape.rows).alias("_sy"), clip(F.col("x") + turn_x, shape.cols).alias("_sx"))
    lit = asked.join(smooth, ["img", "_sy", "_sx"])
    bits = lit.groupBy("img", "id", F.floor(F.col("_k") / 2).cast("int").alias("_b")).agg((F.max(F.when(F.col("_k") % 2 == 0, F.col("_s"))) < F.max(F.when(F.col("_k") % 2 == 1, F.col("_s")))).alias("_on"))
    weight = F.when(F.col("_on"), F.pow(F.lit(2.0), F.col("_b") % 8)).otherwise(0.0)
    bytes_ = bits.groupBy("img", "id", F.floor(F.col("_b") / 8).cast("int").alias("_i")).agg(F.sum(weight).cast("int").alias("_v"))
    return keypoints.join(bytes_.groupBy("img", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("descriptor")), ["img", "id"])


def _described(a: np.ndarray, asked: np.ndarray, first: tuple[int, int], shape: Shape, half: int) -> np.ndarray:
    """(y, x, response, angle, 32 bytes) of keypoints (y, x, response), from the part of their image that begins at ``first``."""
    y, x = asked[:, 0].astype(int) - first[0], asked[:, 1].astype(int) - first[1]
    reach = umax(half)
    dy, dx = np.array([(j, i) for j in range(-half, half + 1) for i in range(-reach[abs(j)], reach[abs(j)] + 1)]).T
    frame = np.pad(a, half)  # places outside count as 0
    disc = frame[y[:, None] + dy + half, x[:, None] + dx + half]
    angle = np.degrees(np.arctan2((disc * dy).sum(1), (disc * dx).sum(1))) % 360
    k = T.gaussian_kernel(7, 2.0)  # where the part ends inside the image, its outer places are wrong and nobody asks for them
    smooth = np.round(dense.separable(a[None, :, :, None], T.kernel_taps(a.shape[1], k), T.kernel_taps(a.shape[0], k))[0, :, :, 0], 6)
    p = np.array(brief_pattern(half)).reshape(-1, 2, 2)
    c, n = (f(np.radians(angle))[:, None, None] for f in (np.cos, np.sin))
    tx, ty = np.rint(p[..., 0] * c - p[..., 1] * n).astype(int), np.rint(p[..., 0] * n + p[..., 1] * c).astype(int)
    row = np.clip(y[:, None, None] + ty, -first[0], shape.rows - 1 - first[0])
    col = np.clip(x[:, None, None] + tx, -first[1], shape.cols - 1 - first[1])
    seen = smooth[row, col]
    bits = np.packbits(seen[..., 0] < seen[..., 1], axis=1, bitorder="little")
    return np.column_stack([asked, angle, bits])


def level_quota(n: int, levels: int, scale: float) -> list[int]:
    """Keypoints of each pyramid level: a geometric share, and the rest for the last."""
    f = 1 / scale
    each, out = n * (1 - f) / (1 - f**levels), []
    for _ in range(levels - 1):
        out.append(int(round(each)))
        each *= f
    return [*out, max(0, n - sum(out))]


def orb_pyramid(px: DataFrame, shape: Shape, levels: int = 8, scale: float = 1.2) -> list[tuple[DataFrame, Shape]]:
    """Each level resized from the one before."""
    out, now = [(px, shape)], px
    for k in range(1, levels):
        s = Shape(int(math.floor(shape.rows / scale**k + 0.5)), int(math.floor(shape.cols / scale**k + 0.5)))
        now = resize(now, out[-1][1], s.rows, s.cols)
        out.append((now, s))
    return out


def orb(px: DataFrame, shape: Shape, features: int = 500, levels: int = 8, scale: float = 1.2, edge: int = 31, threshold: int = 20, half: int = 15, score: str = "harris") -> DataFrame:
    """ORB keypoints with descriptors: (img, id, level, x, y, size, angle, response, descriptor).

    ``score``: keypoints of a level are ranked by their Harris response, or by that of FAST ("fast").

    The comparison pattern is drawn from a seed, so descriptors match each other, not those of other libraries.
    """
    found = None
    for level, ((now, s), quota) in enumerate(zip(orb_pyramid(px, shape, levels, scale), level_quota(features, levels, scale))):
        if s.rows <= 2 * edge or s.cols <= 2 * edge:
            break
        now = durable(now)  # three readers or more
        corners = fast(now, s, threshold).where(F.col("y").between(edge, s.rows - 1 - edge) & F.col("x").between(edge, s.cols - 1 - edge))
        harris = corner_harris(now, s, 7, 3, 0.04).select("img", "y", "x", F.col("v").alias("_h"))
        ranked = corners if score == "fast" else corners.join(harris, ["img", "y", "x"]).withColumn("response", F.col("_h")).drop("_h")
        ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("response"), "y", "x"))).where(F.col("_n") <= quota)
        ranked = ranked.withColumn("id", F.col("_n") + level * 1_000_000).drop("_n")
        k = scale**level
        names = ["angle", *(f"_b{i}" for i in range(32))]
        kernel = lambda images, _, asked, first, s=s: _described(images[0], asked, first, s, half)
        told = dense.at_points([now], s, durable(ranked), ["y", "x", "response"], kernel, ["y", "x", "response", *names], reach=2 * half + 4, place=("y", "x"))
        turned = told.select("img", "id", "y", "x", "response", "angle", F.array(*[F.col(n).cast("int") for n in names[1:]]).alias("descriptor"))
        part = turned.select("img", "id", F.lit(level).alias("level"), (F.col("x") * k).alias("x"), (F.col("y") * k).alias("y"), F.lit((2 * half + 1) * k).alias("size"), "angle", "response", "descriptor")
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise MatrixError("the image is smaller than twice the edge")
    return found


def overlap(x1: Column, y1: Column, s1: Column, x2: Column, y2: Column, s2: Column) -> Column:
    """Area of the intersection over that of the union of two keypoint circles (sizes are diameters)."""
    a, b = s1 / 2, s2 / 2
    c = F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
    low, high = F.least(a, b), F.greatest(a, b)
    safe = F.when(c == 0, 1.0).otherwise(c)
    one = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (b * b - a * a + c * c) / (2 * b * safe)))
    two = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a * a - b * b + c * c) / (2 * a * safe)))
    t1, t2 = F.acos(one), F.acos(two)
    both = a * a * t2 - a * a * F.sin(t2) * F.cos(t2) + b * b * t1 - b * b * F.sin(t1) * F.cos(t1)
    union = (a * a + b * b) * math.pi
    return F.when(low + high <= c, 0.0).when(c + low <= high, low * low / (high * high)).otherwise(both / (union - both))


def convert_to_points(keypoints: DataFrame) -> DataFrame:
    return keypoints.select("img", "ord", F.col("pt.x").alias("x"), F.col("pt.y").alias("y"))


def convert_to_points_masked(keypoints: DataFrame, wanted: DataFrame) -> DataFrame:
    """Points of the keypoints that ``wanted`` (img, ord) lists."""
    return convert_to_points(keypoints.join(wanted.select("img", "ord").distinct(), ["img", "ord"], "left_semi"))


def convert_from_points(points: DataFrame, size: float = 1.0, response: float = 1.0, octave: int = 0, class_id: int = -1) -> DataFrame:
    return points.select(
        "img", "ord", F.struct(F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y")).alias("pt"), F.lit(size).alias("size"), F.lit(-1.0).alias("angle"), F.lit(response).alias("response"), F.lit(octave).alias("octave"), F.lit(class_id).alias("class_id")
    )


def draw_keypoints(px: DataFrame, shape: Shape, keypoints: DataFrame, colour: list[float]) -> DataFrame:
    """Circles about keypoints (img, y, x, size, angle) and a line along their angle, drawn into the image."""
    r = F.greatest(F.lit(1), F.floor(F.col("size") / 2 + 0.5).cast("int"))
    ring = keypoints.withColumn("_r", r).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(359))))
    t = F.radians(F.col("_a").cast("double"))
    circle = ring.select("img", F.rint(F.col("y") + F.col("_r") * F.sin(t)).cast("int").alias("y"), F.rint(F.col("x") + F.col("_r") * F.cos(t)).cast("int").alias("x"))
    ray = keypoints.where("angle >= 0").withColumn("_r", r).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_r"))))
    line = ray.select("img", F.rint(F.col("y") + F.col("_s") * F.sin(F.radians("angle"))).cast("int").alias("y"), F.rint(F.col("x") + F.col("_s") * F.cos(F.radians("angle"))).cast("int").alias("x"))
    return painted(px, shape, circle.unionByName(line), colour)


def painted(px: DataFrame, shape: Shape, places: DataFrame, colour: list[float]) -> DataFrame:
    from ..types import scalar

    inside = places.where(F.col("y").between(0, shape.rows - 1) & F.col("x").between(0, shape.cols - 1)).distinct().withColumn("_on", F.lit(True))
    return px.join(inside, ["img", "y", "x"], "left").select(*KEYS, F.when(F.col("_on"), scalar(list(colour), F.col("c"))).otherwise(val()).alias("v"))


def draw_matches(a: DataFrame, sa: Shape, b: DataFrame, sb: Shape, lines: DataFrame, colour: list[float]) -> DataFrame:
    """Both images side by side, with a line for each match (img, x1, y1, x2, y2) from the left to the right one."""
    from ..sources.pixels import grid
    from .structural import moved

    canvas = Shape(max(sa.rows, sb.rows), sa.cols + sb.cols, sa.channels)
    blank = grid(a.select("img").distinct(), canvas)
    both = a.select(*KEYS, F.col("v").alias("_v")).unionByName(moved(b, x=F.col("x") + sa.cols).select(*KEYS, F.col("v").alias("_v")))
    filled = blank.join(both, list(KEYS), "left").select(*KEYS, F.coalesce("_v", val()).alias("v"))
    dx, dy = F.col("x2") + sa.cols - F.col("x1"), F.col("y2") - F.col("y1")
    steps = F.greatest(F.lit(1), F.rint(F.greatest(F.abs(dx), F.abs(dy))).cast("int"))
    walk = lines.withColumn("_n", steps).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = F.col("_s") / F.col("_n")
    places = walk.select("img", F.rint(F.col("y1") + dy * at).cast("int").alias("y"), F.rint(F.col("x1") + dx * at).cast("int").alias("x"))
    return painted(filled, canvas, places, colour)

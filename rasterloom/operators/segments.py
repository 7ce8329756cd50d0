"""Segments of an image's set pixels, found in rounds that may take many segments at once.

In a round every open pixel votes for the lines through it, one for each angle. Pixels that are in no full cell (one with
``threshold`` votes) leave: votes only fall. The others choose their fullest cell (ties: the first angle). Along a full cell
its pixels form runs, which end at more than ``max_gap`` missing places; a run all of whose pixels chose its cell is taken.
The fullest cell's pixels all choose it, so each round takes a run; runs of one round have no pixel in common. A taken
run of ``min_length`` or more is a segment; its pixels leave, long or short. Nothing depends on an order of pixels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.spool import durable, shared_folder
from ..types import MatrixError, Shape

SCHEMA = "img long, x1 int, y1 int, x2 int, y2 int"
WORK = 1 << 22  # votes of one image, were all its pixels set, up to which a task takes the image whole


def line_table(rho: float, theta: float) -> list[tuple[float, float, bool]]:
    """(cos / rho, sin / rho, along x) for each angle; a line at angle t has the direction (-sin t, cos t), diagonals go along x."""
    angles = [n * theta for n in range(int(math.pi / theta + 0.5))]
    return [(math.cos(a) / rho, math.sin(a) / rho, abs(math.sin(a)) > abs(math.cos(a)) - 1e-9) for a in angles]


def runs_of(img: np.ndarray, y: np.ndarray, x: np.ndarray, table: list[tuple[float, float, bool]], threshold: int, max_gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last pixel of every taken run, of any number of images at once."""
    cos, sin, flat = (np.array(t) for t in zip(*table))
    open_, ends = np.arange(len(img)), [(np.empty(0, np.int64),) * 2]
    while len(open_):
        i, j, k = img[open_], y[open_], x[open_]
        d = np.round(k[:, None] * cos + j[:, None] * sin, 6)
        r = (np.sign(d) * np.floor(np.abs(d) + 0.5)).astype(np.int64)
        r -= r.min()
        cell = (i[:, None] * len(cos) + np.arange(len(cos))) * (r.max() + 1) + r
        _, of, count = np.unique(cell.ravel(), return_inverse=True, return_counts=True)
        votes = count[of].reshape(cell.shape)
        chosen = votes.argmax(1)
        p, n = np.nonzero(votes >= threshold)
        if not len(p):
            break
        major, minor = np.where(flat[n], k[p], j[p]), np.where(flat[n], j[p], k[p])
        order = np.lexsort((minor, major, cell[p, n]))
        p, n, major = p[order], n[order], major[order]
        cut = np.append(True, (np.diff(cell[p, n]) != 0) | (np.diff(major) - 1 > max_gap))
        first = np.flatnonzero(cut)
        length = np.diff(np.append(first, len(p)))
        taken = np.logical_and.reduceat(chosen[p] == n, first)
        ends.append((open_[p[first[taken]]], open_[p[(first + length - 1)[taken]]]))
        stays = np.zeros(len(open_), bool)
        stays[p] = True
        stays[p[np.repeat(taken, length)]] = False
        open_ = open_[stays]
    return tuple(np.concatenate(e) for e in zip(*ends))


def _whole(points: DataFrame, table: list[tuple[float, float, bool]], threshold: int, max_gap: int) -> DataFrame:
    """Runs of images that fit a task; a task takes as many at once as have ``WORK`` votes."""
    most = max(1, WORK // len(table))

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        img, y, x = cols
        new = np.append(True, (img[1:] != img[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1]))
        img, y, x = img[new], y[new], x[new]
        b, e = runs_of(np.unique(img, return_inverse=True)[1], y, x, table, threshold, max_gap)
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (img[b], x[b], y[b], x[e], y[e])], names=["img", "x1", "y1", "x2", "y2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)]
        for batch in batches:
            held = [np.append(h, batch.column(n).to_numpy()) for h, n in zip(held, ("img", "y", "x"))]
            if len(held[0]) >= most:
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last image may go on
                if cut:
                    yield found([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield found(held)

    return points.repartition("img").sortWithinPartitions("img", "y", "x").mapInArrow(run, SCHEMA)


def _spread(points: DataFrame, table: list[tuple[float, float, bool]], threshold: int, max_gap: int) -> DataFrame:
    """Runs of images of any size: a round is three shuffles of the votes, by cells, by pixels and by runs.

    No partition of a window is larger than the pixels near one line or the angles of one pixel. Rounds end in checkpoints,
    their runs in a table of the shared folder; the driver only asks whether pixels are left.
    """
    lines = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c"), F.lit(s).alias("s"), F.lit(a).alias("a")) for n, (c, s, a) in enumerate(table)])
    folder = shared_folder(points.sparkSession, "segments")
    cell, run, pixel = ["img", "n", "r"], ["img", "n", "r", "run"], ["img", "y", "x"]
    d = F.round(F.col("x") * F.col("_l.c") + F.col("y") * F.col("_l.s"), 6)
    r = (F.signum(d) * F.floor(F.abs(d) + 0.5)).cast("int")
    along = Window.partitionBy(*cell).orderBy("major", "minor")
    gap = F.col("major") - F.lag("major").over(along) - 1
    open_ = points.distinct()
    while True:
        votes = open_.withColumn("_l", F.explode(lines)).select(*pixel, "_l.n", r.alias("r"), F.when(F.col("_l.a"), F.col("x")).otherwise(F.col("y")).alias("major"), F.when(F.col("_l.a"), F.col("y")).otherwise(F.col("x")).alias("minor"))
        full = votes.withColumn("votes", F.count("*").over(Window.partitionBy(*cell))).where(F.col("votes") >= threshold)
        full = full.withColumn("_gap", gap).withColumn("run", F.sum((F.coalesce("_gap", F.lit(0)) > max_gap).cast("int")).over(along))
        chose = F.min(F.struct(-F.col("votes"), "n")).over(Window.partitionBy(*pixel))
        chosen = full.withColumn("_own", chose["n"] == F.col("n"))
        now = durable(chosen.select(*pixel, "n", "r", "run", "major", "minor", F.min("_own").over(Window.partitionBy(*run)).alias("taken")))
        end = F.struct("major", "minor", "x", "y")
        ends = now.where("taken").groupBy(*run).agg(F.min(end).alias("b"), F.max(end).alias("e"))
        ends.select("img", F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), F.col("e.x").alias("x2"), F.col("e.y").alias("y2")).write.mode("append").parquet(folder)
        if now.isEmpty():
            return points.sparkSession.read.schema(SCHEMA).parquet(folder)
        open_ = now.groupBy(*pixel).agg(F.max("taken").alias("_t")).where("not _t").select(*pixel)


def hough_lines_p(px: DataFrame, shape: Shape, rho: float, theta: float, threshold: int, min_length: float, max_gap: int) -> DataFrame:
    """(img, x1, y1, x2, y2): segments of set pixels (channel 0, value neither 0 nor null), by rounds of votes.

    ``rho`` and ``theta`` are the steps of a line's distance and angle. Ends come in the order of x for flat lines, of y for
    steep ones. Repeated rows of a pixel count once, pixels beyond the shape don't count, an image without a full cell has
    no rows. Images with up to ``WORK`` votes are taken whole, many in a task; both ways give the same rows.
    """
    if rho <= 0 or theta <= 0 or threshold < 1:
        raise MatrixError("rho and theta have to be positive, and the threshold at least 1")
    table = line_table(rho, theta)
    inside = F.col("y").between(0, shape.rows - 1) & F.col("x").between(0, shape.cols - 1)
    points = px.where((F.col("c") == 0) & (F.col("v") != 0) & inside).select(*(F.col(n).cast(t).alias(n) for n, t in (("img", "long"), ("y", "int"), ("x", "int"))))
    runs = (_whole if shape.rows * shape.cols * len(table) <= WORK else _spread)(points, table, threshold, max_gap)
    return runs.where(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) >= float(min_length))

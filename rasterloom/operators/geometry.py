"""Gathers by computed places: each target place asks for up to four source pixels by an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.pixels import KEYS, grid
from ..types import Border, MatrixError, Shape, scalar, truncate_cast


def val() -> Column:
    return F.col("v")



def inside(p: Column, n: int, border: Border) -> Column:
    """The place in [0, n) that stands for p, or null."""
    if border == Border.REPLICATE:
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), p))
    if border == Border.WRAP:
        return F.pmod(p, F.lit(n))
    if border in (Border.REFLECT, Border.REFLECT_101):
        if n == 1:
            return F.lit(0)
        period = 2 * n if border == Border.REFLECT else 2 * n - 2
        q = F.pmod(p, F.lit(period))
        return F.when(q < n, q).otherwise(period - q - (1 if border == Border.REFLECT else 0))
    return F.when((p >= 0) & (p < n), p)


def remap(px: DataFrame, shape: Shape, maps: DataFrame, interpolation: str = "linear", border: Border = Border.CONSTANT, value=0.0, depth: str = "f64") -> DataFrame:
    """Pixels at the places of ``maps``: (img, y, x, map_x, map_y), or without img for all images alike."""
    channels = px.select("img", "c").distinct()
    asked = maps.join(channels, "img") if "img" in maps.columns else _for_all(channels, maps)
    mx, my = F.col("map_x"), F.col("map_y")
    if interpolation == "nearest":
        half = lambda a: (F.signum(a) * F.floor(F.abs(a) + 0.5)).cast("int")
        taps = asked.select(*KEYS, half(my).alias("_sy"), half(mx).alias("_sx"), F.lit(1.0).alias("_w"))
    elif interpolation == "linear":
        x0, y0 = F.floor(mx), F.floor(my)
        dx, dy = mx - x0, my - y0
        tap = lambda j, i, w: F.struct((y0 + j).cast("int").alias("sy"), (x0 + i).cast("int").alias("sx"), w.alias("w"))
        four = F.array(tap(0, 0, (1 - dx) * (1 - dy)), tap(0, 1, dx * (1 - dy)), tap(1, 0, (1 - dx) * dy), tap(1, 1, dx * dy))
        taps = asked.withColumn("_t", F.explode(four)).select(*KEYS, F.col("_t.sy").alias("_sy"), F.col("_t.sx").alias("_sx"), F.col("_t.w").alias("_w"))
    else:
        raise MatrixError(f"no interpolation {interpolation}")
    taps = taps.select(*KEYS, inside(F.col("_sy"), shape.rows, border).alias("_sy"), inside(F.col("_sx"), shape.cols, border).alias("_sx"), "_w")
    source = px.select("img", F.col("y").alias("_sy"), F.col("x").alias("_sx"), "c", F.col("v").alias("_s"))
    found = taps.join(source, ["img", "_sy", "_sx", "c"], "left")
    out = found.groupBy(*KEYS).agg(F.sum(F.col("_w") * F.coalesce("_s", scalar(value, F.col("c")))).alias("v"))
    return out.withColumn("v", truncate_cast(F.round(val(), 9) if depth in ("u8", "i8", "u16", "i16", "i32") else val(), depth))


PART = 1 << 20  # places of a map that are sent to all images at once


def _for_all(channels: DataFrame, maps: DataFrame) -> DataFrame:
    """Every place of a map for every channel of every image: what the result has rows for.

    The map goes in parts of bounded size, and images are dealt to them by the part's number.
    """
    parts = max(1, -(-maps.count() // PART))
    part = F.pmod(F.xxhash64("y", "x"), F.lit(parts)).cast("int")
    asking = channels.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    mapped = maps.withColumn("_part", part)
    return asking.join(F.broadcast(mapped) if parts == 1 else mapped, "_part").drop("_part")


def invert3(m: list[list[float]]) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    if abs(det) < 1e-12:
        raise MatrixError("the matrix has no inverse")
    cof = [[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]]
    return [[x / det for x in row] for row in cof]


def places(spark, rows: int, cols: int) -> DataFrame:
    """(y, x) of a frame, made by Spark."""
    one = grid(spark.range(1).withColumnRenamed("id", "img"), Shape(rows, cols))
    return one.select("y", "x")


def warp_map(spark, m: list[list[float]], rows: int, cols: int) -> DataFrame:
    """Where each target place comes from under the 3 x 3 matrix that takes sources to targets."""
    n = invert3(m)
    x, y = F.col("x"), F.col("y")
    line = lambda r: x * float(r[0]) + y * float(r[1]) + float(r[2])
    w = line(n[2])
    near = F.abs(w) < 1e-12
    safe = F.when(near, 1.0).otherwise(w)
    return places(spark, rows, cols).select("y", "x", F.when(near, -1.0).otherwise(line(n[0]) / safe).alias("map_x"), F.when(near, -1.0).otherwise(line(n[1]) / safe).alias("map_y"))


def warp_perspective(px: DataFrame, shape: Shape, m: list[list[float]], rows: int, cols: int, interpolation: str = "linear", border: Border = Border.CONSTANT, value=0.0, depth: str = "f64") -> DataFrame:
    return remap(px, shape, warp_map(px.sparkSession, m, rows, cols), interpolation, border, value, depth)


def undistort_map(spark, camera: list[list[float]], distortion: list[float], new_camera: list[list[float]], rows: int, cols: int, r: list[list[float]] | None = None) -> DataFrame:
    """(y, x, map_x, map_y) from radial (k1 to k6) and tangential (p1, p2) lens distortion.

    ``distortion`` is k1, k2, p1, p2[, k3[, k4, k5, k6]].
    """
    k1, k2, p1, p2, k3, k4, k5, k6 = [*distortion, *[0.0] * (8 - len(distortion))]
    x0 = (F.col("x") - new_camera[0][2]) / new_camera[0][0]
    y0 = (F.col("y") - new_camera[1][2]) / new_camera[1][1]
    if r is not None:  # the inverse of a rotation is its transpose
        back = [[r[j][i] for j in range(3)] for i in range(3)]
        px, py, pw = (x0 * b[0] + y0 * b[1] + b[2] for b in back)
        x0, y0 = px / pw, py / pw
    s = places(spark, rows, cols).select("y", "x", x0.alias("_x"), y0.alias("_y"))
    x, y = F.col("_x"), F.col("_y")
    r2 = x * x + y * y
    radial = (1 + ((r2 * k3 + k2) * r2 + k1) * r2) / (1 + ((r2 * k6 + k5) * r2 + k4) * r2)
    xd = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    yd = y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return s.select("y", "x", (xd * camera[0][0] + camera[0][2]).alias("map_x"), (yd * camera[1][1] + camera[1][2]).alias("map_y"))


GRAY = {"rgb": (0.299, 0.587, 0.114), "bgr": (0.114, 0.587, 0.299), "rgba": (0.299, 0.587, 0.114, 0.0), "bgra": (0.114, 0.587, 0.299, 0.0)}


def to_gray(px: DataFrame, order: str = "rgb") -> DataFrame:
    """Weighted sum of the colour channels, rounded half away from zero; alpha doesn't count."""
    w = scalar(list(GRAY[order]), F.col("c"))
    out = px.groupBy("img", "y", "x").agg(F.sum(val() * w).alias("v"))
    return out.select("img", "y", "x", F.lit(0).alias("c"), F.floor(F.round(val(), 9) + 0.5).cast("double").alias("v"))


def from_gray(px: DataFrame, order: str = "rgb") -> DataFrame:
    """The grey value in every colour channel, and 255 in alpha."""
    n = len(order)
    wide = px.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return wide.select(*KEYS, F.when(F.col("c") == 3, 255.0).otherwise(val()).alias("v"))


def cvt_color(px: DataFrame, code: str) -> DataFrame:
    """Codes like rgb2gray, bgra2gray, gray2bgr, gray2rgba."""
    a, _, b = code.partition("2")
    if b == "gray" and a in GRAY:
        return to_gray(px, a)
    if a == "gray" and b in GRAY:
        return from_gray(px, b)
    raise MatrixError(f"no colour conversion {code}")

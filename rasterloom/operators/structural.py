"""Moving pixels: every operator is a projection of the place, a filter on channels, or a union."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.local import small_table
from ..sources.pixels import KEYS
from ..types import InvalidDimensions, Shape, scalar




def at_y() -> Column:
    return F.col("y")


def at_x() -> Column:
    return F.col("x")


def at_c() -> Column:
    return F.col("c")


def moved(px: DataFrame, y: Column | None = None, x: Column | None = None, c: Column | None = None) -> DataFrame:
    """Pixels with another y, x or c."""
    y, x, c = (at_y() if y is None else y), (at_x() if x is None else x), (at_c() if c is None else c)
    return px.select("img", y.cast("int").alias("y"), x.cast("int").alias("x"), c.cast("int").alias("c"), "v")


def flip(px: DataFrame, shape: Shape, code: int) -> DataFrame:
    """Code 0: top to bottom; above: left to right; below: both."""
    return moved(px, shape.rows - 1 - at_y() if code <= 0 else at_y(), shape.cols - 1 - at_x() if code != 0 else at_x())


def flip_nd(px: DataFrame, shape: Shape, axis: int) -> DataFrame:
    return flip(px, shape, axis if axis in (0, 1) else -1)


def transpose(px: DataFrame) -> DataFrame:
    return moved(px, at_x(), at_y())


def rotate(px: DataFrame, shape: Shape, code: int) -> DataFrame:
    """Clockwise by 90 (code 0), 180 (1) or 270 (2) degrees."""
    if code == 1:
        return flip(px, shape, -1)
    return moved(px, at_x(), shape.rows - 1 - at_y()) if code == 0 else moved(px, shape.cols - 1 - at_x(), at_y())


def split(px: DataFrame, channels: int) -> list[DataFrame]:
    return [extract_channel(px, k) for k in range(channels)]


def merge(parts: list[DataFrame]) -> DataFrame:
    return fold(DataFrame.unionByName, [moved(p, c=F.lit(k)) for k, p in enumerate(parts)])


def mix_channels(sources: list[tuple[DataFrame, int]], targets: list[int], pairs: list[tuple[int, int]]) -> list[DataFrame]:
    """Copy channels: numbers run on across the sources (table, channels) and the targets (channels)."""
    every = fold(DataFrame.unionByName, [moved(p, c=at_c() + sum(n for _, n in sources[:k])) for k, (p, _) in enumerate(sources)])
    table = F.broadcast(small_table(every.sparkSession, pairs, "_from int, _to int"))
    mixed = every.join(table, every["c"] == table["_from"]).select("img", "y", "x", F.col("_to").alias("c"), "v")
    starts = [sum(targets[:k]) for k in range(len(targets))]
    return [moved(mixed.where((at_c() >= s) & (at_c() < s + n)), c=at_c() - s) for s, n in zip(starts, targets)]


def extract_channel(px: DataFrame, k: int) -> DataFrame:
    return moved(px.where(at_c() == k), c=F.lit(0))


def insert_channel(px: DataFrame, channel: DataFrame, k: int) -> DataFrame:
    return px.where(at_c() != k).select(*KEYS, "v").unionByName(moved(channel, c=F.lit(k)))


def copy_make_border(px: DataFrame, shape: Shape, top: int, bottom: int, left: int, right: int, reflect: bool = False, value=0.0) -> DataFrame:
    """Pad with a constant, or with the image mirrored at its edge."""
    inner = moved(px, at_y() + top, at_x() + left)
    if reflect:
        from ..plans.taps import border_index
        from ..types import Border

        def table(n, before, after, source, target):
            rows = [(border_index(i - before, n, Border.REFLECT), i) for i in range(n + before + after)]
            return F.broadcast(small_table(px.sparkSession, rows, f"{source} int, {target} int"))

        out = px.join(table(shape.rows, top, bottom, "y", "_ty"), "y").join(table(shape.cols, left, right, "x", "_tx"), "x")
        return out.select("img", F.col("_ty").alias("y"), F.col("_tx").alias("x"), "c", "v")
    rows, cols = shape.rows + top + bottom, shape.cols + left + right
    frame = [(y, x) for y in range(rows) for x in range(cols) if not (top <= y < top + shape.rows and left <= x < left + shape.cols)]
    if not frame:
        return inner
    ring = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in frame]) if len(frame) <= 64 else None
    images = px.select("img", "c").distinct()
    if ring is not None:
        border = images.withColumn("_p", F.explode(ring)).select("img", F.col("_p.y").alias("y"), F.col("_p.x").alias("x"), "c")
    else:
        places = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
        border = places.where(~(at_y().between(top, top + shape.rows - 1) & at_x().between(left, left + shape.cols - 1)))
    return inner.unionByName(border.select("img", "y", "x", "c", scalar(value, at_c()).alias("v")))


def repeat(px: DataFrame, shape: Shape, ny: int, nx: int) -> DataFrame:
    """Tile each image ny times down and nx times across."""
    tiles = px.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    return moved(tiles, at_y() + F.col("_i") * shape.rows, at_x() + F.col("_j") * shape.cols)


def reshape(px: DataFrame, shape: Shape, channels: int = 0, rows: int = 0) -> DataFrame:
    """The same elements in row-major order with other channels or rows (0 keeps them)."""
    channels, rows = channels or shape.channels, rows or shape.rows
    size = shape.rows * shape.cols * shape.channels
    if size % (rows * channels):
        raise InvalidDimensions("the elements don't fill that shape")
    cols = size // (rows * channels)
    at = (at_y() * shape.cols + at_x()) * shape.channels + at_c()
    return moved(px, F.floor(at / (cols * channels)), F.floor(at / channels) % cols, at % channels)


def hconcat(parts: list[tuple[DataFrame, Shape]]) -> DataFrame:
    if len({(s.rows, s.channels) for _, s in parts}) > 1:
        raise InvalidDimensions("hconcat needs equal rows and channels")
    return fold(DataFrame.unionByName, [moved(p, x=at_x() + sum(s.cols for _, s in parts[:k])) for k, (p, _) in enumerate(parts)])


def vconcat(parts: list[tuple[DataFrame, Shape]]) -> DataFrame:
    if len({(s.cols, s.channels) for _, s in parts}) > 1:
        raise InvalidDimensions("vconcat needs equal columns and channels")
    return fold(DataFrame.unionByName, [moved(p, y=at_y() + sum(s.rows for _, s in parts[:k])) for k, (p, _) in enumerate(parts)])


def set_identity(px: DataFrame, s=1.0) -> DataFrame:
    return px.withColumn("v", F.when(at_y() == at_x(), scalar(s, at_c())).otherwise(0.0))

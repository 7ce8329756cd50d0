"""Aggregations and statistics: partial and final hash aggregation by image, channel, row or column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.local import small_table
from ..sources.pixels import KEYS
from ..types import IncompatibleChannels, NotSupported, truncate_cast


def val() -> Column:
    return F.col("v")


def first_channels() -> Column:
    """Per-channel scalars have four channels."""
    return F.col("c") < 4



def total(px: DataFrame) -> DataFrame:
    return px.where(first_channels()).groupBy("img", "c").agg(F.sum("v").alias("sum"))


def mean(px: DataFrame) -> DataFrame:
    return px.where(first_channels()).groupBy("img", "c").agg(F.avg("v").alias("mean"))


def mean_std_dev(px: DataFrame) -> DataFrame:
    return px.where(first_channels()).groupBy("img", "c").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_dev"))


def _norm(kind: str) -> Column:
    forms = {"inf": F.max(F.abs(val())), "l1": F.sum(F.abs(val())), "l2": F.sqrt(F.sum(val() * val()))}
    if kind not in forms:
        raise NotSupported(f"norm {kind}")
    return forms[kind]


def masked(px: DataFrame, mask: DataFrame | None) -> DataFrame:
    """Pixels where the one-channel mask isn't 0."""
    if mask is None:
        return px
    return px.join(mask.where("v <> 0").select("img", "y", "x"), ["img", "y", "x"], "left_semi")


def norm(px: DataFrame, kind: str = "l2", mask: DataFrame | None = None) -> DataFrame:
    """inf, l1 or l2 over all channels."""
    return masked(px, mask).groupBy("img").agg(_norm(kind).alias("norm"))


def normalize(px: DataFrame, alpha: float = 1.0, beta: float = 0.0, kind: str = "l2", mask: DataFrame | None = None, depth: str = "f64") -> DataFrame:
    """minmax: to [alpha, beta]; otherwise to the norm alpha. What the mask excludes stays."""
    inside = masked(px, mask)
    if kind == "minmax":
        stats = inside.groupBy("img").agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
        low, high = min(alpha, beta), max(alpha, beta)
        span = F.col("_b") - F.col("_a")
        scale = F.when(span == 0, 0.0).otherwise((high - low) / F.when(span == 0, 1.0).otherwise(span))
        out = (val() - F.col("_a")) * scale + low
    else:
        stats = inside.groupBy("img").agg(_norm(kind).alias("_n"))
        out = F.when(F.col("_n") == 0, 0.0).otherwise(val() * alpha / F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_n")))
    scaled = truncate_cast(out, depth)
    if mask is None:
        return px.join(stats, "img").select(*KEYS, scaled.alias("v"))
    m = mask.where("c = 0").select("img", "y", "x", F.col("v").alias("_m"))
    return px.join(stats, "img", "left").join(m, ["img", "y", "x"], "left").select(*KEYS, F.when(F.coalesce("_m", F.lit(0.0)) != 0, scaled).otherwise(val()).alias("v"))


REDUCERS = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}


def reduce(px: DataFrame, axis: int, how: str) -> DataFrame:
    """Axis 0 gives one row, axis 1 one column, for each channel."""
    keep, gone = ("x", "y") if axis == 0 else ("y", "x")
    out = px.groupBy("img", keep, "c").agg(REDUCERS[how]("v").alias("v"))
    return out.withColumn(gone, F.lit(0)).select(*KEYS, F.col("v").cast("double").alias("v"))


def reduce_both(px: DataFrame, how: str) -> DataFrame:
    """Both axes in one aggregation by grouping sets; the reduced axis is null."""
    sets = px.groupingSets([["img", "y", "c"], ["img", "x", "c"]], "img", "y", "x", "c")
    return sets.agg(REDUCERS[how]("v").alias("v"))


def one_channel(px: DataFrame) -> DataFrame:
    if px.agg(F.max("c")).first()[0] not in (None, 0):
        raise IncompatibleChannels("one channel is needed")
    return px


def count_non_zero(px: DataFrame) -> DataFrame:
    return px.where("c = 0").groupBy("img").agg(F.count_if(val() != 0).alias("n"))


def has_no_zero(px: DataFrame) -> DataFrame:
    return px.groupBy("img").agg(F.bool_and(val() != 0).alias("full"))


def check_range(px: DataFrame, low: float, high: float) -> DataFrame:
    return px.groupBy("img").agg(F.bool_and((val() >= low) & (val() <= high)).alias("inside"))


def min_max_loc(px: DataFrame) -> DataFrame:
    """Smallest and largest values and their first places in row-major order."""
    place = F.struct("y", "x", "c")
    return px.groupBy("img").agg(
        F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.min(F.struct("v", "y", "x", "c")).alias("_lo"), F.max(F.struct(val(), -F.col("y"), -F.col("x"), -F.col("c"))).alias("_hi"), F.count(place).alias("_n")
    ).select("img", "min_v", "max_v", F.col("_lo.x").alias("min_x"), F.col("_lo.y").alias("min_y"), (-F.col("_hi.col3")).alias("max_x"), (-F.col("_hi.col2")).alias("max_y"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select(*KEYS, F.col("v").alias("_w"))
    return a.join(other, list(KEYS)).groupBy("img").agg(F.sum(val() * F.col("_w")).alias("dot"))


def trace(px: DataFrame) -> DataFrame:
    return px.where((F.col("x") == F.col("y")) & first_channels()).groupBy("img", "c").agg(F.sum("v").alias("trace"))


def psnr(a: DataFrame, b: DataFrame) -> DataFrame:
    """10 log10(255^2 / mean squared error); infinity for equal images."""
    other = b.select(*KEYS, F.col("v").alias("_w"))
    mse = a.join(other, list(KEYS)).groupBy("img").agg(F.avg((val() - F.col("_w")) * (val() - F.col("_w"))).alias("_e"))
    return mse.select("img", F.when(F.col("_e") == 0, float("inf")).otherwise(10 * F.log10(255.0**2 / F.when(F.col("_e") == 0, 1.0).otherwise(F.col("_e")))).alias("psnr"))


def mahalanobis(a: DataFrame, b: DataFrame, inverse_covariance: list[list[float]]) -> DataFrame:
    """sqrt(d' M d) of the column vectors a - b, with M as a table of its cells."""
    cells = [(i, j, float(w)) for i, row in enumerate(inverse_covariance) for j, w in enumerate(row)]
    m = F.broadcast(small_table(a.sparkSession, cells, "i int, j int, w double"))
    d = a.join(b.select(*KEYS, F.col("v").alias("_w")), list(KEYS)).select("img", F.col("y").alias("i"), (val() - F.col("_w")).alias("d"))
    left = d.join(m, "i").groupBy("img", "j").agg(F.sum(F.col("d") * F.col("w")).alias("_s"))
    return left.join(d.withColumnRenamed("i", "j"), ["img", "j"]).groupBy("img").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("_s") * F.col("d")))).alias("distance"))


def sort(px: DataFrame, by: str = "row", descending: bool = False) -> DataFrame:
    """Each row (or column) of a one-channel matrix in order."""
    key, moving = ("y", "x") if by == "row" else ("x", "y")
    w = Window.partitionBy("img", key, "c").orderBy(val().desc() if descending else val().asc(), F.col(moving))
    return px.withColumn("_n", F.row_number().over(w) - 1).drop(moving).withColumnRenamed("_n", moving).select(*KEYS, "v")


def sort_idx(px: DataFrame, by: str = "row", descending: bool = False) -> DataFrame:
    """Places of the sorted elements; descending order is the ascending one reversed, ties too."""
    key, moving = ("y", "x") if by == "row" else ("x", "y")
    order = (val().desc(), F.col(moving).desc()) if descending else (val().asc(), F.col(moving).asc())
    w = Window.partitionBy("img", key, "c").orderBy(*order)
    return px.select("img", key, "c", (F.row_number().over(w) - 1).alias("_n"), F.col(moving).cast("double").alias("v")).withColumnRenamed("_n", moving).select(*KEYS, "v")


def sort_by_response(keypoints: DataFrame, descending: bool = True, order: str = "ord") -> DataFrame:
    """Keypoint rows (img, ``order``, response, ...) with their rank in ``position``; ties keep their order."""
    r = F.col("response").desc() if descending else F.col("response").asc()
    return keypoints.withColumn("position", F.row_number().over(Window.partitionBy("img").orderBy(r, order)) - 1)


def retain_best(keypoints: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The n keypoints of each image with the highest response."""
    return sort_by_response(keypoints, True, order).where(F.col("position") < n)

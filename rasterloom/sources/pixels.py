"""Making pixel tables, and going between them and dense rows (one row an image, with an array of elements)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import DEPTHS, InvalidDimensions, Shape, scalar

KEYS = ("img", "y", "x", "c")


def from_arrays(df: DataFrame, img: str, data: str, cols: int, channels: int = 1) -> DataFrame:
    """Row-major, channel-interleaved arrays as pixels."""
    at = F.col("_pos")
    return df.select(F.col(img).cast("long").alias("img"), F.posexplode(data).alias("_pos", "_v")).select(
        "img",
        F.floor(at / (cols * channels)).cast("int").alias("y"),
        (F.floor(at / channels) % cols).cast("int").alias("x"),
        (at % channels).cast("int").alias("c"),
        F.col("_v").cast("double").alias("v"),
    )


def to_dense(px: DataFrame, shape: Shape, depth: str = "f64") -> DataFrame:
    """One row an image: img, rows, cols, channels, depth, data."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "c", "v")))
    return px.groupBy("img").agg(F.transform(ordered, lambda p: p["v"]).alias("data")).select(
        "img", F.lit(shape.rows).alias("rows"), F.lit(shape.cols).alias("cols"), F.lit(shape.channels).alias("channels"), F.lit(depth).alias("depth"), "data"
    )


def to_pixels(dense: DataFrame) -> DataFrame:
    """Dense rows as pixels."""
    at = F.col("_pos")
    return dense.select("img", "cols", "channels", F.posexplode("data").alias("_pos", "v")).select(
        "img",
        F.floor(at / (F.col("cols") * F.col("channels"))).cast("int").alias("y"),
        (F.floor(at / F.col("channels")) % F.col("cols")).cast("int").alias("x"),
        (at % F.col("channels")).cast("int").alias("c"),
        F.col("v").cast("double").alias("v"),
    )


def grid(images: DataFrame, shape: Shape, value: Column | float = 0.0) -> DataFrame:
    """A pixel for each place of each row of ``images`` (a column img); ``value`` may use y, x and c."""
    places = images.select("img").withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(shape.rows * shape.cols * shape.channels - 1))))
    px = places.select(
        "img",
        F.floor(F.col("_p") / (shape.cols * shape.channels)).cast("int").alias("y"),
        (F.floor(F.col("_p") / shape.channels) % shape.cols).cast("int").alias("x"),
        (F.col("_p") % shape.channels).cast("int").alias("c"),
    )
    return px.withColumn("v", value.cast("double") if isinstance(value, Column) else F.lit(float(value)))


def one_image(spark: SparkSession, img: int = 0) -> DataFrame:
    return spark.range(img, img + 1).withColumnRenamed("id", "img")


def zeros(images: DataFrame, shape: Shape) -> DataFrame:
    return grid(images, shape, 0.0)


def ones(images: DataFrame, shape: Shape) -> DataFrame:
    return grid(images, shape, 1.0)


def eye(images: DataFrame, shape: Shape) -> DataFrame:
    return grid(images, shape, F.when(F.col("y") == F.col("x"), 1.0).otherwise(0.0))


def full(images: DataFrame, shape: Shape, values: float | list[float]) -> DataFrame:
    return grid(images, shape, scalar(values, F.col("c")))


def diag(df: DataFrame, img: str, data: str, size: int) -> DataFrame:
    """Square matrices with the arrays on their diagonals."""
    values = df.select(F.col(img).cast("long").alias("img"), F.posexplode(data).alias("_d", "_v"))
    places = values.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return places.select("img", F.col("_d").cast("int").alias("y"), "x", F.lit(0).alias("c"), F.when(F.col("_d") == F.col("x"), F.col("_v").cast("double")).otherwise(0.0).alias("v"))


def from_function(images: DataFrame, shape: Shape, formula: str) -> DataFrame:
    """Pixels by a SQL formula over y, x, c and img."""
    return grid(images, shape, F.expr(formula))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files as Spark's image source decodes them, as pixels (channels in the file's BGR order)."""
    rows = spark.read.format("image").load(path).select("image.*").where("nChannels > 0")
    flat = rows.select(
        F.xxhash64("origin").alias("img"), "origin", "height", "width", "nChannels", F.expr("transform(sequence(1, length(data)), i -> conv(hex(substring(data, i, 1)), 16, 10))").alias("data")
    )
    at = F.col("_pos")
    return flat.select("img", "width", "nChannels", F.posexplode("data").alias("_pos", "_v")).select(
        "img",
        F.floor(at / (F.col("width") * F.col("nChannels"))).cast("int").alias("y"),
        (F.floor(at / F.col("nChannels")) % F.col("width")).cast("int").alias("x"),
        (at % F.col("nChannels")).cast("int").alias("c"),
        F.col("_v").cast("double").alias("v"),
    )


def shape_of(px: DataFrame) -> DataFrame:
    """(img, rows, cols, channels) of each image."""
    return px.groupBy("img").agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("cols"), (F.max("c") + 1).alias("channels"))


def same_shape(a: DataFrame, b: DataFrame) -> None:
    """Raise unless the two tables hold the same images in the same shapes."""
    odd = shape_of(a).join(shape_of(b).withColumnsRenamed({"rows": "rows2", "cols": "cols2", "channels": "channels2"}), "img", "full_outer")
    if not odd.where("not (rows <=> rows2 and cols <=> cols2 and channels <=> channels2)").isEmpty():
        raise InvalidDimensions("the images differ in shape")


def depth_name(depth: str) -> str:
    if depth not in DEPTHS:
        raise InvalidDimensions(f"no depth {depth}")
    return depth

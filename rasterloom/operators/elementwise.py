"""Element-wise arithmetic, comparison, masks and casts: projections over pixels, or over a join of two images."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.local import small_table
from ..sources.pixels import KEYS
from ..types import DEPTHS, MatrixError, clamp, is_float, saturate_cast, scalar, strict_cast, truncate_cast


def val() -> Column:
    return F.col("v")


def at_c() -> Column:
    return F.col("c")



def mapped(px: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return px.withColumn("v", f(val()).cast("double"))


def paired(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """One join on the place; both sides are hash partitioned alike, so a pre-partitioned table isn't moved."""
    other = b.select(*KEYS, F.col("v").alias("_w"))
    return a.join(other, list(KEYS)).select(*KEYS, f(val(), F.col("_w")).cast("double").alias("v"))


def _bits(v: Column, depth: str) -> Column:
    return v.cast("long") if not is_float(depth) else F.raise_error(F.lit("bitwise operators need integers")).cast("long")


def add(a: DataFrame, b: DataFrame, depth: str = "u8") -> DataFrame:
    return paired(a, b, lambda x, y: clamp(x + y, depth))


def subtract(a: DataFrame, b: DataFrame, depth: str = "u8") -> DataFrame:
    return paired(a, b, lambda x, y: clamp(x - y, depth))


def multiply(a: DataFrame, b: DataFrame, depth: str = "u8") -> DataFrame:
    return paired(a, b, lambda x, y: clamp(x * y, depth))


def divide(a: DataFrame, b: DataFrame, depth: str = "u8") -> DataFrame:
    """A divisor of 0 gives 0; integers are cut towards zero."""
    return paired(a, b, lambda x, y: F.when(y == 0, 0.0).otherwise(truncate_cast(x / F.when(y == 0, 1.0).otherwise(y), depth)))


def add_scalar(px: DataFrame, s, depth: str = "u8") -> DataFrame:
    return mapped(px, lambda v: clamp(v + truncate_cast(scalar(s, at_c()), depth), depth))


def subtract_scalar(px: DataFrame, s, depth: str = "u8") -> DataFrame:
    return mapped(px, lambda v: clamp(v - truncate_cast(scalar(s, at_c()), depth), depth))


def multiply_scalar(px: DataFrame, s, depth: str = "u8") -> DataFrame:
    return mapped(px, lambda v: truncate_cast(v * scalar(s, at_c()), depth))


def divide_scalar(px: DataFrame, s, depth: str = "u8") -> DataFrame:
    d = scalar(s, at_c())
    return mapped(px, lambda v: F.when(d == 0, 0.0).otherwise(truncate_cast(v / F.when(d == 0, 1.0).otherwise(d), depth)))


def add_weighted(a: DataFrame, alpha: float, b: DataFrame, beta: float, gamma: float, depth: str = "u8") -> DataFrame:
    return paired(a, b, lambda x, y: truncate_cast(x * alpha + y * beta + gamma, depth))


def bitwise_and(a: DataFrame, b: DataFrame, depth: str = "u8") -> DataFrame:
    return paired(a, b, lambda x, y: _bits(x, depth).bitwiseAND(_bits(y, depth)))


def bitwise_or(a: DataFrame, b: DataFrame, depth: str = "u8") -> DataFrame:
    return paired(a, b, lambda x, y: _bits(x, depth).bitwiseOR(_bits(y, depth)))


def bitwise_xor(a: DataFrame, b: DataFrame, depth: str = "u8") -> DataFrame:
    return paired(a, b, lambda x, y: _bits(x, depth).bitwiseXOR(_bits(y, depth)))


def bitwise_and_scalar(px: DataFrame, s, depth: str = "u8") -> DataFrame:
    return mapped(px, lambda v: _bits(v, depth).bitwiseAND(scalar(s, at_c()).cast("long")))


def bitwise_or_scalar(px: DataFrame, s, depth: str = "u8") -> DataFrame:
    return mapped(px, lambda v: _bits(v, depth).bitwiseOR(scalar(s, at_c()).cast("long")))


def bitwise_xor_scalar(px: DataFrame, s, depth: str = "u8") -> DataFrame:
    return mapped(px, lambda v: _bits(v, depth).bitwiseXOR(scalar(s, at_c()).cast("long")))


def bitwise_not(px: DataFrame, depth: str = "u8") -> DataFrame:
    low, high = DEPTHS[depth][:2]
    return mapped(px, lambda v: F.lit(float(high)) - v if low == 0 else -_bits(v, depth) - 1)


def minimum(a: DataFrame, b: DataFrame) -> DataFrame:
    return paired(a, b, lambda x, y: F.least(x, y))


def maximum(a: DataFrame, b: DataFrame) -> DataFrame:
    return paired(a, b, lambda x, y: F.greatest(x, y))


def min_scalar(px: DataFrame, s) -> DataFrame:
    return mapped(px, lambda v: F.least(v, scalar(s, at_c())))


def max_scalar(px: DataFrame, s) -> DataFrame:
    return mapped(px, lambda v: F.greatest(v, scalar(s, at_c())))


def abs_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return paired(a, b, lambda x, y: F.abs(x - y))


absdiff = abs_diff


def abs_diff_scalar(px: DataFrame, s) -> DataFrame:
    return mapped(px, lambda v: F.abs(v - scalar(s, at_c())))


def sqrt(px: DataFrame, depth: str = "f64") -> DataFrame:
    return mapped(px, lambda v: truncate_cast(F.sqrt(v), depth))


def exp(px: DataFrame, depth: str = "f64") -> DataFrame:
    return mapped(px, lambda v: truncate_cast(F.exp(v), depth))


def log(px: DataFrame, depth: str = "f64") -> DataFrame:
    """Natural logarithm; that of 0 is -infinity and of negative numbers NaN (0 in integer depths)."""
    safe = lambda v: F.when(v == 0, float("-inf")).when(v < 0, float("nan")).otherwise(F.ln(F.when(v > 0, v).otherwise(1.0)))
    return mapped(px, lambda v: truncate_cast(safe(v), depth))


def power(px: DataFrame, p: float, depth: str = "f64") -> DataFrame:
    return mapped(px, lambda v: truncate_cast(F.pow(v, F.lit(p)), depth))


def convert_scale_abs(px: DataFrame, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """|v * alpha + beta|, at most 255, rounded half away from zero."""
    return mapped(px, lambda v: F.floor(F.least(F.lit(255.0), F.abs(v * alpha + beta)) + 0.5))


def magnitude(x: DataFrame, y: DataFrame) -> DataFrame:
    return paired(x, y, lambda a, b: F.sqrt(a * a + b * b))


def _angle(a: Column, b: Column, degrees: bool) -> Column:
    t = F.atan2(b, a)
    t = F.when(t < 0, t + 2 * math.pi).otherwise(t)
    return t * (180 / math.pi) if degrees else t


def phase(x: DataFrame, y: DataFrame, degrees: bool = False) -> DataFrame:
    return paired(x, y, lambda a, b: _angle(a, b, degrees))


def cart_to_polar(x: DataFrame, y: DataFrame, degrees: bool = False) -> DataFrame:
    """Pixels with magnitude and angle in place of v."""
    other = y.select(*KEYS, F.col("v").alias("_w"))
    return x.join(other, list(KEYS)).select(*KEYS, F.sqrt(val() * val() + F.col("_w") * F.col("_w")).alias("magnitude"), _angle(val(), F.col("_w"), degrees).alias("angle"))


def polar_to_cart(magnitude: DataFrame, angle: DataFrame, degrees: bool = False) -> DataFrame:
    """Pixels with cart_x and cart_y in place of v."""
    other = angle.select(*KEYS, (F.col("v") * (math.pi / 180 if degrees else 1.0)).alias("_t"))
    return magnitude.join(other, list(KEYS)).select(*KEYS, (val() * F.cos("_t")).alias("cart_x"), (val() * F.sin("_t")).alias("cart_y"))


def lut(px: DataFrame, table: list[float] | list[list[float]]) -> DataFrame:
    """Replace 8-bit values by a table of 256 entries, or by one table for each channel."""
    tables = table if isinstance(table[0], list) else [table]
    if any(len(t) != 256 for t in tables):
        raise MatrixError("a lookup table has 256 entries")
    rows = [(k, i, float(t[i])) for k, t in enumerate(tables) for i in range(256)]
    look = F.broadcast(small_table(px.sparkSession, rows, "_k int, _i int, _o double"))
    key = at_c() if len(tables) > 1 else F.lit(0)
    return px.join(look, (val().cast("int") == look["_i"]) & (key == look["_k"])).select(*KEYS, F.col("_o").alias("v"))


def transform(px: DataFrame, m: list[list[float]], depth: str = "f64") -> DataFrame:
    """Channels times a matrix: rows are output channels; one more column than channels is an offset."""
    rows = [(i, j, float(w)) for i, line in enumerate(m) for j, w in enumerate(line)]
    taps = F.broadcast(small_table(px.sparkSession, rows, "_row int, _in int, _m double"))
    joined = px.join(taps, px["c"] == taps["_in"]).groupBy("img", "y", "x", F.col("_row").alias("c")).agg(F.sum(val() * F.col("_m")).alias("v"), F.count("*").alias("_n"))
    offset = F.lit(0.0)
    for i, line in enumerate(m):
        offset = F.when((at_c() == i) & (F.col("_n") < len(line)), float(line[-1])).otherwise(offset)
    return joined.select(*KEYS, truncate_cast(val() + offset, depth).alias("v"))


def perspective_transform(points: DataFrame, m: list[list[float]], columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Points (in ``columns``) times a homogeneous matrix, over w; a w of nearly 0 gives zeros."""
    n = len(columns)
    line = lambda r: sum((F.col(c).cast("double") * float(r[k]) for k, c in enumerate(columns)), F.lit(float(r[n])))
    w = line(m[n])
    near = F.abs(w) <= 2.220446049250313e-16
    return points.withColumns({c: F.when(near, 0.0).otherwise(line(m[k]) / F.when(near, 1.0).otherwise(w)) for k, c in enumerate(columns)})


def convert_to(px: DataFrame, depth: str) -> DataFrame:
    """Towards zero; values that don't fit raise."""
    return mapped(px, lambda v: strict_cast(v, depth))


def saturating(px: DataFrame, depth: str) -> DataFrame:
    return mapped(px, lambda v: saturate_cast(v, depth))


COMPARE = {
    "eq": lambda a, b: a == b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "ne": lambda a, b: a != b,
}


def _mask(op: str, a: Column, b: Column) -> Column:
    nan = F.isnan(a) | F.isnan(b)  # Spark orders NaN above all; a comparison with NaN is false, except for ne
    return F.when(nan, 255.0 if op == "ne" else 0.0).when(COMPARE[op](a, b), 255.0).otherwise(0.0)


def compare(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    return paired(a, b, lambda x, y: _mask(op, x, y))


def compare_scalar(px: DataFrame, s, op: str) -> DataFrame:
    return mapped(px, lambda v: _mask(op, v, scalar(s, at_c())))


def _all_channels(inside: DataFrame) -> DataFrame:
    return inside.groupBy("img", "y", "x").agg(F.bool_and("_in").alias("_in")).select("img", "y", "x", F.lit(0).alias("c"), F.when(F.col("_in"), 255.0).otherwise(0.0).alias("v"))


def in_range(px: DataFrame, lower: DataFrame, upper: DataFrame) -> DataFrame:
    """255 where every channel is within its bounds (inclusive)."""
    low, high = lower.select(*KEYS, F.col("v").alias("_lo")), upper.select(*KEYS, F.col("v").alias("_hi"))
    return _all_channels(px.join(low, list(KEYS)).join(high, list(KEYS)).withColumn("_in", (val() >= F.col("_lo")) & (val() <= F.col("_hi"))))


def in_range_scalar(px: DataFrame, lower: list[float], upper: list[float]) -> DataFrame:
    return _all_channels(px.withColumn("_in", (val() >= scalar(list(lower), at_c())) & (val() <= scalar(list(upper), at_c()))))


def set_to(px: DataFrame, s) -> DataFrame:
    return mapped(px, lambda v: scalar(s, at_c()))


def set_to_masked(px: DataFrame, s, mask: DataFrame) -> DataFrame:
    """The scalar where the (one-channel) mask isn't 0."""
    m = mask.where("c = 0").select("img", "y", "x", F.col("v").alias("_m"))
    return px.join(m, ["img", "y", "x"], "left").select(*KEYS, F.when(F.coalesce("_m", F.lit(0.0)) != 0, scalar(s, at_c())).otherwise(val()).alias("v"))


def threshold(px: DataFrame, thresh: float, maxval: float, kind: str = "binary", depth: str = "u8") -> DataFrame:
    """kinds: binary, binary_inv, trunc, tozero, tozero_inv; above means strictly greater."""
    above = val() > thresh
    top, cut = truncate_cast(F.lit(float(maxval)), depth), truncate_cast(F.lit(float(thresh)), depth)
    forms = {
        "binary": F.when(above, top).otherwise(0.0),
        "binary_inv": F.when(above, 0.0).otherwise(top),
        "trunc": F.when(above, cut).otherwise(val()),
        "tozero": F.when(above, val()).otherwise(0.0),
        "tozero_inv": F.when(above, 0.0).otherwise(val()),
    }
    if kind not in forms:
        raise MatrixError(f"no threshold {kind}")
    return px.withColumn("v", forms[kind].cast("double"))


def get(px: DataFrame, y: int, x: int, c: int = 0) -> DataFrame:
    """(img, v) of one place; images without it are left out."""
    return px.where((F.col("y") == y) & (F.col("x") == x) & (at_c() == c)).select("img", "v")

"""Depths, casts, options and errors shared by all operators."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

PIXEL_SCHEMA = "img long, y int, x int, c int, v double"
KEYPOINT = "struct<pt:struct<x:float,y:float>,size:float,angle:float,response:float,octave:int,class_id:int>"
MATCH = "struct<query_idx:long,train_idx:long,train_img_idx:int,distance:double>"

#: Value range, number of the depth in a packed matrix type, and bytes of an element.
DEPTHS = {
    "u8": (0, 255, 0, 1),
    "i8": (-128, 127, 1, 1),
    "u16": (0, 65535, 2, 2),
    "i16": (-32768, 32767, 3, 2),
    "i32": (-(1 << 31), (1 << 31) - 1, 4, 4),
    "f32": (None, None, 5, 4),
    "f64": (None, None, 6, 8),
}


class MatrixError(ValueError):
    """An operator can't work on these inputs."""


class InvalidDimensions(MatrixError):
    pass


class IncompatibleChannels(MatrixError):
    pass


class NotSupported(MatrixError):
    pass


class Border(IntEnum):
    CONSTANT = 0
    REPLICATE = 1
    REFLECT = 2
    WRAP = 3
    REFLECT_101 = 4
    TRANSPARENT = 5
    ISOLATED = 16


@dataclass(frozen=True)
class Criteria:
    """When an iteration stops: after ``max_count`` rounds, or when it moves by less than ``epsilon``."""

    max_count: int = 30
    epsilon: float = 1e-3


@dataclass(frozen=True)
class Shape:
    rows: int
    cols: int
    channels: int = 1


def matrix_type(depth: str, channels: int = 1) -> int:
    """Depth and channels in one integer."""
    return DEPTHS[depth][2] + ((channels - 1) << 3)


def is_float(depth: str) -> bool:
    return DEPTHS[depth][0] is None


def saturate_cast(v: Column, depth: str) -> Column:
    """Half-to-even rounding, clamped to the depth's range; NaN is 0; floats stay."""
    if depth == "f32":
        return v.cast("float").cast("double")
    if is_float(depth):
        return v.cast("double")
    low, high = DEPTHS[depth][:2]
    return F.when(F.isnan(v.cast("double")), 0.0).otherwise(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.rint(v.cast("double")))))


def truncate_cast(v: Column, depth: str) -> Column:
    """Towards zero; what doesn't fit the depth (or is NaN) is 0; floats stay."""
    if is_float(depth):
        return saturate_cast(v, depth)
    low, high = DEPTHS[depth][:2]
    v = v.cast("double")
    return F.when(F.isnan(v) | (v <= low - 1.0) | (v >= high + 1.0), 0.0).otherwise(F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double"))


def clamp(v: Column, depth: str) -> Column:
    """Clamped to the depth's range, without rounding."""
    if is_float(depth):
        return v
    low, high = DEPTHS[depth][:2]
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v))


def strict_cast(v: Column, depth: str) -> Column:
    """Towards zero; a value that doesn't fit raises."""
    if is_float(depth):
        return saturate_cast(v, depth)
    low, high = DEPTHS[depth][:2]
    v = v.cast("double")
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")
    return F.when(F.isnan(v) | (v <= low - 1.0) | (v >= high + 1.0), F.raise_error(F.lit(f"value out of range for {depth}")).cast("double")).otherwise(whole)


def scalar(values: float | list[float] | tuple[float, ...], c: Column) -> Column:
    """A per-channel constant: one number, or up to four with zero for channels beyond."""
    if isinstance(values, int | float):
        return F.lit(float(values))
    out = F.lit(0.0)
    for k, s in enumerate(values):
        out = F.when(c == k, float(s)).otherwise(out)
    return out


def half_away(x: float) -> int:
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)

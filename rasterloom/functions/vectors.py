"""Scalars of four channels and short vectors as arrays, points and rectangles as structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def add(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Element by element; a divisor of 0 gives 0."""
    return zipped(a, b, lambda x, y: F.when(y == 0, 0.0).otherwise(x / F.when(y == 0, 1.0).otherwise(y)))


def checked_divide(a: Column, b: Column) -> Column:
    """Element by element; a divisor of 0 raises."""
    return zipped(a, b, lambda x, y: F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(x / F.when(y == 0, 1.0).otherwise(y)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(multiply(a, b), F.lit(0.0), lambda s, v: s + v)


def mapped(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, f)


def filled(value: float, n: int = 4) -> Column:
    return F.array(*[F.lit(float(value))] * n)


def channel_or_default(a: Column, k: int, default: float = 0.0) -> Column:
    return F.coalesce(F.get(a, F.lit(k)), F.lit(default))


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def area(r: Column) -> Column:
    """Of a size or a rectangle."""
    return r["width"] * r["height"]


def top_left(r: Column) -> Column:
    return F.struct(r["x"].alias("x"), r["y"].alias("y"))


def bottom_right(r: Column) -> Column:
    return F.struct((r["x"] + r["width"]).alias("x"), (r["y"] + r["height"]).alias("y"))


def rotated_rect(cx: Column, cy: Column, width: Column, height: Column, angle: Column) -> Column:
    return F.struct(F.struct(cx.alias("x"), cy.alias("y")).alias("center"), F.struct(width.alias("width"), height.alias("height")).alias("size"), angle.alias("angle"))


def span(start: Column, end: Column) -> Column:
    """A half-open range of places."""
    return F.struct(start.alias("start"), end.alias("end"))


def span_size(r: Column) -> Column:
    return F.greatest(F.lit(0), r["end"] - r["start"])

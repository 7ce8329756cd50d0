"""The registered queries of the matrix operators over the driver's tables, each with DuckDB SQL where SQL can say it.

Virtual inputs: ``img8``, 8 x 8 8-bit images from the embeddings; pairs ``a`` and ``b`` of consecutive images;
``rgb``, three consecutive images as channels; descriptors and points from the embeddings and lineitem.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import cluster, elementwise, estimation, features, flow, geometry, histogram, linalg, matching, neighbourhood, random, reduce, segments, structural
from ..sources import pixels
from ..sources.local import small_table
from ..sources.pixels import KEYS
from ..sources.spool import durable, shared_folder
from ..sources.tables import read_table
from ..streaming import frames, tracks
from ..types import Border, Criteria, Shape
from . import taps as T

S8 = Shape(8, 8)

def val() -> Column:
    return F.col("v")


# ---- inputs


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def img8(spark: SparkSession, d: str) -> DataFrame:
    px = pixels.from_arrays(read(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return px.withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((val() + 0.55) * 240).cast("double"))))


def img8f(spark: SparkSession, d: str) -> DataFrame:
    return pixels.from_arrays(read(spark, d, "embeddings"), "vec_id", "embedding", 8)


def pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    px = img8(spark, d)
    half = F.floor(F.col("img") / 2).cast("long")
    return tuple(px.where(F.col("img") % 2 == k).withColumn("img", half) for k in (0, 1))


def rgb(spark: SparkSession, d: str) -> DataFrame:
    whole = F.floor((F.max("vec_id") + 1) / 3).cast("long").alias("n")
    n = read(spark, d, "embeddings").agg(whole)
    px = img8(spark, d).withColumn("c", (F.col("img") % 3).cast("int")).withColumn("img", F.floor(F.col("img") / 3).cast("long"))
    return px.join(F.broadcast(n), px["img"] < n["n"]).select(*KEYS, "v")


def mask8(spark: SparkSession, d: str) -> DataFrame:
    return img8(spark, d).withColumn("v", F.when(val() > 127, 255.0).otherwise(0.0))


IMG8 = """img8f AS (SELECT vec_id AS img, (i // 8)::INT AS y, (i % 8)::INT AS x, 0 AS c, embedding[i + 1]::DOUBLE AS v
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)),
img8 AS (SELECT img, y, x, c, greatest(0.0, least(255.0, floor((v + 0.55) * 240)))::DOUBLE AS v FROM img8f),
a AS (SELECT img // 2 AS img, y, x, c, v FROM img8 WHERE img % 2 = 0),
b AS (SELECT img // 2 AS img, y, x, c, v FROM img8 WHERE img % 2 = 1),
rgb AS (SELECT img // 3 AS img, y, x, (img % 3)::INT AS c, v FROM img8 WHERE img // 3 < (SELECT (max(vec_id) + 1) // 3 FROM embeddings))"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([IMG8, *ctes]) + "\n" + body


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Rounded to six places, without a negative zero."""
    return df.withColumns({n: F.round(F.col(n), 6) + 0.0 for n in (names or ("v",))})


def s6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        SQL[name] = oracle


# ---- element-wise (a and b are 8-bit images)

CLAMP = "least(255.0, greatest(0.0, {}))"


def trunc_sql(e: str) -> str:
    return f"CASE WHEN ({e}) <= -1.0 OR ({e}) >= 256.0 THEN 0.0 ELSE trunc({e}) END"


BINARY = {
    "add": (lambda a, b: elementwise.add(a, b), CLAMP.format("a.v + b.v")),
    "subtract": (lambda a, b: elementwise.subtract(a, b), CLAMP.format("a.v - b.v")),
    "multiply": (lambda a, b: elementwise.multiply(a, b), CLAMP.format("a.v * b.v")),
    "divide": (lambda a, b: elementwise.divide(a, b), "CASE WHEN b.v = 0 THEN 0.0 ELSE trunc(a.v / b.v) END"),
    "add_weighted": (lambda a, b: elementwise.add_weighted(a, 0.75, b, 0.25, 3.0), trunc_sql("a.v * 0.75 + b.v * 0.25 + 3.0")),
    "bitwise_and": (lambda a, b: elementwise.bitwise_and(a, b), "(a.v::BIGINT & b.v::BIGINT)::DOUBLE"),
    "bitwise_or": (lambda a, b: elementwise.bitwise_or(a, b), "(a.v::BIGINT | b.v::BIGINT)::DOUBLE"),
    "bitwise_xor": (lambda a, b: elementwise.bitwise_xor(a, b), "xor(a.v::BIGINT, b.v::BIGINT)::DOUBLE"),
    "min": (lambda a, b: elementwise.minimum(a, b), "least(a.v, b.v)"),
    "max": (lambda a, b: elementwise.maximum(a, b), "greatest(a.v, b.v)"),
    "abs_diff": (lambda a, b: elementwise.abs_diff(a, b), "abs(a.v - b.v)"),
    "magnitude": (lambda a, b: elementwise.magnitude(a, b), "sqrt(a.v * a.v + b.v * b.v)"),
    "phase": (lambda a, b: elementwise.phase(a, b, True), "degrees(CASE WHEN atan2(b.v, a.v) < 0 THEN atan2(b.v, a.v) + 2 * pi() ELSE atan2(b.v, a.v) END)"),
    **{f"compare_{op}": (lambda a, b, op=op: elementwise.compare(a, b, op), f"CASE WHEN a.v {sign} b.v THEN 255.0 ELSE 0.0 END") for op, sign in (("eq", "="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("ne", "<>"))},
}
for _name, (_f, _e) in BINARY.items():
    register(_name, lambda s, d, f=_f: r6(f(*pair(s, d))), sql(f"SELECT a.img, a.y, a.x, a.c, {s6(_e)} AS v FROM a JOIN b USING (img, y, x, c)"))

register(
    "absdiff",
    lambda s, d: r6(elementwise.absdiff(*[img8f(s, d).where(F.col("img") % 2 == k).withColumn("img", F.floor(F.col("img") / 2).cast("long")) for k in (0, 1)])),
    sql(f"SELECT a.img, a.y, a.x, a.c, {s6('abs(a.v - b.v)')} AS v FROM (SELECT img // 2 AS img, y, x, c, v FROM img8f WHERE img % 2 = 0) a JOIN (SELECT img // 2 AS img, y, x, c, v FROM img8f WHERE img % 2 = 1) b USING (img, y, x, c)"),
)

SCALAR3 = "CASE c WHEN 0 THEN 10.0 WHEN 1 THEN 60.0 WHEN 2 THEN 3.0 ELSE 0.0 END"
ON_RGB = {
    "add_scalar": (lambda p: elementwise.add_scalar(p, [10, 60, 3]), CLAMP.format(f"v + {SCALAR3}")),
    "subtract_scalar": (lambda p: elementwise.subtract_scalar(p, [10, 60, 3]), CLAMP.format(f"v - {SCALAR3}")),
    "multiply_scalar": (lambda p: elementwise.multiply_scalar(p, [1.5, 0.5, 2.0]), trunc_sql("v * CASE c WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE 2.0 END")),
    "divide_scalar": (lambda p: elementwise.divide_scalar(p, [10, 0, 3]), "CASE c WHEN 1 THEN 0.0 WHEN 0 THEN trunc(v / 10.0) ELSE trunc(v / 3.0) END"),
    "bitwise_and_scalar": (lambda p: elementwise.bitwise_and_scalar(p, [15, 240, 3]), "(v::BIGINT & CASE c WHEN 0 THEN 15 WHEN 1 THEN 240 ELSE 3 END)::DOUBLE"),
    "bitwise_or_scalar": (lambda p: elementwise.bitwise_or_scalar(p, [15, 240, 3]), "(v::BIGINT | CASE c WHEN 0 THEN 15 WHEN 1 THEN 240 ELSE 3 END)::DOUBLE"),
    "bitwise_xor_scalar": (lambda p: elementwise.bitwise_xor_scalar(p, [15, 240, 3]), "xor(v::BIGINT, CASE c WHEN 0 THEN 15 WHEN 1 THEN 240 ELSE 3 END)::DOUBLE"),
    "bitwise_not": (lambda p: elementwise.bitwise_not(p), "255.0 - v"),
    "min_scalar": (lambda p: elementwise.min_scalar(p, [100, 120, 140]), "least(v, CASE c WHEN 0 THEN 100.0 WHEN 1 THEN 120.0 ELSE 140.0 END)"),
    "max_scalar": (lambda p: elementwise.max_scalar(p, [100, 120, 140]), "greatest(v, CASE c WHEN 0 THEN 100.0 WHEN 1 THEN 120.0 ELSE 140.0 END)"),
    "abs_diff_scalar": (lambda p: elementwise.abs_diff_scalar(p, [100, 120, 140]), "abs(v - CASE c WHEN 0 THEN 100.0 WHEN 1 THEN 120.0 ELSE 140.0 END)"),
    "compare_scalar": (lambda p: elementwise.compare_scalar(p, [100, 120, 140], "gt"), "CASE WHEN v > CASE c WHEN 0 THEN 100.0 WHEN 1 THEN 120.0 ELSE 140.0 END THEN 255.0 ELSE 0.0 END"),
    "sqrt": (lambda p: elementwise.sqrt(p), "sqrt(v)"),
    "exp": (lambda p: elementwise.exp(elementwise.multiply_scalar(p, 0.01, "f64")), "exp(v * 0.01)"),
    "log": (lambda p: elementwise.log(elementwise.add_scalar(p, 1, "f64")), "ln(v + 1)"),
    "pow": (lambda p: elementwise.power(p, 1.5), "pow(v, 1.5)"),
    "convert_scale_abs": (lambda p: elementwise.convert_scale_abs(p, -1.5, 20.25), "floor(least(255.0, abs(v * -1.5 + 20.25)) + 0.5)"),
    "saturate_cast": (lambda p: elementwise.saturating(elementwise.add_weighted(p, 1.5, p, 0.0, -60.5, "f64"), "u8"), "least(255.0, greatest(0.0, round_even(v * 1.5 - 60.5, 0)))"),
    "convert_to": (lambda p: elementwise.convert_to(elementwise.multiply_scalar(p, 0.37, "f64"), "u8"), "trunc(v * 0.37)"),
    "set_to": (lambda p: elementwise.set_to(p, [7, 8, 9]), "CASE c WHEN 0 THEN 7.0 WHEN 1 THEN 8.0 ELSE 9.0 END"),
    "lut": (lambda p: elementwise.lut(p, [float((255 - i) * i % 251) for i in range(256)]), "((255 - v::BIGINT) * v::BIGINT % 251)::DOUBLE"),
    "lut_by_channel": (lambda p: elementwise.lut(p, [[float((i + k) % 256) for i in range(256)] for k in range(3)]), "((v::BIGINT + c) % 256)::DOUBLE"),
    **{
        f"threshold_{kind}": (lambda p, kind=kind: elementwise.threshold(p, 127.0, 200.0, kind), e)
        for kind, e in (
            ("binary", "CASE WHEN v > 127 THEN 200.0 ELSE 0.0 END"),
            ("binary_inv", "CASE WHEN v > 127 THEN 0.0 ELSE 200.0 END"),
            ("trunc", "CASE WHEN v > 127 THEN 127.0 ELSE v END"),
            ("tozero", "CASE WHEN v > 127 THEN v ELSE 0.0 END"),
            ("tozero_inv", "CASE WHEN v > 127 THEN 0.0 ELSE v END"),
        )
    },
}
for _name, (_f, _e) in ON_RGB.items():
    register(_name, lambda s, d, f=_f: r6(f(rgb(s, d))), sql(f"SELECT img, y, x, c, {s6(_e)} AS v FROM rgb"))

register(
    "cart_to_polar",
    lambda s, d: r6(elementwise.cart_to_polar(*pair(s, d)), "magnitude", "angle"),
    sql(f"SELECT a.img, a.y, a.x, a.c, {s6('sqrt(a.v * a.v + b.v * b.v)')} AS magnitude, {s6('atan2(b.v, a.v)')} AS angle FROM a JOIN b USING (img, y, x, c)"),
)
register(
    "polar_to_cart",
    lambda s, d: r6(elementwise.polar_to_cart(*pair(s, d), degrees=True), "cart_x", "cart_y"),
    sql(f"SELECT a.img, a.y, a.x, a.c, {s6('a.v * cos(radians(b.v))')} AS cart_x, {s6('a.v * sin(radians(b.v))')} AS cart_y FROM a JOIN b USING (img, y, x, c)"),
)
MIX = [[0.5, 0.25, 0.25, 1.0], [0.1, 0.8, -0.1, 0.0]]
register(
    "transform",
    lambda s, d: r6(elementwise.transform(rgb(s, d), MIX)),
    sql(f"SELECT img, y, x, r AS c, {s6('sum(v * m) + max(o)')} AS v FROM rgb JOIN t USING (c) GROUP BY img, y, x, r", "t(r, c, m, o) AS (VALUES (0, 0, 0.5::DOUBLE, 1.0::DOUBLE), (0, 1, 0.25, 1.0), (0, 2, 0.25, 1.0), (1, 0, 0.1, 0.0), (1, 1, 0.8, 0.0), (1, 2, -0.1, 0.0))"),
)
HOMOGRAPHY = [[1.1, 0.2, 3.0], [-0.1, 0.9, 5.0], [0.001, 0.002, 1.0]]


def line_points(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).cast("double").alias("y"))


register(
    "perspective_transform",
    lambda s, d: r6(elementwise.perspective_transform(line_points(s, d), HOMOGRAPHY), "x", "y"),
    f"""SELECT l_orderkey, l_linenumber, {s6('(1.1 * x + 0.2 * y + 3.0) / w')} AS x, {s6('(-0.1 * x + 0.9 * y + 5.0) / w')} AS y
    FROM (SELECT *, 0.001 * x + 0.002 * y + 1.0 AS w FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x, (l_discount * 100)::DOUBLE AS y FROM lineitem))""",
)
register(
    "in_range",
    lambda s, d: elementwise.in_range(rgb(s, d), elementwise.set_to(rgb(s, d), [80, 90, 100]), elementwise.set_to(rgb(s, d), [180, 170, 160])),
    sql("SELECT img, y, x, 0 AS c, CASE WHEN bool_and(v BETWEEN 80 + 10 * c AND 180 - 10 * c) THEN 255.0::DOUBLE ELSE 0.0 END AS v FROM rgb GROUP BY img, y, x"),
)
register("in_range_scalar", lambda s, d: elementwise.in_range_scalar(rgb(s, d), [80, 90, 100], [180, 170, 160]), SQL["in_range"])
register(
    "set_to_masked",
    lambda s, d: elementwise.set_to_masked(pair(s, d)[0], 99.0, elementwise.threshold(pair(s, d)[1], 127, 255)),
    sql("SELECT a.img, a.y, a.x, a.c, CASE WHEN b.v > 127 THEN 99.0 ELSE a.v END AS v FROM a LEFT JOIN b USING (img, y, x, c)"),
)
register("element_get", lambda s, d: elementwise.get(img8(s, d), 3, 4), sql("SELECT img, v FROM img8 WHERE y = 3 AND x = 4"))

# ---- reductions

register("sum", lambda s, d: reduce.total(rgb(s, d)), sql("SELECT img, c, sum(v) AS sum FROM rgb GROUP BY img, c"))
register("mean", lambda s, d: r6(reduce.mean(rgb(s, d)), "mean"), sql(f"SELECT img, c, {s6('avg(v)')} AS mean FROM rgb GROUP BY img, c"))
register("mean_std_dev", lambda s, d: r6(reduce.mean_std_dev(rgb(s, d)), "mean", "std_dev"), sql(f"SELECT img, c, {s6('avg(v)')} AS mean, {s6('stddev_pop(v)')} AS std_dev FROM rgb GROUP BY img, c"))
for _kind, _e in (("inf", "max(abs(v))"), ("l1", "sum(abs(v))"), ("l2", "sqrt(sum(v * v))")):
    register(f"norm_{_kind}", lambda s, d, k=_kind: r6(reduce.norm(rgb(s, d), k), "norm"), sql(f"SELECT img, {s6(_e)} AS norm FROM rgb GROUP BY img"))
register("norm_masked", lambda s, d: r6(reduce.norm(img8(s, d), "l2", mask8(s, d)), "norm"), sql(f"SELECT img, {s6('sqrt(sum(v * v))')} AS norm FROM img8 WHERE v > 127 GROUP BY img"))
register(
    "normalize_minmax",
    lambda s, d: r6(reduce.normalize(img8(s, d), 0.0, 1.0, "minmax")),
    sql(f"SELECT img, y, x, c, {s6('CASE WHEN hi = lo THEN 0.0 ELSE (v - lo) / (hi - lo) END')} AS v FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM img8 WINDOW w AS (PARTITION BY img))"),
)
register("normalize_l2", lambda s, d: r6(reduce.normalize(img8(s, d), 10.0, 0.0, "l2")), sql(f"SELECT img, y, x, c, {s6('v * 10.0 / sqrt(sum(v * v) OVER (PARTITION BY img))')} AS v FROM img8"))
register(
    "normalize_masked",
    lambda s, d: r6(reduce.normalize(img8(s, d), 0.0, 1.0, "minmax", mask8(s, d))),
    sql(f"SELECT img, y, x, c, {s6('CASE WHEN v <= 127 THEN v WHEN hi = lo THEN 0.0 ELSE (v - lo) / (hi - lo) END')} AS v FROM img8 LEFT JOIN (SELECT img, min(v) AS lo, max(v) AS hi FROM img8 WHERE v > 127 GROUP BY img) USING (img)"),
)
for _how in ("sum", "avg", "max", "min"):
    register(f"reduce_rows_{_how}", lambda s, d, h=_how: r6(reduce.reduce(rgb(s, d), 0, h)), sql(f"SELECT img, 0 AS y, x, c, {s6(f'{_how}(v)')} AS v FROM rgb GROUP BY img, x, c"))
    register(f"reduce_cols_{_how}", lambda s, d, h=_how: r6(reduce.reduce(rgb(s, d), 1, h)), sql(f"SELECT img, y, 0 AS x, c, {s6(f'{_how}(v)')} AS v FROM rgb GROUP BY img, y, c"))
register("reduce_both", lambda s, d: reduce.reduce_both(rgb(s, d), "sum").select("img", "y", "x", "c", "v"), sql("SELECT img, y, x, c, sum(v) AS v FROM rgb GROUP BY GROUPING SETS ((img, y, c), (img, x, c))"))
register("count_non_zero", lambda s, d: reduce.count_non_zero(elementwise.threshold(img8(s, d), 127, 255)), sql("SELECT img, count(*) FILTER (v > 127) AS n FROM img8 GROUP BY img"))
register("has_no_zero", lambda s, d: reduce.has_no_zero(elementwise.threshold(img8(s, d), 30, 255, "tozero")), sql('SELECT img, bool_and(v > 30) AS "full" FROM img8 GROUP BY img'))
register("check_range", lambda s, d: reduce.check_range(img8(s, d), 20, 230), sql("SELECT img, bool_and(v BETWEEN 20 AND 230) AS inside FROM img8 GROUP BY img"))
register(
    "min_max_loc",
    lambda s, d: reduce.min_max_loc(img8(s, d)),
    sql("SELECT img, min(v) AS min_v, max(v) AS max_v, arg_min(x, (v * 64 + y * 8 + x)) AS min_x, arg_min(y, (v * 64 + y * 8 + x)) AS min_y, arg_max(x, (v * 64 - y * 8 - x)) AS max_x, arg_max(y, (v * 64 - y * 8 - x)) AS max_y FROM img8 GROUP BY img"),
)
register("dot", lambda s, d: reduce.dot(*pair(s, d)), sql("SELECT img, sum(a.v * b.v) AS dot FROM a JOIN b USING (img, y, x, c) GROUP BY img"))
register("trace", lambda s, d: reduce.trace(rgb(s, d)), sql("SELECT img, c, sum(v) AS trace FROM rgb WHERE x = y GROUP BY img, c"))
register("psnr", lambda s, d: r6(reduce.psnr(*pair(s, d)), "psnr"), sql(f"SELECT img, {s6('10 * log10(65025.0 / avg((a.v - b.v) * (a.v - b.v)))')} AS psnr FROM a JOIN b USING (img, y, x, c) GROUP BY img"))
METRIC = [[2.0 if i == j else 0.5 if abs(i - j) == 1 else 0.0 for j in range(8)] for i in range(8)]
register(
    "mahalanobis",
    lambda s, d: r6(reduce.mahalanobis(*[p.withColumn("img", F.col("img") * 8 + F.col("x")).withColumn("x", F.lit(0)) for p in pair(s, d)], METRIC), "distance"),
    sql(f"SELECT p.img, {s6('sqrt(sum(p.d * q.d * CASE WHEN p.y = q.y THEN 2.0 WHEN abs(p.y - q.y) = 1 THEN 0.5 ELSE 0.0 END))')} AS distance FROM diff p JOIN diff q ON p.img = q.img GROUP BY p.img", "diff AS (SELECT img * 8 + x AS img, y, a.v - b.v AS d FROM a JOIN b USING (img, y, x, c))"),
)
for _by, _key, _mov in (("row", "y", "x"), ("column", "x", "y")):
    for _desc in (False, True):
        _o = "DESC" if _desc else "ASC"
        _n = f"{_by}_{_o.lower()}"
        register(f"sort_{_n}", lambda s, d, b=_by, e=_desc: reduce.sort(img8(s, d), b, e), sql(f"SELECT img, {_key}, (row_number() OVER (PARTITION BY img, {_key} ORDER BY v {_o}, {_mov}) - 1)::INT AS {_mov}, c, v FROM img8"))
        register(f"sort_idx_{_n}", lambda s, d, b=_by, e=_desc: reduce.sort_idx(img8(s, d), b, e), sql(f"SELECT img, {_key}, (row_number() OVER (PARTITION BY img, {_key} ORDER BY v {_o}, {_mov} {_o}) - 1)::INT AS {_mov}, c, {_mov}::DOUBLE AS v FROM img8"))


def keypoint_rows(spark: SparkSession, d: str) -> DataFrame:
    """A keypoint for each pixel of img8: its value is the response."""
    return img8(spark, d).select("img", (F.col("y") * 8 + F.col("x")).alias("ord"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), (val() / 16 + 1).alias("size"), val().alias("response"))


register("sort_by_response", lambda s, d: reduce.sort_by_response(keypoint_rows(s, d)).select("img", "ord", "position"), sql("SELECT img, y * 8 + x AS ord, (row_number() OVER (PARTITION BY img ORDER BY v DESC, y, x) - 1)::INT AS position FROM img8"))
register("retain_best", lambda s, d: reduce.retain_best(keypoint_rows(s, d), 5).select("img", "ord", "response"), sql("SELECT img, y * 8 + x AS ord, v AS response FROM img8 QUALIFY row_number() OVER (PARTITION BY img ORDER BY v DESC, y, x) <= 5"))

# ---- histograms

H16 = lambda p: histogram.calc_hist([(p, 1)], [0], [16], [[0, 256]])


def hist_sql(source: str, name: str) -> str:
    return f"{name} AS (SELECT f.img, f.bin, coalesce(k.n, 0)::DOUBLE AS n FROM (SELECT img, unnest(range(16))::INT AS bin FROM (SELECT DISTINCT img FROM {source})) f LEFT JOIN (SELECT img, floor(v / 16)::INT AS bin, count(*) AS n FROM {source} GROUP BY ALL) k USING (img, bin))"


register("calc_hist", lambda s, d: H16(img8(s, d)), sql("SELECT * FROM h", hist_sql("img8", "h")))
register(
    "calc_hist_2d",
    lambda s, d: histogram.calc_hist([(rgb(s, d), 3)], [0, 2], [4, 4], [[0, 256], [0, 256]]),
    sql(
        "SELECT f.img, f.bin, coalesce(k.n, 0)::DOUBLE AS n FROM (SELECT img, unnest(range(16))::INT AS bin FROM (SELECT DISTINCT img FROM rgb)) f LEFT JOIN (SELECT p.img, (floor(p.v / 64) * 4 + floor(q.v / 64))::INT AS bin, count(*) AS n FROM rgb p JOIN rgb q USING (img, y, x) WHERE p.c = 0 AND q.c = 2 GROUP BY ALL) k USING (img, bin)"
    ),
)
register(
    "hist_non_uniform",
    lambda s, d: histogram.calc_hist([(img8(s, d), 1)], [0], [3], [[0, 50, 128, 200]], mask=None),
    sql("SELECT f.img, f.bin, coalesce(k.n, 0)::DOUBLE AS n FROM (SELECT img, unnest(range(3))::INT AS bin FROM (SELECT DISTINCT img FROM img8)) f LEFT JOIN (SELECT img, CASE WHEN v < 50 THEN 0 WHEN v < 128 THEN 1 ELSE 2 END AS bin, count(*) AS n FROM img8 WHERE v < 200 GROUP BY ALL) k USING (img, bin)"),
)
register(
    "hist_masked_accumulated",
    lambda s, d: histogram.calc_hist([(img8(s, d), 1)], [0], [16], [[0, 256]], mask8(s, d), H16(img8(s, d))),
    sql("SELECT img, bin, n + CASE WHEN bin >= 8 THEN n ELSE 0 END AS n FROM h", hist_sql("img8", "h")),
)
register(
    "back_project",
    lambda s, d: histogram.calc_back_project([(img8(s, d), 1)], [0], [16], [[0, 256]], H16(img8(s, d)), 0.5),
    sql("SELECT p.img, p.y, p.x, p.c, n * 0.5 AS v FROM img8 p JOIN h ON h.img = p.img AND h.bin = floor(p.v / 16)::INT", hist_sql("img8", "h")),
)
COMPARISONS = {
    "correl": "CASE WHEN abs((s11 - s1 * s1 / 16) * (s22 - s2 * s2 / 16)) > 2.220446049250313e-16 THEN (s12 - s1 * s2 / 16) / sqrt((s11 - s1 * s1 / 16) * (s22 - s2 * s2 / 16)) ELSE 1.0 END",
    "chisqr": "chi",
    "chisqr_alt": "2 * alt",
    "intersection": "low",
    "bhattacharyya": "sqrt(greatest(0.0, 1 - root / sqrt(s1 * s2)))",
    "kl_div": "kl",
}
for _m, _e in COMPARISONS.items():
    register(
        f"compare_hist_{_m}",
        lambda s, d, m=_m: r6(histogram.compare_hist(*[H16(p) for p in pair(s, d)], m), "distance"),
        sql(
            f"SELECT img, {s6(_e)} AS distance FROM s",
            hist_sql("a", "ha"),
            hist_sql("b", "hb"),
            """s AS (SELECT img, sum(p.n) AS s1, sum(q.n) AS s2, sum(p.n * p.n) AS s11, sum(q.n * q.n) AS s22, sum(p.n * q.n) AS s12, sum(sqrt(p.n * q.n)) AS root, sum(least(p.n, q.n)) AS low,
            sum(CASE WHEN p.n > 0 THEN (p.n - q.n) * (p.n - q.n) / p.n ELSE 0.0 END) AS chi, sum(CASE WHEN p.n + q.n > 0 THEN (p.n - q.n) * (p.n - q.n) / (p.n + q.n) ELSE 0.0 END) AS alt,
            sum(CASE WHEN p.n > 0 THEN p.n * ln(p.n / CASE WHEN q.n > 0 THEN q.n ELSE 1e-10 END) ELSE 0.0 END) AS kl FROM ha p JOIN hb q USING (img, bin) GROUP BY img)""",
        ),
    )
register(
    "equalize_hist",
    lambda s, d: histogram.equalize_hist(img8(s, d)),
    sql(
        "SELECT img, y, x, c, CASE WHEN total = f THEN v ELSE floor((cum - f) * (255.0 / (total - f)) + 0.5) END AS v FROM img8 JOIN t USING (img, v)",
        "t AS (SELECT img, v, sum(n) OVER w AS cum, first(n) OVER w AS f, sum(n) OVER (PARTITION BY img) AS total FROM (SELECT img, v, count(*)::DOUBLE AS n FROM img8 GROUP BY img, v) WINDOW w AS (PARTITION BY img ORDER BY v))",
    ),
)


def clahe_sql(source: str, bins: int, counts: str) -> str:
    """``counts`` says how many of a tile's 16 pixels count for bin k: n of them have that value."""
    return sql(
        f"""SELECT p.img, p.y, p.x, p.c, floor(round(sum(l.lut * wy.w * wx.w), 9) + 0.5) AS v
        FROM {source} p JOIN w wy ON wy.i = p.y JOIN w wx ON wx.i = p.x JOIN l ON l.img = p.img AND l.ty = wy.t AND l.tx = wx.t AND l.k = p.v GROUP BY ALL""",
        "big AS (SELECT img, y, x, c, v * 16 AS v FROM img8)",
        "w AS (SELECT i, least(1, greatest(0, floor(i / 4.0 - 0.5)::INT + o)) AS t, sum(CASE WHEN o = 0 THEN 1 - ((i / 4.0 - 0.5) - floor(i / 4.0 - 0.5)) ELSE (i / 4.0 - 0.5) - floor(i / 4.0 - 0.5) END)::DOUBLE AS w FROM (SELECT unnest(range(8))::INT AS i), (SELECT unnest([0, 1]) AS o) GROUP BY ALL)",
        f"k AS (SELECT img, y // 4 AS ty, x // 4 AS tx, v AS k, count(*) AS n FROM {source} GROUP BY ALL)",
        f"f AS (SELECT img, ty, tx, g.k, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT img, ty, tx FROM k) JOIN (SELECT unnest(range({bins}))::DOUBLE AS k) g ON true LEFT JOIN k USING (img, ty, tx, k))",
        "e AS (SELECT *, sum(greatest(0, n - 1)) OVER (PARTITION BY img, ty, tx) AS over FROM f)",
        f"l AS (SELECT img, ty, tx, k, least({bins - 1}.0, floor(sum({counts}) OVER (PARTITION BY img, ty, tx ORDER BY k) * ({bins - 1}.0 / 16) + 0.5)) AS lut FROM e)",
    )


CLIPPED = "least(n, 1) + over // {0} + CASE WHEN over % {0} > 0 AND k::BIGINT % ({0} // greatest(1, over % {0})) = 0 AND k::BIGINT // ({0} // greatest(1, over % {0})) < over % {0} THEN 1 ELSE 0 END"
register("clahe", lambda s, d: histogram.clahe(img8(s, d), S8, 2.0, (2, 2)), clahe_sql("img8", 256, CLIPPED.format(256)))
register("clahe_unclipped", lambda s, d: histogram.clahe(img8(s, d), S8, 0.0, (2, 2)), clahe_sql("img8", 256, "n"))
register("clahe_u16", lambda s, d: histogram.clahe(elementwise.multiply_scalar(img8(s, d), 16, "u16"), S8, 2.0, (2, 2), bits=12), clahe_sql("big", 4096, CLIPPED.format(4096)))

# ---- moving pixels

MOVES = {
    "flip_vertical": (lambda p: structural.flip(p, S8, 0), "7 - y", "x"),
    "flip_horizontal": (lambda p: structural.flip(p, S8, 1), "y", "7 - x"),
    "flip_both": (lambda p: structural.flip(p, S8, -1), "7 - y", "7 - x"),
    "flip_nd": (lambda p: structural.flip_nd(p, S8, 1), "y", "7 - x"),
    "transpose": (lambda p: structural.transpose(p), "x", "y"),
    "rotate_90": (lambda p: structural.rotate(p, S8, 0), "x", "7 - y"),
    "rotate_180": (lambda p: structural.rotate(p, S8, 1), "7 - y", "7 - x"),
    "rotate_270": (lambda p: structural.rotate(p, S8, 2), "7 - x", "y"),
    "reshape": (lambda p: structural.reshape(p, S8, 0, 4), "(y * 8 + x) // 16", "(y * 8 + x) % 16"),
}
for _name, (_f, _y, _x) in MOVES.items():
    register(_name, lambda s, d, f=_f: f(img8(s, d)), sql(f"SELECT img, ({_y})::INT AS y, ({_x})::INT AS x, c, v FROM img8"))
register("split", lambda s, d: structural.split(rgb(s, d), 3)[1], sql("SELECT img, y, x, 0 AS c, v FROM rgb WHERE c = 1"))
register("extract_channel", lambda s, d: structural.extract_channel(rgb(s, d), 2), sql("SELECT img, y, x, 0 AS c, v FROM rgb WHERE c = 2"))
register("merge", lambda s, d: structural.merge(list(pair(s, d))), sql("SELECT img, y, x, 0 AS c, v FROM a UNION ALL SELECT img, y, x, 1 AS c, v FROM b"))
register("mix_channels", lambda s, d: structural.mix_channels([(rgb(s, d), 3)], [3], [(0, 2), (1, 1), (2, 0)])[0], sql("SELECT img, y, x, 2 - c AS c, v FROM rgb"))
register("insert_channel", lambda s, d: structural.insert_channel(rgb(s, d), structural.extract_channel(rgb(s, d), 0), 2), sql("SELECT img, y, x, c, v FROM rgb WHERE c <> 2 UNION ALL SELECT img, y, x, 2 AS c, v FROM rgb WHERE c = 0"))
register(
    "copy_make_border_constant",
    lambda s, d: structural.copy_make_border(img8(s, d), S8, 1, 2, 3, 1, value=9.0),
    sql("SELECT i.img, g.y::INT AS y, h.x::INT AS x, 0 AS c, coalesce(p.v, 9.0) AS v FROM (SELECT DISTINCT img FROM img8) i, (SELECT unnest(range(11)) AS y) g, (SELECT unnest(range(12)) AS x) h LEFT JOIN img8 p ON p.img = i.img AND p.y = g.y - 1 AND p.x = h.x - 3"),
)
register(
    "copy_make_border_reflect",
    lambda s, d: structural.copy_make_border(img8(s, d), S8, 2, 2, 2, 2, reflect=True),
    sql("SELECT p.img, g.i AS y, h.i AS x, p.c, p.v FROM img8 p JOIN m g ON p.y = g.s JOIN m h ON p.x = h.s", "m AS (SELECT i::INT AS i, CASE WHEN i < 2 THEN 1 - i WHEN i > 9 THEN 17 - i ELSE i - 2 END AS s FROM (SELECT unnest(range(12)) AS i))"),
)
register("repeat", lambda s, d: structural.repeat(img8(s, d), S8, 2, 3), sql("SELECT img, (y + 8 * j)::INT AS y, (x + 8 * k)::INT AS x, c, v FROM img8, (SELECT unnest(range(2)) AS j), (SELECT unnest(range(3)) AS k)"))
register("hconcat", lambda s, d: structural.hconcat([(p, S8) for p in pair(s, d)]), sql("SELECT img, y, x, c, v FROM a UNION ALL SELECT img, y, x + 8, c, v FROM b"))
register("vconcat", lambda s, d: structural.vconcat([(p, S8) for p in pair(s, d)]), sql("SELECT img, y, x, c, v FROM a UNION ALL SELECT img, y + 8, x, c, v FROM b"))
register("set_identity", lambda s, d: structural.set_identity(rgb(s, d), [3, 2, 1]), sql("SELECT img, y, x, c, CASE WHEN x = y THEN (3 - c)::DOUBLE ELSE 0.0 END AS v FROM rgb"))
register("dense_round_trip", lambda s, d: pixels.to_pixels(pixels.to_dense(rgb(s, d), Shape(8, 8, 3))), sql("SELECT * FROM rgb"))


def many_images(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("img"))


GRID = "SELECT vec_id::BIGINT AS img, (p // 8)::INT AS y, (p // 2 % 4)::INT AS x, (p % 2)::INT AS c, {} AS v FROM embeddings, (SELECT unnest(range(24)) AS p)"
S342 = Shape(3, 4, 2)
register("zeros", lambda s, d: pixels.zeros(many_images(s, d), S342), GRID.format("0.0::DOUBLE"))
register("ones", lambda s, d: pixels.ones(many_images(s, d), S342), GRID.format("1.0::DOUBLE"))
register("eye", lambda s, d: pixels.eye(many_images(s, d), S342), GRID.format("CASE WHEN p // 8 = p // 2 % 4 THEN 1.0::DOUBLE ELSE 0.0 END"))
register("full_scalar", lambda s, d: pixels.full(many_images(s, d), S342, [5, 6]), GRID.format("(5 + p % 2)::DOUBLE"))
register("from_formula", lambda s, d: pixels.from_function(many_images(s, d), S342, "((7 * y + 13 * x + 29 * c) * 37) % 256"), GRID.format("(((7 * (p // 8) + 13 * (p // 2 % 4) + 29 * (p % 2)) * 37) % 256)::DOUBLE"))
register("diag", lambda s, d: pixels.diag(read(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("e")), "vec_id", "e", 4), "SELECT vec_id AS img, y::INT AS y, x::INT AS x, 0 AS c, CASE WHEN x = y THEN embedding[y + 1]::DOUBLE ELSE 0.0 END AS v FROM embeddings, (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x)")

# ---- linear filters: the oracle sums over tap tables written out as values


def values(rows: list[tuple[int, int, float]]) -> str:
    return "(VALUES " + ", ".join(f"({t}, {s}, {w!r}::DOUBLE)" for t, s, w in rows) + ")"


def separable_sql(xs, ys, out: str, source: str = "img8") -> str:
    return sql(
        f"SELECT h.img, ty.t AS y, h.x, h.c, {s6(out.format('sum(h.v * ty.w)'))} AS v FROM h JOIN ty ON h.y = ty.s GROUP BY h.img, ty.t, h.x, h.c",
        f"tx(t, s, w) AS {values(xs)}",
        f"ty(t, s, w) AS {values(ys)}",
        f"h AS (SELECT p.img, p.y, tx.t AS x, p.c, sum(p.v * tx.w) AS v FROM {source} p JOIN tx ON p.x = tx.s GROUP BY p.img, p.y, tx.t, p.c)",
    )


def kt(kernel, border=Border.REFLECT_101, n=8, anchor=-1):
    return T.kernel_taps(n, kernel, anchor, border)


def smooth_kernel(n, sigma):
    w = [math.exp(-((i - (n - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(n)]
    return [v / sum(w) for v in w]


ROUND = "CASE WHEN {0} < 0 THEN -floor(0.5 - {0}) ELSE floor({0} + 0.5) END"
register("box_filter", lambda s, d: r6(neighbourhood.box_filter(img8(s, d), S8, (3, 5), normalize=False)), separable_sql(kt([1.0] * 3), kt([1.0] * 5), "{}"))
register("blur", lambda s, d: r6(neighbourhood.blur(img8(s, d), S8, (3, 3), border=Border.REPLICATE)), separable_sql(kt([1.0] * 3, Border.REPLICATE), kt([1.0] * 3, Border.REPLICATE), "{} / 9"))
for _b in (Border.CONSTANT, Border.REFLECT, Border.WRAP):
    register(f"blur_{_b.name.lower()}", lambda s, d, b=_b: r6(neighbourhood.blur(img8(s, d), S8, (3, 3), border=b)), separable_sql(kt([1.0] * 3, _b), kt([1.0] * 3, _b), "{} / 9"))
register("gaussian_blur", lambda s, d: r6(neighbourhood.gaussian_blur(img8(s, d), S8, (5, 5), 1.2)), separable_sql(kt(smooth_kernel(5, 1.2)), kt(smooth_kernel(5, 1.2)), "{}"))
register("gaussian_blur_auto_sigma", lambda s, d: r6(neighbourhood.gaussian_blur(img8(s, d), S8, (3, 5))), separable_sql(kt(smooth_kernel(3, 0.8)), kt(smooth_kernel(5, 1.1)), "{}"))
register("sobel_x", lambda s, d: r6(neighbourhood.sobel(img8(s, d), S8, 1, 0)), separable_sql(kt([-1, 0, 1]), kt([1, 2, 1]), "{}"))
register("sobel_y_5", lambda s, d: r6(neighbourhood.sobel(img8(s, d), S8, 0, 1, 5, 0.5, 3.0)), separable_sql(kt([1, 4, 6, 4, 1]), kt([-1, -2, 0, 2, 1]), "{} * 0.5 + 3.0"))
register("sobel_xx", lambda s, d: r6(neighbourhood.sobel(img8(s, d), S8, 2, 0)), separable_sql(kt([1, -2, 1]), kt([1, 2, 1]), "{}"))
register("scharr_x", lambda s, d: r6(neighbourhood.scharr(img8(s, d), S8, 1, 0)), separable_sql(kt([-1, 0, 1]), kt([3, 10, 3]), "{}"))
register("resize", lambda s, d: r6(neighbourhood.resize(img8(s, d), S8, 5, 12)), separable_sql(T.resize_taps(8, 12), T.resize_taps(8, 5), ROUND))
register("pyr_down", lambda s, d: r6(neighbourhood.pyr_down(img8(s, d), S8)[0]), separable_sql(T.half_taps(8), T.half_taps(8), ROUND))
register("pyr_up", lambda s, d: r6(neighbourhood.pyr_up(img8(s, d), S8)[0]), separable_sql(T.double_taps(8, by_source=True), T.double_taps(8), ROUND))


def linear_ctes(name: str, source: str, xs, ys, out: str = "{}") -> list[str]:
    """One linear filter after another: CTE ``name`` from CTE ``source``."""
    return [
        f"{name}_x(t, s, w) AS {values(xs)}",
        f"{name}_y(t, s, w) AS {values(ys)}",
        f"{name}_h AS (SELECT p.img, p.y, k.t AS x, p.c, sum(p.v * k.w) AS v FROM {source} p JOIN {name}_x k ON p.x = k.s GROUP BY p.img, p.y, k.t, p.c)",
        f"{name} AS (SELECT h.img, k.t AS y, h.x, h.c, {out.format('sum(h.v * k.w)')} AS v FROM {name}_h h JOIN {name}_y k ON h.y = k.s GROUP BY h.img, k.t, h.x, h.c)",
    ]


register(
    "build_pyramid",
    lambda s, d: r6(neighbourhood.build_pyramid(img8(s, d), S8, 2)),
    sql(" UNION ALL ".join(f"SELECT img, y, x, c, {s6('v')} AS v, {k} AS level FROM {n}" for k, n in enumerate(("img8", "p1", "p2"))), *linear_ctes("p1", "img8", T.half_taps(8), T.half_taps(8), ROUND), *linear_ctes("p2", "p1", T.half_taps(4), T.half_taps(4), ROUND)),
)
register("dct", lambda s, d: r6(neighbourhood.dct(img8f(s, d), S8)), separable_sql(T.dct_taps(8), T.dct_taps(8), "{}", "img8f"))
register("idct", lambda s, d: r6(neighbourhood.idct(neighbourhood.dct(img8f(s, d), S8), S8)), sql(f"SELECT img, y, x, c, {s6('v')} AS v FROM img8f"))
register("laplacian", lambda s, d: r6(neighbourhood.laplacian(img8(s, d), S8)), sql(
    f"SELECT p.img, p.y, p.x, p.c, {s6('n.v + s.v + w.v + e.v - 4 * p.v')} AS v FROM img8 p JOIN img8 n ON n.img = p.img AND n.x = p.x AND n.y = abs(p.y - 1) JOIN img8 s ON s.img = p.img AND s.x = p.x AND s.y = CASE WHEN p.y = 7 THEN 6 ELSE p.y + 1 END JOIN img8 w ON w.img = p.img AND w.y = p.y AND w.x = abs(p.x - 1) JOIN img8 e ON e.img = p.img AND e.y = p.y AND e.x = CASE WHEN p.x = 7 THEN 6 ELSE p.x + 1 END"
))
MIRROR = "m AS (SELECT i::INT AS i, o::INT AS o, CASE WHEN i + o < 0 THEN -(i + o) WHEN i + o > 7 THEN 14 - (i + o) ELSE i + o END AS s FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(-2, 3)) AS o))"
register("laplacian_3", lambda s, d: r6(neighbourhood.laplacian(img8(s, d), S8, 3)), sql(
    f"SELECT p.img, g.i AS y, h.i AS x, p.c, {s6('sum(p.v * (CASE h.o WHEN 0 THEN -2 ELSE 1 END * (2 - abs(g.o)) + CASE g.o WHEN 0 THEN -2 ELSE 1 END * (2 - abs(h.o))))')} AS v FROM img8 p JOIN m g ON p.y = g.s JOIN m h ON p.x = h.s WHERE abs(g.o) <= 1 AND abs(h.o) <= 1 GROUP BY ALL", MIRROR
))
register("median_blur", lambda s, d: neighbourhood.median_blur(img8(s, d), S8, 3), sql("SELECT p.img, g.i AS y, h.i AS x, p.c, median(p.v) AS v FROM img8 p JOIN m g ON p.y = g.s JOIN m h ON p.x = h.s WHERE abs(g.o) <= 1 AND abs(h.o) <= 1 GROUP BY ALL", MIRROR))
register(
    "bilateral_filter",
    lambda s, d: r6(neighbourhood.bilateral_filter(img8(s, d), S8, 5, 30.0, 2.0)),
    sql(
        f"SELECT img, y, x, c, {s6('sum(w * v) / sum(w)')} AS v FROM (SELECT p.img, g.i AS y, h.i AS x, p.c, p.v, exp(-(g.o * g.o + h.o * h.o) / 8.0) * exp(-(p.v - q.v) * (p.v - q.v) / 1800.0) AS w FROM img8 p JOIN m g ON p.y = g.s JOIN m h ON p.x = h.s JOIN img8 q ON q.img = p.img AND q.y = g.i AND q.x = h.i) GROUP BY img, y, x, c",
        MIRROR,
    ),
)
register("bilateral_constant", lambda s, d: r6(neighbourhood.bilateral_filter(rgb(s, d), Shape(8, 8, 3), 3, 30.0, 2.0, Border.CONSTANT)), sql(
    f"SELECT img, y, x, c, {s6('sum(w * v) / sum(w)')} AS v FROM (SELECT *, exp(-(dy * dy + dx * dx) / 8.0) * exp(-sum((v - v0) * (v - v0)) OVER (PARTITION BY img, y, x, dy, dx) / 1800.0) AS w FROM (SELECT p.img, p.y, p.x, p.c, p.v AS v0, dy, dx, coalesce(q.v, 0.0) AS v FROM rgb p JOIN (SELECT unnest([-1, 0, 1]) AS dy) ON true JOIN (SELECT unnest([-1, 0, 1]) AS dx) ON true LEFT JOIN rgb q ON q.img = p.img AND q.c = p.c AND q.y = p.y + dy AND q.x = p.x + dx)) GROUP BY img, y, x, c"
))
CROSS3 = T.structuring_element("cross", 3, 3)
RECT3 = T.structuring_element("rect", 3, 3)
for _n, _el, _cond in (("rect", RECT3, "abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1"), ("cross", CROSS3, "abs(p.y - q.y) + abs(p.x - q.x) <= 1")):
    for _op, _agg in (("erode", "min"), ("dilate", "max")):
        register(f"{_op}_{_n}", lambda s, d, e=_el, o=_op: getattr(neighbourhood, o)(img8(s, d), S8, e), sql(f"SELECT p.img, p.y, p.x, p.c, {_agg}(q.v) AS v FROM img8 p JOIN img8 q ON p.img = q.img AND {_cond} GROUP BY ALL"))


def morph_sql(first: str, then: str, out: str) -> str:
    near = "abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1"
    return sql(
        f"SELECT img, p.y, p.x, p.c, {out} AS v FROM img8 p JOIN f USING (img, y, x, c) JOIN t USING (img, y, x, c)",
        f"f AS (SELECT p.img, p.y, p.x, p.c, {first}(q.v) AS f FROM img8 p JOIN img8 q ON p.img = q.img AND {near} GROUP BY ALL)",
        f"t AS (SELECT p.img, p.y, p.x, p.c, {then}(q.f) AS t FROM f p JOIN f q ON p.img = q.img AND {near} GROUP BY ALL)",
    )


for _op, (_a, _b, _o) in {"open": ("min", "max", "t"), "close": ("max", "min", "t"), "tophat": ("min", "max", "p.v - t"), "blackhat": ("max", "min", "t - p.v")}.items():
    register(f"morphology_{_op}", lambda s, d, o=_op: neighbourhood.morphology_ex(img8(s, d), S8, o, RECT3), morph_sql(_a, _b, _o))
register("morphology_gradient", lambda s, d: neighbourhood.morphology_ex(img8(s, d), S8, "gradient", RECT3), sql("SELECT p.img, p.y, p.x, p.c, max(q.v) - min(q.v) AS v FROM img8 p JOIN img8 q ON p.img = q.img AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY ALL"))
DFT_SQL = """SELECT img, k AS y, l AS x, {c} AS c, {e} AS v FROM img8f p, (SELECT unnest(range(8))::INT AS k), (SELECT unnest(range(8))::INT AS l) GROUP BY img, k, l"""
register("dft", lambda s, d: r6(neighbourhood.dft(img8f(s, d), S8)), sql(
    DFT_SQL.format(c=0, e=s6("sum(v * cos(2 * pi() * (y * k + x * l) / 8))")) + " UNION ALL " + DFT_SQL.format(c=1, e=s6("-sum(v * sin(2 * pi() * (y * k + x * l) / 8))"))
))
register("idft", lambda s, d: r6(neighbourhood.idft(neighbourhood.dft(img8f(s, d), S8), S8)), sql(f"SELECT img, y, x, 0 AS c, {s6('v')} AS v FROM img8f UNION ALL SELECT img, y, x, 1 AS c, 0.0 AS v FROM img8f"))
register("optimal_dft_size", lambda s, d: small_table(s, [(n, neighbourhood.optimal_dft_size(n)) for n in range(1, 200)], "n int, size int"), """WITH p AS (SELECT (2 ** a * 3 ** b * 5 ** c)::INT AS v FROM (SELECT unnest(range(9)) AS a), (SELECT unnest(range(6)) AS b), (SELECT unnest(range(4)) AS c))
SELECT n::INT AS n, min(v) AS size FROM (SELECT unnest(range(1, 200)) AS n) JOIN p ON v >= n GROUP BY n""")

# ---- geometry and colour

register("rgb_to_gray", lambda s, d: geometry.cvt_color(rgb(s, d), "rgb2gray"), sql("SELECT img, y, x, 0 AS c, floor(round(sum(v * CASE c WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END), 9) + 0.5) AS v FROM rgb GROUP BY img, y, x"))
register("bgr_to_gray", lambda s, d: geometry.cvt_color(rgb(s, d), "bgr2gray"), sql("SELECT img, y, x, 0 AS c, floor(round(sum(v * CASE c WHEN 2 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END), 9) + 0.5) AS v FROM rgb GROUP BY img, y, x"))
RGBA = lambda s, d: rgb(s, d).unionByName(structural.moved(rgb(s, d).where("c = 0"), c=F.lit(3)))
register("rgba_to_gray", lambda s, d: geometry.cvt_color(RGBA(s, d), "rgba2gray"), SQL["rgb_to_gray"])
register("bgra_to_gray", lambda s, d: geometry.cvt_color(RGBA(s, d), "bgra2gray"), SQL["bgr_to_gray"])
for _o in ("rgb", "bgr", "rgba", "bgra"):
    register(f"gray_to_{_o}", lambda s, d, o=_o: geometry.cvt_color(img8(s, d), f"gray2{o}"), sql(f"SELECT img, y, x, k::INT AS c, CASE WHEN k = 3 THEN 255.0 ELSE v END AS v FROM img8, (SELECT unnest(range({len(_o)})) AS k)"))
WARP = [[0.9, 0.1, 0.5], [-0.1, 1.05, 0.25], [0.0, 0.0, 1.0]]
_I = geometry.invert3(WARP)
REMAP_SQL = """SELECT t.img, t.y, t.x, 0 AS c, {out} AS v FROM (SELECT i.img, m.y, m.x, (floor(m.my) + b)::INT AS sy, (floor(m.mx) + a)::INT AS sx,
    CASE WHEN a = 1 THEN m.mx - floor(m.mx) ELSE 1 - (m.mx - floor(m.mx)) END * CASE WHEN b = 1 THEN m.my - floor(m.my) ELSE 1 - (m.my - floor(m.my)) END AS w
    FROM (SELECT DISTINCT img FROM img8) i, m, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) t
    LEFT JOIN img8 p ON p.img = t.img AND p.y = t.sy AND p.x = t.sx GROUP BY t.img, t.y, t.x"""
register(
    "warp_perspective",
    lambda s, d: r6(geometry.warp_perspective(img8(s, d), S8, WARP, 7, 9, value=11.0)),
    sql(REMAP_SQL.format(out=s6("sum(w * coalesce(p.v, 11.0))")), f"m AS (SELECT y::INT AS y, x::INT AS x, x * {_I[0][0]!r}::DOUBLE + y * {_I[0][1]!r}::DOUBLE + {_I[0][2]!r}::DOUBLE AS mx, x * {_I[1][0]!r}::DOUBLE + y * {_I[1][1]!r}::DOUBLE + {_I[1][2]!r}::DOUBLE AS my FROM (SELECT unnest(range(7)) AS y), (SELECT unnest(range(9)) AS x))"),
)
PLACES = "(SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x)"


def swirl(s: SparkSession) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return geometry.places(s, 8, 8).select("y", "x", (x + 0.25 * y - 0.5).alias("map_x"), (y * 0.75 + 1.25).alias("map_y"))


register("remap_linear", lambda s, d: r6(geometry.remap(img8(s, d), S8, swirl(s))), sql(REMAP_SQL.format(out=s6("sum(w * coalesce(p.v, 0.0))")), f"m AS (SELECT y::INT AS y, x::INT AS x, x + 0.25 * y - 0.5 AS mx, y * 0.75 + 1.25 AS my FROM {PLACES})"))
register(
    "remap_nearest",
    lambda s, d: geometry.remap(img8(s, d), S8, swirl(s), "nearest", Border.REPLICATE),
    sql(f"SELECT p.img, m.y, m.x, 0 AS c, p.v FROM m JOIN img8 p ON p.y = least(7, greatest(0, round(my)::INT)) AND p.x = least(7, greatest(0, round(mx)::INT))", f"m AS (SELECT y::INT AS y, x::INT AS x, x + 0.25 * y - 0.5 AS mx, y * 0.75 + 1.25 AS my FROM {PLACES})"),
)
CAMERA = [[8.0, 0.0, 3.5], [0.0, 8.0, 3.5], [0.0, 0.0, 1.0]]
register(
    "undistort_map",
    lambda s, d: r6(geometry.undistort_map(s, CAMERA, [0.1, -0.02, 0.001, 0.002], CAMERA, 64, 64), "map_x", "map_y"),
    f"""SELECT y::INT AS y, x::INT AS x, {s6('(u * k + 2 * 0.001 * u * w + 0.002 * (r + 2 * u * u)) * 8 + 3.5')} AS map_x, {s6('(w * k + 0.001 * (r + 2 * w * w) + 2 * 0.002 * u * w) * 8 + 3.5')} AS map_y
    FROM (SELECT *, 1 + (-0.02 * r + 0.1) * r AS k FROM (SELECT *, u * u + w * w AS r FROM (SELECT *, (x - 3.5) / 8 AS u, (y - 3.5) / 8 AS w FROM (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x))))""",
)

# ---- algebra


def small(px: DataFrame, n: int) -> DataFrame:
    return px.where((F.col("y") < n) & (F.col("x") < n))


register("gemm", lambda s, d: r6(linalg.gemm(*pair(s, d), 0.5, pair(s, d)[0], 2.0, "b")), sql(f"SELECT p.img, p.y, p.x, p.c, {s6('g.v * 0.5 + 2 * p.v')} AS v FROM a p JOIN (SELECT a.img, a.y, b.y AS x, sum(a.v * b.v) AS v FROM a JOIN b ON a.img = b.img AND a.x = b.x GROUP BY ALL) g ON p.img = g.img AND p.y = g.y AND p.x = g.x"))
register("product_with", lambda s, d: r6(linalg.product_with(img8(s, d), METRIC)), sql(f"SELECT p.img, p.y, j::INT AS x, p.c, {s6('sum(p.v * CASE WHEN p.x = j THEN 2.0 WHEN abs(p.x - j) = 1 THEN 0.5 ELSE 0.0 END)')} AS v FROM img8 p, (SELECT unnest(range(8)) AS j) GROUP BY ALL"))
register(
    "cross",
    lambda s, d: linalg.cross(*[p.where("x = 0 and y < 3") for p in pair(s, d)]),
    sql("SELECT p.img, (6 - p.y - q.y) % 3 AS y, 0 AS x, 0 AS c, sum(CASE WHEN (q.y - p.y + 3) % 3 = 1 THEN p.v * q.v ELSE -p.v * q.v END) AS v FROM a p JOIN b q ON p.img = q.img AND p.y <> q.y WHERE p.x = 0 AND q.x = 0 AND p.y < 3 AND q.y < 3 GROUP BY ALL"),
)
_DET3 = "m00 * (m11 * m22 - m12 * m21) - m01 * (m10 * m22 - m12 * m20) + m02 * (m10 * m21 - m11 * m20)"
_PIVOT = "p AS (SELECT img, " + ", ".join(f"max(v) FILTER (y = {y} AND x = {x}) AS m{y}{x}" for y in range(3) for x in range(3)) + " FROM img8 GROUP BY img)"
register("determinant", lambda s, d: linalg.determinant(small(img8(s, d), 3), 3), sql(f"SELECT img, {_DET3} AS det FROM p", _PIVOT))


def regular(px: DataFrame) -> DataFrame:
    """Small square matrices, made well conditioned by a heavier diagonal."""
    return px.withColumn("v", val() + F.when(F.col("x") == F.col("y"), 4.0).otherwise(0.0))


REGULAR = "reg AS (SELECT img, y, x, c, v + CASE WHEN x = y THEN 4.0 ELSE 0.0 END AS v FROM img8f)"
#: Determinants by rows: d8 sums over sets of columns (bits of m) what the first rows give, with the sign of the permutation.
BY_ROWS = ["d0 AS (SELECT DISTINCT img, 0 AS m, 1.0::DOUBLE AS d FROM reg)"] + [f"d{k + 1} AS (SELECT p.img, p.m + (1 << r.x) AS m, sum(p.d * r.v * CASE WHEN bit_count(p.m >> r.x) % 2 = 0 THEN 1 ELSE -1 END) AS d FROM d{k} p JOIN reg r ON r.img = p.img AND r.y = {k} AND (p.m >> r.x) & 1 = 0 GROUP BY p.img, p.m + (1 << r.x))" for k in range(8)]
register("determinant_8", lambda s, d: r6(linalg.determinant(regular(img8f(s, d)), 8).withColumn("det", F.col("det") / 1000), "det"), sql(f"SELECT img, {s6('d / 1000')} AS det FROM d8", REGULAR, *BY_ROWS))
PERMS = "perm(p, sign) AS (VALUES " + ", ".join(f"({list(p)}, {1 if sum(p[i] > p[j] for i in range(4) for j in range(i + 1, 4)) % 2 == 0 else -1})" for p in itertools.permutations(range(4))) + ")"
INVERSE = [
    REGULAR,
    PERMS,
    "cells AS (SELECT img, list(v ORDER BY y, x) AS m FROM reg WHERE y < 4 AND x < 4 GROUP BY img)",
    "det AS (SELECT img, sum(sign * m[p[1] + 1] * m[p[2] + 5] * m[p[3] + 9] * m[p[4] + 13]) AS det FROM cells, perm GROUP BY img)",
    "inv AS (SELECT img, j AS y, i AS x, sum(sign * list_product(list_transform([1, 2, 3, 4], lambda r: CASE WHEN r = i + 1 THEN 1.0 ELSE m[p[r] + 4 * r - 3] END))) / any_value(det) AS v FROM cells JOIN det USING (img), perm, (SELECT unnest(range(4))::INT AS i), (SELECT unnest(range(4))::INT AS j) WHERE p[i + 1] = j GROUP BY img, j, i)",
]
register("invert", lambda s, d: r6(linalg.invert(regular(small(img8f(s, d), 4))), "v", "det"), sql(f"SELECT img, y, x, 0 AS c, {s6('v')} AS v, {s6('det')} AS det FROM inv JOIN det USING (img)", *INVERSE))
register("solve", lambda s, d: r6(linalg.solve(regular(small(img8f(s, d), 4)), small(img8(s, d), 4))), sql(f"SELECT b.img, i.y, b.x, 0 AS c, {s6('sum(i.v * b.v)')} AS v, true AS solved FROM inv i JOIN img8 b ON b.img = i.img AND b.y = i.x AND b.x < 4 GROUP BY b.img, i.y, b.x", *INVERSE))


def coefficients(s: SparkSession, d: str) -> DataFrame:
    """Sixteen rows of four numbers from each embedding."""
    parts = read(s, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("g"))
    return parts.select((F.col("vec_id") * 16 + F.col("g")).alias("vec_id"), *[F.col("embedding")[F.col("g") * 4 + k].cast("double").alias(f"k{k}") for k in range(4)])


FOURS = "fours AS (SELECT vec_id * 16 + g AS vec_id, embedding[4 * g + 1:4 * g + 4] AS embedding FROM embeddings, (SELECT unnest(range(16)) AS g))"


def root_rows(df: DataFrame) -> DataFrame:
    return r6(df.select("vec_id", F.posexplode("roots").alias("n", "root")), "root")


register(
    "solve_quadratic",
    lambda s, d: root_rows(coefficients(s, d).select("vec_id", linalg.quadratic_roots(F.col("k0"), F.col("k1"), F.col("k2")).alias("roots"))),
    f"""WITH {FOURS}, k AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM fours), q AS (SELECT *, sqrt(b * b - 4 * a * c) AS r FROM k WHERE b * b - 4 * a * c > 0 AND abs(a) >= 1e-12)
    SELECT vec_id, 0 AS n, {s6('least((-b - r) / (2 * a), (-b + r) / (2 * a))')} AS root FROM q UNION ALL SELECT vec_id, 1 AS n, {s6('greatest((-b - r) / (2 * a), (-b + r) / (2 * a))')} AS root FROM q""",
)
register("solve_cubic", lambda s, d: coefficients(s, d).select("vec_id", F.posexplode(linalg.cubic_roots(F.col("k0"), F.col("k1"), F.col("k2"), F.col("k3"))).alias("n", "root")).withColumn("root", F.round("root", 3) + 0.0), f"""WITH {FOURS}, k AS (SELECT vec_id, embedding[2]::DOUBLE / embedding[1]::DOUBLE AS p, embedding[3]::DOUBLE / embedding[1]::DOUBLE AS q, embedding[4]::DOUBLE / embedding[1]::DOUBLE AS r FROM fours WHERE abs(embedding[1]) >= 1e-12),
    u AS (SELECT *, (p * p - 3 * q) / 9 AS s, (2 * p * p * p - 9 * p * q + 27 * r) / 54 AS t FROM k),
    found AS (SELECT vec_id, CASE WHEN t * t < s * s * s THEN list_sort([-2 * sqrt(s) * cos((acos(t / sqrt(s * s * s)) + a * 2 * pi()) / 3) - p / 3 FOR a IN [0, 1, -1]]) ELSE [cbrt(sqrt(t * t - s * s * s) - t) + cbrt(-t - sqrt(t * t - s * s * s)) - p / 3] END AS roots FROM u)
    SELECT vec_id, n::INT - 1 AS n, round(roots[n], 3) + 0.0 AS root FROM (SELECT vec_id, roots, unnest(range(1, len(roots) + 1)) AS n FROM found)""")
register("solve_poly", lambda s, d: r6(linalg.solve_poly(read(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 5).alias("p")), "vec_id", "p"), "re", "im", "residual"))

# ---- features

GRADIENTS = "gr AS (SELECT p.img, g.i AS y, h.i AS x, sum(p.v * h.o * CASE WHEN g.o = 0 THEN 2 ELSE 1 END)::DOUBLE AS gx, sum(p.v * g.o * CASE WHEN h.o = 0 THEN 2 ELSE 1 END)::DOUBLE AS gy FROM img8 p JOIN m g ON p.y = g.s JOIN m h ON p.x = h.s WHERE abs(g.o) <= 1 AND abs(h.o) <= 1 GROUP BY p.img, g.i, h.i)"
TENSOR = "ten AS (SELECT p.img, g.i AS y, h.i AS x, sum(gx * gx) / 9 AS a, sum(gx * gy) / 9 AS b, sum(gy * gy) / 9 AS d FROM gr p JOIN m g ON p.y = g.s JOIN m h ON p.x = h.s WHERE abs(g.o) <= 1 AND abs(h.o) <= 1 GROUP BY p.img, g.i, h.i)"

for _name, _f in {
    "corner_harris": lambda s, d: features.corner_harris(img8(s, d), S8, 3),
    "corner_min_eigen_val": lambda s, d: features.corner_min_eigen_val(img8(s, d), S8, 3),
}.items():
    _e = "a * c2 - b * b - 0.04 * (a + c2) * (a + c2)" if "harris" in _name else "(a + c2) / 2 - sqrt((a - c2) * (a - c2) / 4 + b * b)"
    register(
        _name,
        lambda s, d, f=_f: r6(f(s, d)),
        sql(
            f"SELECT img, y, x, 0 AS c, {s6(_e)} AS v FROM (SELECT p.img, g.i AS y, h.i AS x, sum(gx * gx) / 9 AS a, sum(gx * gy) / 9 AS b, sum(gy * gy) / 9 AS c2 FROM gr p JOIN m g ON p.y = g.s JOIN m h ON p.x = h.s WHERE abs(g.o) <= 1 AND abs(h.o) <= 1 GROUP BY p.img, g.i, h.i)",
            MIRROR,
            GRADIENTS,
        ),
    )
register(
    "corner_eigen_vals_and_vecs",
    lambda s, d: r6(features.corner_eigen_vals_and_vecs(img8(s, d), S8, 3), "l1", "l2", "x1", "y1", "x2", "y2"),
    sql(
        f"""SELECT img, y, x, {s6('l1')} AS l1, {s6('l2')} AS l2, {s6('CASE WHEN flat THEN up ELSE (l1 - d) / sqrt((l1 - d) ** 2 + b * b) END')} AS x1, {s6('CASE WHEN flat THEN 1 - up ELSE b / sqrt((l1 - d) ** 2 + b * b) END')} AS y1,
        {s6('CASE WHEN flat THEN 1 - up ELSE (l2 - d) / sqrt((l2 - d) ** 2 + b * b) END')} AS x2, {s6('CASE WHEN flat THEN up ELSE b / sqrt((l2 - d) ** 2 + b * b) END')} AS y2
        FROM (SELECT *, abs(b) <= 1e-12 * (1 + a + d) AS flat, CASE WHEN a >= d THEN 1.0 ELSE 0.0 END AS up, (a + d) / 2 + sqrt((a - d) ** 2 / 4 + b * b) AS l1, (a + d) / 2 - sqrt((a - d) ** 2 / 4 + b * b) AS l2 FROM ten)""",
        MIRROR, GRADIENTS, TENSOR,
    ),
)
SECOND = "CASE {0}.o WHEN 0 THEN -2 ELSE 1 END"
register(
    "pre_corner_detect",
    lambda s, d: r6(features.pre_corner_detect(img8(s, d), S8)),
    sql(
        f"""SELECT img, y, x, c, {s6('gx * gx * yy + gy * gy * xx - 2 * gx * gy * xy')} AS v FROM (SELECT p.img, g.i AS y, h.i AS x, p.c, sum(p.v * h.o * (2 - abs(g.o)))::DOUBLE AS gx, sum(p.v * g.o * (2 - abs(h.o)))::DOUBLE AS gy, sum(p.v * g.o * h.o)::DOUBLE AS xy,
        sum(p.v * {SECOND.format('h')} * (2 - abs(g.o)))::DOUBLE AS xx, sum(p.v * {SECOND.format('g')} * (2 - abs(h.o)))::DOUBLE AS yy FROM img8 p JOIN m g ON p.y = g.s JOIN m h ON p.x = h.s WHERE abs(g.o) <= 1 AND abs(h.o) <= 1 GROUP BY p.img, g.i, h.i, p.c)""",
        MIRROR,
    ),
)
GOOD = [
    MIRROR, GRADIENTS, TENSOR,
    "resp AS (SELECT img, y, x, (a + d) / 2 - sqrt((a - d) ** 2 / 4 + b * b) AS v FROM ten)",
    "cand AS (SELECT p.img, p.y, p.x, p.v, row_number() OVER (PARTITION BY p.img ORDER BY p.v DESC, p.y, p.x) AS n FROM resp p JOIN (SELECT img, max(v) AS top FROM resp GROUP BY img) USING (img) WHERE p.v > 0.1 * top AND p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 AND NOT EXISTS (SELECT 1 FROM resp q WHERE q.img = p.img AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND q.v > p.v))",
    "taken AS (SELECT img, 0::BIGINT AS n, []::STRUCT(y INT, x INT, v DOUBLE)[] AS t FROM (SELECT DISTINCT img FROM cand) UNION ALL SELECT c.img, c.n, CASE WHEN len(t) < 4 AND len(list_filter(t, lambda o: (o.y - c.y) ** 2 + (o.x - c.x) ** 2 < 4)) = 0 THEN list_append(t, {'y': c.y, 'x': c.x, 'v': c.v}) ELSE t END FROM taken JOIN cand c ON c.img = taken.img AND c.n = taken.n + 1)",
    "best AS (SELECT img, max_by(t, n) AS t FROM taken GROUP BY img)",
]
register(
    "good_features_to_track",
    lambda s, d: r6(features.good_features_to_track(img8(s, d), S8, 4, 0.1, 2.0)),
    sql(f"SELECT img, t[k].x::DOUBLE AS x, t[k].y::DOUBLE AS y, {s6('t[k].v')} AS v, k::INT - 1 AS rank FROM (SELECT img, t, unnest(range(1, len(t) + 1)) AS k FROM best)", *GOOD).replace("WITH", "WITH RECURSIVE", 1),
)


def sub_pix_sql(rounds: int, win: int) -> str:
    """The corners (3, 3) and (4, 4) of each image, moved so many times by the weighted normal equations."""
    ctes = [MIRROR, GRADIENTS, "s0 AS (SELECT DISTINCT img, k AS id, (3 + k)::DOUBLE AS x, (3 + k)::DOUBLE AS y FROM img8, (SELECT unnest([0, 1]) AS k))"]
    for k in range(rounds):
        ctes += [
            f"e{k} AS (SELECT s.img, s.id, sum(w * gx * gx) AS a, sum(w * gx * gy) AS b, sum(w * gy * gy) AS d, sum(w * (gx * gx * g.x + gx * gy * g.y)) AS p, sum(w * (gx * gy * g.x + gy * gy * g.y)) AS q FROM (SELECT s.*, g.*, exp(-((g.x - round_even(s.x, 0)) ** 2 + (g.y - round_even(s.y, 0)) ** 2) / {float(win * win)}) AS w, s.img AS i FROM s{k} s JOIN gr g ON g.img = s.img AND abs(g.x - round_even(s.x, 0)) <= {win} AND abs(g.y - round_even(s.y, 0)) <= {win}) GROUP BY ALL)".replace("SELECT s.img, s.id, sum(w * gx * gx)", "SELECT img, id, sum(w * gx * gx)").replace("g.x + gx * gy * g.y", "px + gx * gy * py").replace("gx * gy * g.x + gy * gy * g.y", "gx * gy * px + gy * gy * py").replace("SELECT s.*, g.*,", "SELECT s.img, s.id, g.gx, g.gy, g.x AS px, g.y AS py,").replace(" AS w, s.img AS i FROM", " AS w FROM"),
            f"n{k} AS (SELECT img, id, (d * p - b * q) / (a * d - b * b) AS nx, (a * q - b * p) / (a * d - b * b) AS ny FROM e{k} WHERE abs(a * d - b * b) >= 1e-12)",
            f"s{k + 1} AS (SELECT img, id, CASE WHEN nx IS NULL OR abs(nx - x) > {win} OR abs(ny - y) > {win} THEN x ELSE nx END AS x, CASE WHEN nx IS NULL OR abs(nx - x) > {win} OR abs(ny - y) > {win} THEN y ELSE ny END AS y FROM s{k} LEFT JOIN n{k} USING (img, id))",
        ]
    return sql(f"SELECT img, id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM s{rounds}", *ctes)


def fixed_corners(s: SparkSession, d: str) -> DataFrame:
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(3.0 + k).alias("x"), F.lit(3.0 + k).alias("y")) for k in (0, 1)]))
    return many_images(s, d).select("img", both.alias("_c")).select("img", "_c.*")


register("corner_sub_pix", lambda s, d: features.corner_sub_pix(img8(s, d), S8, fixed_corners(s, d), 2, Criteria(2, 1e-3)).select("img", "id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")), sub_pix_sql(2, 2))
EDGES = [
    MIRROR, GRADIENTS,
    "mag AS (SELECT img, y, x, abs(gx) + abs(gy) AS v, CASE WHEN t < 0 THEN t + 180 ELSE t END AS t FROM (SELECT *, degrees(atan2(gy, gx)) AS t FROM gr))",
    "dir AS (SELECT img, y, x, v, CASE WHEN t < 22.5 OR t >= 157.5 THEN 0 WHEN t < 67.5 THEN 1 WHEN t < 112.5 THEN 2 ELSE 3 END AS s FROM mag WHERE v >= 100 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6)",
    "side(s, dy, dx) AS (VALUES (0, 0, -1), (0, 0, 1), (1, -1, 1), (1, 1, -1), (2, -1, 0), (2, 1, 0), (3, -1, -1), (3, 1, 1))",
    "thin AS (SELECT p.img, p.y, p.x, p.v >= 300 AS strong FROM dir p JOIN side USING (s) JOIN mag q ON q.img = p.img AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.img, p.y, p.x, p.v HAVING p.v >= max(q.v))",
]
register("canny_candidates", lambda s, d: features.canny_candidates(img8(s, d), S8, 100, 300), sql("SELECT img, y, x, strong FROM thin", *EDGES))
register(
    "canny",
    lambda s, d: features.canny(img8(s, d), S8, 100, 300),
    sql("SELECT p.img, p.y, p.x, p.c, CASE WHEN e.img IS NULL THEN 0.0 ELSE 255.0 END AS v FROM img8 p LEFT JOIN edge e ON e.img = p.img AND e.y = p.y AND e.x = p.x", *EDGES, "edge AS (SELECT img, y, x FROM thin WHERE strong UNION SELECT t.img, t.y, t.x FROM edge e JOIN thin t ON t.img = e.img AND abs(t.y - e.y) <= 1 AND abs(t.x - e.x) <= 1)").replace("WITH", "WITH RECURSIVE", 1),
)
register(
    "hough_lines",
    lambda s, d: r6(features.hough_lines(mask8(s, d), S8, 1.0, math.pi / 8, 4), "rho", "theta"),
    sql(
        f"""SELECT v.img, {s6('(v.r - 16.0)::DOUBLE')} AS rho, {s6('v.n * pi() / 8')} AS theta, v.votes FROM v LEFT JOIN v l ON l.img = v.img AND l.n = v.n AND l.r = v.r - 1 LEFT JOIN v h ON h.img = v.img AND h.n = v.n AND h.r = v.r + 1
        LEFT JOIN v p ON p.img = v.img AND p.n = v.n - 1 AND p.r = v.r LEFT JOIN v q ON q.img = v.img AND q.n = v.n + 1 AND q.r = v.r
        WHERE v.votes > 4 AND v.votes > coalesce(l.votes, 0) AND v.votes >= coalesce(h.votes, 0) AND v.votes > coalesce(p.votes, 0) AND v.votes >= coalesce(q.votes, 0)""",
        "v AS (SELECT img, n, (CASE WHEN t < 0 THEN -floor(0.5 - t) ELSE floor(t + 0.5) END)::INT + 16 AS r, count(*) AS votes FROM (SELECT img, n::INT AS n, round(x * cos(n * pi() / 8) + y * sin(n * pi() / 8), 6) AS t FROM img8, (SELECT unnest(range(8)) AS n) WHERE v > 127) GROUP BY ALL)",
    ),
)
register(
    "hough_lines_p",
    lambda s, d: segments.hough_lines_p(mask8(s, d), S8, 1.0, math.pi / 8, 4, 3, 1),
    sql(
        "SELECT img, x1, y1, x2, y2 FROM (SELECT img, arg_min(x, (a, b)) AS x1, arg_min(y, (a, b)) AS y1, arg_max(x, (a, b)) AS x2, arg_max(y, (a, b)) AS y2 FROM m WHERE taken GROUP BY k, img, n, r, run) WHERE greatest(abs(x2 - x1), abs(y2 - y1)) >= 3",
        "l AS (SELECT n::INT AS n, cos(n * pi() / 8) AS c, sin(n * pi() / 8) AS s, n BETWEEN 2 AND 6 AS flat FROM (SELECT unnest(range(8)) AS n))",
        """m AS (SELECT 0 AS k, img, y, x, 0 AS a, 0 AS b, 0 AS n, 0 AS r, 0::HUGEINT AS run, false AS taken FROM img8 WHERE v > 127
        UNION ALL SELECT k, img, y, x, a, b, n, r, run, bool_and(n = chosen) OVER (PARTITION BY img, n, r, run) FROM (
        SELECT *, arg_min(n, (-votes, n)) OVER (PARTITION BY img, y, x) AS chosen, sum(CASE WHEN a - before - 1 > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY img, n, r ORDER BY a, b) AS run FROM (
        SELECT *, lag(a) OVER (PARTITION BY img, n, r ORDER BY a, b) AS before FROM (SELECT *, count(*) OVER (PARTITION BY img, n, r) AS votes FROM (
        SELECT k + 1 AS k, img, y, x, CASE WHEN flat THEN x ELSE y END AS a, CASE WHEN flat THEN y ELSE x END AS b, n, (CASE WHEN t < 0 THEN -floor(0.5 - t) ELSE floor(t + 0.5) END)::INT AS r
        FROM (SELECT o.*, l.*, round(x * c + y * s, 6) AS t FROM (SELECT k, img, y, x FROM m GROUP BY k, img, y, x HAVING NOT bool_or(taken)) o, l))) WHERE votes >= 4)))""",
    ).replace("WITH", "WITH RECURSIVE", 1),
)
register(
    "hough_circles",
    lambda s, d: r6(features.hough_circles(img8(s, d), S8, 1.0, 2.0, 200.0, 4.0, 1, 3), "x", "y"),
    sql(
        "SELECT img, x::DOUBLE AS x, y::DOUBLE AS y, radius, votes FROM (SELECT *, row_number() OVER (PARTITION BY img, y, x ORDER BY n DESC, radius) AS k FROM radii) WHERE k = 1 AND n >= 2",
        MIRROR.replace("-(i + o)", "0").replace("14 - (i + o)", "7"),
        GRADIENTS,
        "edges AS (SELECT img, y, x, gx, gy, sqrt(gx * gx + gy * gy) AS steep FROM gr WHERE sqrt(gx * gx + gy * gy) > 200)",
        "places AS (SELECT img, round(y + r * gy / steep, 6) AS v, round(x + r * gx / steep, 6) AS u FROM edges, (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS r))",
        "votes AS (SELECT img, y, x, count(*)::DOUBLE AS v FROM (SELECT img, (sign(v) * floor(abs(v) + 0.5))::INT AS y, (sign(u) * floor(abs(u) + 0.5))::INT AS x FROM places) WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 GROUP BY ALL)",
        "cand AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v DESC, y, x) AS n FROM votes p WHERE v > 4 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND NOT EXISTS (SELECT 1 FROM votes q WHERE q.img = p.img AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND (q.y, q.x) <> (p.y, p.x) AND q.v >= p.v))",
        GOOD[-2].replace("len(t) < 4 AND ", ""),
        GOOD[-1],
        "kept AS (SELECT img, o.y AS y, o.x AS x, o.v AS votes FROM (SELECT img, unnest(t) AS o FROM best))",
        "radii AS (SELECT k.img, k.y, k.x, k.votes, floor(sqrt((e.y - k.y) ** 2 + (e.x - k.x) ** 2) + 0.5)::INT AS radius, count(*) AS n FROM kept k JOIN edges e ON e.img = k.img AND (e.y - k.y) ** 2 + (e.x - k.x) ** 2 BETWEEN 1 AND 9 GROUP BY ALL)",
    ).replace("WITH", "WITH RECURSIVE", 1),
)


def fast_sql(kind: str, nonmax: bool) -> str:
    ring, arc, margin = features.RINGS[kind]
    n = len(ring)
    found = f"SELECT img, y, x, response FROM (SELECT img, y, x, greatest(list_max([list_min(ring[s + 1:s + {arc}]) FOR s IN range({n})]), -list_min([list_max(ring[s + 1:s + {arc}]) FOR s IN range({n})])) - 1 AS response FROM (SELECT p.img, p.y, p.x, list(q.v - p.v ORDER BY k) || list(q.v - p.v ORDER BY k)[1:{arc - 1}] AS ring FROM img8 p JOIN o ON true JOIN img8 q ON q.img = p.img AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.y BETWEEN {margin} AND {7 - margin} AND p.x BETWEEN {margin} AND {7 - margin} GROUP BY ALL)) WHERE response >= 20"
    body = "SELECT img, y, x, response FROM f p" + (" WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.img = p.img AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND (q.y, q.x) <> (p.y, p.x) AND q.response >= p.response)" if nonmax else "")
    return sql(body, "o(k, dx, dy) AS (VALUES " + ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate(ring)) + ")", f"f AS ({found})")


for _kind, _nonmax in (("5_8", True), ("7_12", True), ("9_16", False)):
    register(f"fast_{_kind}", lambda s, d, k=_kind, n=_nonmax: features.fast(img8(s, d), S8, 20, nonmax=n, kind=k).select("img", "y", "x", "response"), fast_sql(_kind, _nonmax))


def mosaic(s: SparkSession, d: str) -> tuple[DataFrame, Shape]:
    """Images of 80 x 80: a hundred embeddings each, ten by ten; places without one are 0."""
    px = img8(s, d)
    tiles = px.select(F.floor(F.col("img") / 100).cast("long").alias("img"), (F.floor(F.col("img") % 100 / 10) * 8 + F.col("y")).cast("int").alias("y"), (F.col("img") % 10 * 8 + F.col("x")).cast("int").alias("x"), "c", F.col("v").alias("_v"))
    blank = pixels.grid(tiles.select("img").distinct(), Shape(80, 80))
    return blank.join(tiles, list(KEYS), "left").select(*KEYS, F.coalesce("_v", "v").alias("v")), Shape(80, 80)


MOSAIC = "mos AS (SELECT img // 100 AS img, (img % 100 // 10 * 8 + y)::INT AS y, (img % 10 * 8 + x)::INT AS x, c, v FROM img8)"


def middle(s: SparkSession, d: str) -> DataFrame:
    return mosaic(s, d)[0].select("img").distinct().withColumn("y", F.explode(F.array(F.lit(25), F.lit(40)))).withColumn("x", F.lit(40))


register("orb", lambda s, d: r6(features.orb(*mosaic(s, d), features=20, levels=2, edge=20), "x", "y", "angle", "response"))
DISC = "disc(dy, reach) AS (VALUES " + ", ".join(f"({dy}, {features.umax(15)[abs(dy)]})" for dy in range(-15, 16)) + ")"
register(
    "orb_orientation",
    lambda s, d: r6(features.orientation(mosaic(s, d)[0], middle(s, d)), "angle"),
    sql(f"SELECT img, y, x, {s6('CASE WHEN t < 0 THEN t + 360 ELSE t END')} AS angle FROM (SELECT k.img, k.y, k.x, degrees(atan2(sum(p.v * (p.y - k.y)), sum(p.v * (p.x - k.x)))) AS t FROM (SELECT DISTINCT img, u AS y, 40 AS x FROM mos, (SELECT unnest([25, 40]) AS u)) k JOIN disc ON true JOIN mos p ON p.img = k.img AND p.y = k.y + dy AND abs(p.x - k.x) <= reach GROUP BY k.img, k.y, k.x)", MOSAIC, DISC),
)
register("orb_patch", lambda s, d: small_table(s, [(h, v, w) for h in (7, 15, 31) for v, w in enumerate(features.umax(h))], "half int, row int, reach int"), "SELECT h::INT AS half, v::INT AS row, max(u)::INT AS reach FROM (SELECT unnest([7, 15, 31]) AS h), (SELECT unnest(range(32)) AS v), (SELECT unnest(range(32)) AS u) WHERE v <= h AND u <= h AND CASE WHEN v <= round(sqrt(h * h - v * v)) THEN u <= round(sqrt(h * h - v * v)) ELSE u <= round(sqrt(h * h - u * u)) AND v <= round(sqrt(h * h - u * u)) END GROUP BY h, v")


def overlap_pairs(s: SparkSession, d: str) -> DataFrame:
    k = keypoint_rows(s, d)
    other = k.select("img", (F.col("ord") - 1).alias("ord"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("size").alias("qs"))
    return k.join(other, ["img", "ord"]).select("img", "ord", features.overlap(F.col("px"), F.col("py"), F.col("size"), F.col("qx"), F.col("qy"), F.col("qs")).alias("overlap"))


register("keypoint_overlap", lambda s, d: r6(overlap_pairs(s, d), "overlap"), sql(
    f"""SELECT img, ord, {s6('''CASE WHEN least(r, t) + c <= greatest(r, t) THEN least(r, t) ** 2 / greatest(r, t) ** 2 WHEN c >= r + t THEN 0.0 ELSE
    (r * r * acos(u) - r * r * sin(acos(u)) * u + t * t * acos(w) - t * t * sin(acos(w)) * w) / ((r * r + t * t) * pi() - (r * r * acos(u) - r * r * sin(acos(u)) * u + t * t * acos(w) - t * t * sin(acos(w)) * w)) END''')} AS overlap
    FROM (SELECT *, greatest(-1.0, least(1.0, (r * r - t * t + c * c) / (2 * r * c))) AS u, greatest(-1.0, least(1.0, (t * t - r * r + c * c) / (2 * t * c))) AS w FROM (SELECT p.img, p.y * 8 + p.x AS ord, (p.v / 16 + 1) / 2 AS r, (q.v / 16 + 1) / 2 AS t, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS c FROM img8 p JOIN img8 q ON p.img = q.img AND p.y * 8 + p.x + 1 = q.y * 8 + q.x))"""
))


def as_keypoints(s: SparkSession, d: str) -> DataFrame:
    return features.convert_from_points(keypoint_rows(s, d).select("img", "ord", F.col("px").alias("x"), F.col("py").alias("y")), 7.0, 2.0)


register("convert_from_points", lambda s, d: as_keypoints(s, d).select("img", "ord", F.col("pt.x").cast("double").alias("x"), "size", "angle"), sql("SELECT img, y * 8 + x AS ord, x::DOUBLE AS x, 7.0::DOUBLE AS size, -1.0::DOUBLE AS angle FROM img8"))
register("convert_to_points", lambda s, d: features.convert_to_points(as_keypoints(s, d)), sql("SELECT img, y * 8 + x AS ord, x::FLOAT AS x, y::FLOAT AS y FROM img8"))
register("convert_to_points_masked", lambda s, d: features.convert_to_points_masked(as_keypoints(s, d), img8(s, d).where("v > 127").select("img", (F.col("y") * 8 + F.col("x")).alias("ord"))), sql("SELECT img, y * 8 + x AS ord, x::FLOAT AS x, y::FLOAT AS y FROM img8 WHERE v > 127"))


def marks(s: SparkSession, d: str) -> DataFrame:
    """A keypoint at each image's largest pixel, its size and angle from the smallest one's place."""
    at = reduce.min_max_loc(img8(s, d))
    return at.select("img", F.col("max_y").alias("y"), F.col("max_x").alias("x"), (F.col("min_y") + 1).cast("double").alias("size"), (F.col("min_x") * 45.0).alias("angle"))


LOC = "loc AS (SELECT img, arg_min(x, (v * 64 + y * 8 + x)) AS lx, arg_min(y, (v * 64 + y * 8 + x)) AS ly, arg_max(x, (v * 64 - y * 8 - x)) AS hx, arg_max(y, (v * 64 - y * 8 - x)) AS hy FROM {} GROUP BY img)"
register(
    "draw_keypoints",
    lambda s, d: features.draw_keypoints(img8(s, d), S8, marks(s, d), [255.0]),
    sql(
        "SELECT p.img, p.y, p.x, p.c, CASE WHEN d.img IS NULL THEN p.v ELSE 255.0 END AS v FROM img8 p LEFT JOIN (SELECT DISTINCT img, y, x FROM dots) d ON d.img = p.img AND d.y = p.y AND d.x = p.x",
        LOC.format("img8"),
        "k AS (SELECT img, hy AS y, hx AS x, lx * 45.0::DOUBLE AS angle, greatest(1, floor((ly + 1) / 2.0 + 0.5)::INT) AS r FROM loc)",
        "dots AS (SELECT img, round_even(y + r * sin(radians(a::DOUBLE)), 0)::INT AS y, round_even(x + r * cos(radians(a::DOUBLE)), 0)::INT AS x FROM k, (SELECT unnest(range(360)) AS a) UNION ALL SELECT img, round_even(y + s * sin(radians(angle)), 0)::INT, round_even(x + s * cos(radians(angle)), 0)::INT FROM k JOIN (SELECT unnest(range(9)) AS s) ON s <= r)",
    ),
)


def match_lines(s: SparkSession, d: str) -> DataFrame:
    """From the smallest pixel of an image to the largest of its partner."""
    a, b = (reduce.min_max_loc(p) for p in pair(s, d))
    return a.select("img", F.col("min_x").alias("x1"), F.col("min_y").alias("y1")).join(b.select("img", F.col("max_x").alias("x2"), F.col("max_y").alias("y2")), "img")


register(
    "draw_matches",
    lambda s, d: features.draw_matches(pair(s, d)[0], S8, pair(s, d)[1], S8, match_lines(s, d), [255.0]),
    sql(
        "SELECT p.img, p.y, p.x, p.c, CASE WHEN d.img IS NULL THEN p.v ELSE 255.0 END AS v FROM both_ p LEFT JOIN (SELECT DISTINCT img, y, x FROM dots) d ON d.img = p.img AND d.y = p.y AND d.x = p.x",
        "both_ AS (SELECT img, y, x, c, v FROM a UNION ALL SELECT img, y, x + 8, c, v FROM b)",
        LOC.format("a").replace("loc AS", "la AS"),
        LOC.format("b").replace("loc AS", "lb AS"),
        "line AS (SELECT img, la.lx AS x1, la.ly AS y1, lb.hx + 8 AS x2, lb.hy AS y2 FROM la JOIN lb USING (img))",
        "dots AS (SELECT img, round_even(y1 + (y2 - y1) * (s / n::DOUBLE), 0)::INT AS y, round_even(x1 + (x2 - x1) * (s / n::DOUBLE), 0)::INT AS x FROM (SELECT *, greatest(1, abs(x2 - x1), abs(y2 - y1)) AS n FROM line) JOIN (SELECT unnest(range(17)) AS s) ON s <= n)",
    ),
)

# ---- matching: every row whose id is divisible by 100 asks all rows but itself


def descriptors(s: SparkSession, d: str, binary: bool = False) -> DataFrame:
    e = read_table(s, d, "embeddings", spread=True)
    if not binary:
        return e.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("descriptor"))
    byte = lambda k: sum((F.when(F.col("embedding")[8 * k + j] > 0, 1 << j).otherwise(0) for j in range(8)), F.lit(0))
    return e.select(F.col("vec_id").alias("idx"), F.array(*[byte(k) for k in range(8)]).alias("descriptor"))


def asking(df: DataFrame) -> DataFrame:
    return df.where(F.col("idx") % 100 == 0)


DIST = "dist AS (SELECT q.vec_id AS query_idx, t.vec_id AS train_idx, list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings t WHERE q.vec_id % 100 = 0 {})"
APART = "AND t.vec_id <> q.vec_id"
register("knn_match", lambda s, d: r6(matching.knn_match(asking(descriptors(s, d)), descriptors(s, d), 3), "distance"), f"WITH {DIST.format('')} SELECT query_idx, row_number() OVER (PARTITION BY query_idx ORDER BY distance, train_idx)::INT AS rank, train_idx, {s6('distance')} AS distance FROM dist QUALIFY rank <= 3")
register("match_l2", lambda s, d: r6(matching.match_descriptors(asking(descriptors(s, d)), descriptors(s, d), apart=True), "distance"), f"WITH {DIST.format(APART)} SELECT query_idx, train_idx, {s6('distance')} AS distance FROM dist QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY distance, train_idx) = 1")
register(
    "match_cross_check",
    lambda s, d: r6(matching.match_descriptors(asking(descriptors(s, d)), descriptors(s, d), cross_check=True, apart=True), "distance"),
    f"WITH {DIST.format(APART)} SELECT query_idx, train_idx, {s6('distance')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY distance, train_idx) AS r1, row_number() OVER (PARTITION BY train_idx ORDER BY distance, query_idx) AS r2 FROM dist) WHERE r1 = 1 AND r2 = 1",
)
register(
    "match_hamming",
    lambda s, d: matching.match_descriptors(asking(descriptors(s, d, True)), descriptors(s, d, True), "hamming", apart=True),
    "WITH dist AS (SELECT q.vec_id AS query_idx, t.vec_id AS train_idx, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] > 0) <> (t.embedding[i] > 0) THEN 1 ELSE 0 END))::DOUBLE AS distance FROM embeddings q, embeddings t WHERE q.vec_id % 100 = 0 AND t.vec_id <> q.vec_id) SELECT query_idx, train_idx, distance FROM dist QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY distance, train_idx) = 1",
)
register(
    "ratio_test",
    lambda s, d: r6(matching.filter_matches(matching.knn_match(asking(descriptors(s, d)), descriptors(s, d), 2, apart=True), 0.95), "distance"),
    f"WITH {DIST.format(APART)}, k AS (SELECT *, row_number() OVER w AS rank, lead(distance) OVER w AS nxt FROM dist WINDOW w AS (PARTITION BY query_idx ORDER BY distance, train_idx)) SELECT query_idx, train_idx, {s6('distance')} AS distance FROM k WHERE rank = 1 AND distance < 0.95 * nxt",
)


def neighbour_pairs(s: SparkSession, d: str, binary: bool) -> DataFrame:
    e = descriptors(s, d, binary)
    return e.join(e.select((F.col("idx") - 1).alias("idx"), F.col("descriptor").alias("other")), "idx")


register("compute_distance_l2", lambda s, d: r6(matching.compute_distance(neighbour_pairs(s, d, False), "descriptor", "other").select("idx", "distance"), "distance"), f"SELECT a.vec_id AS idx, {s6('list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])')} AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
register("compute_distance_hamming", lambda s, d: matching.compute_distance(neighbour_pairs(s, d, True), "descriptor", "other", "hamming").select("idx", "distance"), "SELECT a.vec_id AS idx, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a.embedding[i] > 0) <> (b.embedding[i] > 0) THEN 1 ELSE 0 END))::DOUBLE AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")

# ---- clusters, models, random numbers, tracking


def cluster_points(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("p"))


def first_centres(s: SparkSession, d: str) -> list[list[float]]:
    return [list(r["p"]) for r in cluster_points(s, d).where("id < 4").orderBy("id").collect()]


register(
    "kmeans_assign",
    lambda s, d: r6(cluster.assign(cluster_points(s, d), first_centres(s, d)).select("id", "label", "d2"), "d2"),
    f"SELECT id, label, {s6('d2')} AS d2 FROM (SELECT p.vec_id AS id, c.vec_id::INT AS label, list_sum(list_transform(list_zip(p.embedding::DOUBLE[], c.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM embeddings p, embeddings c WHERE c.vec_id < 4) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, label) = 1",
)

def given_labels(df: DataFrame) -> DataFrame:
    return df.select("id", (F.col("id") % 4).cast("int").alias("label"))


def lloyd_sql(rounds: int) -> str:
    """Rounds of means and assignments from given labels, and the last assignment."""
    ctes = ["p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS p FROM embeddings)", "a0 AS (SELECT id, p, (id % 4)::INT AS label FROM p)"]
    for n in range(rounds + 1):
        ctes.append(f"m{n} AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(p[i]) AS m FROM a{n}, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)")
        ctes.append(f"a{n + 1} AS (SELECT id, p, label, list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM p, m{n} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, label) = 1)")
    return f"WITH {', '.join(ctes)} SELECT id, label, {s6('d2')} AS d2 FROM a{rounds + 1}"


register(
    "kmeans_given",
    lambda s, d: r6(cluster.kmeans(cluster_points(s, d), 4, Criteria(2, 0.0), initial=given_labels(cluster_points(s, d)))[0].select("id", "label", "d2"), "d2"),
    lloyd_sql(2),
)
register("kmeans", lambda s, d: r6(cluster.kmeans(cluster_points(s, d), 4, Criteria(5, 1e-4))[0].select("id", "label", "d2"), "d2"))


def groups(key: str = "l_orderkey") -> Column:
    """Parts of lineitem: as many as the data has thousands of orders."""
    return F.floor(F.col(key) / 1000).cast("long").alias("group")


OUTLIER = "(l_orderkey + 3 * l_linenumber) % 10 = 0"


def correspondences(s: SparkSession, d: str, outliers: bool = False) -> DataFrame:
    """Points of each part of lineitem under one known map; with an outlier in each ten, if asked for."""
    p = line_points(s, d).select(groups(), F.col("x").alias("ax"), F.col("y").alias("ay"), "l_orderkey", "l_linenumber")
    w = 0.001 * F.col("ax") + 0.002 * F.col("ay") + 1
    off = F.when(F.expr(OUTLIER), 40.0 + F.col("l_orderkey") % 17).otherwise(0.0) if outliers else F.lit(0.0)
    return p.select("group", "l_orderkey", "l_linenumber", "ax", "ay", ((1.1 * F.col("ax") + 0.2 * F.col("ay") + 3) / w + off).alias("bx"), ((-0.1 * F.col("ax") + 0.9 * F.col("ay") + 5) / w).alias("by"))


def model_rows(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select("group", "n_points", F.posexplode("model").alias("cell", "value")).withColumn("value", F.round("value", places) + 0.0)


def model_sql(model: list[float], places: int = 4) -> str:
    return f"SELECT g AS \"group\", n AS n_points, i::INT AS cell, round(({[float(v) for v in model]}::DOUBLE[])[i + 1], {places}) + 0.0 AS value FROM (SELECT (l_orderkey // 1000)::BIGINT AS g, count(*) AS n FROM lineitem GROUP BY ALL), (SELECT unnest(range({len(model)})) AS i)"


KNOWN_MAP = [1.1, 0.2, 3.0, -0.1, 0.9, 5.0, 0.001, 0.002, 1.0]
register("homography_dlt", lambda s, d: model_rows(estimation.find_homography(correspondences(s, d))), model_sql(KNOWN_MAP))
register("homography_ransac", lambda s, d: model_rows(estimation.find_homography(correspondences(s, d, True), "ransac", 1.0, 200)), model_sql(KNOWN_MAP))


def inlier_rows(s: SparkSession, d: str) -> DataFrame:
    points = correspondences(s, d, True)
    return estimation.inlier_mask(points, estimation.find_homography(points, "ransac", 1.0, 200), "homography", 1.0).select("l_orderkey", "l_linenumber", "inlier")


register("homography_inliers", inlier_rows, f"SELECT l_orderkey, l_linenumber, NOT ({OUTLIER}) AS inlier FROM lineitem")
VIEW = [[800.0, 0.0, 320.0], [0.0, 800.0, 240.0], [0.0, 0.0, 1.0]]
POSE = [0.1, -0.2, 0.05, 0.1, -0.1, 6.0]


LENS = (-0.2, 0.05, 0.001, -0.002, 0.01)


def scene(s: SparkSession, d: str, outliers: bool = False, planes: bool = False, lens: tuple[float, ...] = ()) -> DataFrame:
    """Points in space from lineitem, and where a turned and moved camera sees them; ``planes``: in each odd group in a plane."""
    p = read(s, d, "lineitem").select(groups(), "l_orderkey", "l_linenumber", (F.col("l_quantity") / 25.0 - 1).cast("double").alias("x"), (F.col("l_discount") * 10 - 0.5).cast("double").alias("y"), (F.col("l_extendedprice") / 50000.0 - 1).cast("double").alias("z"))
    if planes:
        p = p.withColumn("z", F.when(F.col("group") % 2 == 1, 0.3 * F.col("x") - 0.2 * F.col("y") + 0.1).otherwise(F.col("z")))
    m = estimation.rodrigues_matrix(*[F.lit(v) for v in POSE[:3]])
    x, y, z = (m[3 * k] * F.col("x") + m[3 * k + 1] * F.col("y") + m[3 * k + 2] * F.col("z") + t for k, t in enumerate(POSE[3:]))
    off = F.when(F.expr(OUTLIER), 60.0 + F.col("l_orderkey") % 17).otherwise(0.0) if outliers else F.lit(0.0)
    u, v = estimation.Camera(np.array(VIEW), lens).pixels(x / z, y / z)
    return p.select("*", (u + off).alias("u"), (v + off).alias("v"))


def stereo(s: SparkSession, d: str, outliers: bool = False) -> DataFrame:
    """The same points seen straight from the front, and by that camera."""
    seen = scene(s, d, outliers)
    return seen.select("group", (F.col("x") / (F.col("z") + 6) * 800 + 320).alias("ax"), (F.col("y") / (F.col("z") + 6) * 800 + 240).alias("ay"), F.col("u").alias("bx"), F.col("v").alias("by"))


def known_fundamental() -> list[float]:
    """From the two poses of ``stereo``: epipolar lines of the second view for points of the first."""
    k, r = np.linalg.inv(np.array(VIEW)), estimation.rotation(np.array(POSE[:3]))
    t = np.array(POSE[3:]) - r @ np.array([0.0, 0.0, 6.0])
    f = k.T @ np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r @ k
    return (f / f[2, 2]).ravel().tolist()


register("fundamental", lambda s, d: model_rows(estimation.find_fundamental_mat(stereo(s, d)), 6), model_sql(known_fundamental(), 6))
register("fundamental_ransac", lambda s, d: model_rows(estimation.find_fundamental_mat(stereo(s, d, True), "ransac", 0.5, 0.9999, 400), 6), model_sql(known_fundamental(), 6))
register("solve_pnp", lambda s, d: model_rows(estimation.solve_pnp(scene(s, d), VIEW)), model_sql(POSE))
register("solve_pnp_planes", lambda s, d: model_rows(estimation.solve_pnp(scene(s, d, planes=True), VIEW)), model_sql(POSE))
register("solve_pnp_lens", lambda s, d: model_rows(estimation.solve_pnp(scene(s, d, lens=LENS), VIEW, lens=LENS)), model_sql(POSE))
register("solve_pnp_ransac_planes_lens", lambda s, d: model_rows(estimation.solve_pnp(scene(s, d, True, True, LENS), VIEW, "ransac", 100, lens=LENS)), model_sql(POSE))
register("solve_pnp_ransac", lambda s, d: model_rows(estimation.solve_pnp(scene(s, d, True), VIEW, "ransac", 100)), model_sql(POSE))


def guessed(s: SparkSession, d: str) -> DataFrame:
    points = scene(s, d)
    return estimation.solve_pnp(points, VIEW, guess=points.select("group").distinct().withColumn("model", F.array(*[F.lit(v + 0.05) for v in POSE])))


register("solve_pnp_guess", lambda s, d: model_rows(guessed(s, d)), model_sql(POSE))


def _line(p, df):
    return p[0] + p[1] * df["x"].to_numpy() - df["y"].to_numpy()


register(
    "lm_fit",
    lambda s, d: estimation.lm_fit(read(s, d, "lineitem").select(groups(), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).cast("double").alias("y")), [0.0, 0.0], _line).select("group", F.round(F.col("model")[0], 3).alias("intercept"), F.round(F.col("model")[1], 3).alias("slope")),
    "SELECT (l_orderkey // 1000)::BIGINT AS \"group\", round(regr_intercept(l_extendedprice / 1000, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice / 1000, l_quantity), 3) AS slope FROM lineitem GROUP BY ALL",
)
register(
    "rodrigues",
    lambda s, d: r6(coefficients(s, d).select("vec_id", F.posexplode(F.array(*estimation.rodrigues_matrix(F.col("k0"), F.col("k1"), F.col("k2")))).alias("cell", "value")), "value"),
    f"""WITH {FOURS}, k AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM fours), t AS (SELECT *, sqrt(a * a + b * b + c * c) AS t FROM k), u AS (SELECT vec_id, [a / t, b / t, c / t] AS u, [0.0, -c / t, b / t, c / t, 0.0, -a / t, -b / t, a / t, 0.0] AS w, cos(t) AS co, sin(t) AS si FROM t)
    SELECT vec_id, i::INT AS cell, {s6('CASE WHEN i % 4 = 0 THEN co ELSE 0.0 END + (1 - co) * u[i // 3 + 1] * u[i % 3 + 1] + si * w[i + 1]')} AS value FROM u, (SELECT unnest(range(9)) AS i)""",
)
register(
    "rodrigues_vector",
    lambda s, d: r6(coefficients(s, d).select("vec_id", F.array(*estimation.rodrigues_matrix(F.col("k0"), F.col("k1"), F.col("k2"))).alias("m")).select("vec_id", F.posexplode(F.array(*estimation.rodrigues_vector([F.col("m")[k] for k in range(9)]))).alias("n", "value")), "value"),
    f"WITH {FOURS} SELECT vec_id, n::INT AS n, {s6('embedding[n + 1]::DOUBLE')} AS value FROM fours, (SELECT unnest(range(3)) AS n)",
)
PERIOD = random.PERIOD


def stream_sql(seed: int, draws: int) -> str:
    """w(img, k, lo, hi): the words of each image's k-th state, by powers of the multiplier."""
    powers = ", ".join(f"({k}, {pow(random.MULTIPLIER, k, PERIOD)}::UHUGEINT)" for k in range(1, draws + 1))
    return f"w AS MATERIALIZED (SELECT img, k, (st % 4294967296)::BIGINT AS lo, (st // 4294967296)::BIGINT AS hi FROM (SELECT vec_id::BIGINT AS img, p.k, (({seed}::UHUGEINT + vec_id::UHUGEINT * {random.STREAM}::UHUGEINT) % 18446744073709551616::UHUGEINT) % {PERIOD}::UHUGEINT * p.a % {PERIOD}::UHUGEINT AS st FROM embeddings, (VALUES {powers}) p(k, a)))"


AT24 = "(i // 8)::INT AS y, (i // 2 % 4)::INT AS x, (i % 2)::INT AS c"
register(
    "randu",
    lambda s, d: r6(random.randu(many_images(s, d), S342, [0.0, 5.0], [1.0, 9.0], 3)),
    f"""WITH {stream_sql(3, 24)} SELECT img, {AT24}, {s6('(CASE WHEN lo >= 2147483648 THEN lo - 4294967296 ELSE lo END * 4294967296.0::DOUBLE + hi) * 5.421010862427522e-20 * CASE i % 2 WHEN 0 THEN 1.0 ELSE 4.0 END + CASE i % 2 WHEN 0 THEN 0.5 ELSE 7.0 END')} AS v FROM (SELECT *, k - 1 AS i FROM w)""",
)
register(
    "randu_u8",
    lambda s, d: random.randu(many_images(s, d), S342, [0, 0], [256, 16], 3, "u8"),
    f"""WITH {stream_sql(3, 6)} SELECT img, {AT24}, (((lo >> (8 * j)) & 255) & CASE i % 2 WHEN 0 THEN 255 ELSE 15 END)::DOUBLE AS v FROM (SELECT *, 4 * (k - 1) + j AS i FROM w, (SELECT unnest(range(4)) AS j))""",
)
register(
    "randu_i32",
    lambda s, d: random.randu(many_images(s, d), S342, [-5, 100], [5, 1100], 3, "i32"),
    f"""WITH {stream_sql(3, 24)} SELECT img, {AT24}, (lo % CASE i % 2 WHEN 0 THEN 10 ELSE 1000 END + CASE i % 2 WHEN 0 THEN -5 ELSE 100 END)::DOUBLE AS v FROM (SELECT *, k - 1 AS i FROM w)""",
)
register("randn", lambda s, d: random.randn(many_images(s, d), S342, [0.0, 5.0], [1.0, 2.0], 3))
register("randu_xoshiro", lambda s, d: r6(random.randu(many_images(s, d), S342, [0.0, 5.0], [1.0, 9.0], 3, generator="xoshiro")))
register("randn_xoshiro", lambda s, d: r6(random.randn(many_images(s, d), S342, [0.0, 5.0], [1.0, 2.0], 3, generator="xoshiro")))
register(
    "rand_shuffle",
    lambda s, d: random.rand_shuffle(img8(s, d), 5),
    sql(
        "SELECT f.img, (n // 8)::INT AS y, (n % 8)::INT AS x, 0 AS c, p.v FROM back f JOIN img8 p ON p.img = f.img AND p.y * 8 + p.x = f.p WHERE f.k = 0",
        stream_sql(5, 64),
        "back AS (SELECT img, n, 64 AS k, n AS p FROM (SELECT DISTINCT img FROM img8), (SELECT unnest(range(64)) AS n) UNION ALL SELECT b.img, b.n, b.k - 1, CASE b.p WHEN b.k - 1 THEN w.lo % 64 WHEN w.lo % 64 THEN b.k - 1 ELSE b.p END FROM back b JOIN w ON w.img = b.img AND w.k = b.k)",
    ).replace("WITH", "WITH RECURSIVE", 1),
)


def tracked(s: SparkSession, d: str, kept: bool = False) -> DataFrame:
    """Points of each mosaic, found again in the mosaic moved by one pixel; ``kept``: with pyramids made before."""
    px, shape = mosaic(s, d)
    moved = px.withColumn("x", (F.col("x") + 79) % 80)
    a, b = (neighbourhood.gaussian_blur(p, shape, (9, 9), 2.5) for p in (px, moved))
    spots = [(k, x, y) for k, (x, y) in enumerate((x, y) for x in (20.0, 40.0, 60.0) for y in (20.0, 40.0, 60.0))]
    points = px.select("img").distinct().withColumn("_p", F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, x, y in spots]))).select("img", "_p.*")
    if kept:
        before, after = (flow.build_optical_flow_pyramid(p, shape, (15, 15), 1) for p in (a, b))
        return flow.track_with_pyramids(before, after, points, (15, 15), Criteria(6, 0.01))
    return flow.calc_optical_flow_pyramid_lk(a, b, shape, points, (15, 15), 1, Criteria(6, 0.01))


for _name, _kept in (("optical_flow_lk", False), ("optical_flow_with_pyramids", True)):
    register(_name, lambda s, d, k=_kept: tracked(s, d, k).select("img", "id", "status", F.round("x", 1).alias("x"), F.round("y", 1).alias("y")))
register(
    "optical_flow_pyramid",
    lambda s, d: r6(flow.build_optical_flow_pyramid(img8(s, d), S8, (3, 3), 1)[1]["dx"]),
    sql(f"SELECT img, y, x, c, {s6('v')} AS v FROM dx", *linear_ctes("half", "img8", T.half_taps(8), T.half_taps(8), ROUND), *linear_ctes("dx", "half", kt([-1, 0, 1], Border.CONSTANT, 4), kt([3, 10, 3], Border.CONSTANT, 4))),
)
register("structuring_element", lambda s, d: small_table(s, [(k, dy, dx) for k in ("rect", "cross", "ellipse") for dy, dx in T.structuring_element(k, 5, 7)], "kind string, dy int, dx int"), """SELECT kind, dy::INT AS dy, dx::INT AS dx FROM (SELECT unnest(['rect', 'cross', 'ellipse']) AS kind), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)
WHERE CASE kind WHEN 'rect' THEN true WHEN 'cross' THEN dx = 0 OR dy = 0 ELSE abs(dx) <= floor(3 * sqrt((4 - dy * dy) / 4.0)) END""")
register("sobel_kernels", lambda s, d: small_table(s, [(n, o, k, w) for n in (3, 5) for o in (0, 1, 2) for k, w in enumerate(T.sobel_kernels(n, o, 0)[0])], "size int, n int, k int, w double"), """SELECT size, n, k::INT AS k, w::DOUBLE AS w FROM (VALUES (3, 0, [1, 2, 1]), (3, 1, [-1, 0, 1]), (3, 2, [1, -2, 1]), (5, 0, [1, 4, 6, 4, 1]), (5, 1, [-1, -2, 0, 2, 1]), (5, 2, [1, 0, -2, 0, 1])) t(size, n, l), unnest(l) WITH ORDINALITY AS u(w, j), LATERAL (SELECT j - 1 AS k)""")
register("border_interpolate", lambda s, d: small_table(s, [(b.name.lower(), p, T.border_index(p, 5, b)) for b in (Border.CONSTANT, Border.REPLICATE, Border.REFLECT, Border.WRAP, Border.REFLECT_101) for p in range(-4, 9)], "border string, p int, at int"), """SELECT border, p::INT AS p, (CASE WHEN p BETWEEN 0 AND 4 THEN p WHEN border = 'constant' THEN -1 WHEN border = 'replicate' THEN CASE WHEN p < 0 THEN 0 ELSE 4 END WHEN border = 'wrap' THEN (p + 5) % 5
WHEN border = 'reflect' THEN CASE WHEN p < 0 THEN -p - 1 ELSE 9 - p END ELSE CASE WHEN p < 0 THEN -p ELSE 8 - p END END)::INT AS at FROM (SELECT unnest(['constant', 'replicate', 'reflect', 'wrap', 'reflect_101']) AS border), (SELECT unnest(range(-4, 9)) AS p)""")
register("gaussian_kernel", lambda s, d: r6(small_table(s, list(enumerate(T.gaussian_kernel(7, 1.5))), "i int, v double")), f"SELECT i::INT AS i, {s6('exp(-(i - 3) * (i - 3) / 4.5) / sum(exp(-(i - 3) * (i - 3) / 4.5)) OVER ()')} AS v FROM (SELECT unnest(range(7)) AS i)")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Mutual nearest neighbours of the asking descriptors that also pass the ratio test."""
    q, t = asking(descriptors(spark, d)), descriptors(spark, d)
    two = durable(matching.knn_match(q, t, 2, apart=True))
    return matching.mutual(matching.filter_matches(two, 0.999), q, t, apart=True)


register(
    "flagship",
    lambda s, d: r6(flagship(s, d), "distance"),
    f"WITH {DIST.format(APART)} SELECT query_idx, train_idx, {s6('distance')} AS distance FROM (SELECT *, row_number() OVER w AS r1, lead(distance) OVER w AS nxt, row_number() OVER (PARTITION BY train_idx ORDER BY distance, query_idx) AS r2 FROM dist WINDOW w AS (PARTITION BY query_idx ORDER BY distance, train_idx)) WHERE r1 = 1 AND r2 = 1 AND distance < 0.999 * nxt",
)



# ---- small values and streams


def vector_rows(s: SparkSession, d: str) -> DataFrame:
    """Eight pairs of 4-vectors from each embedding."""
    cut = lambda at: F.transform(F.slice("embedding", at, 4), lambda v: F.when(v.cast("double") > 0.2, 0.0).otherwise(v.cast("double")))
    parts = read(s, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("g"))
    return parts.select((F.col("vec_id") * 8 + F.col("g")).alias("vec_id"), cut(F.col("g") * 8 + 1).alias("p"), cut(F.col("g") * 8 + 5).alias("q"))


def vector_query(f):
    return lambda s, d: r6(vector_rows(s, d).select("vec_id", F.posexplode(f(F.col("p"), F.col("q"))).alias("k", "v")))


PQ = "WITH r AS (SELECT vec_id * 8 + g AS vec_id, k::INT AS k, CASE WHEN embedding[8 * g + k + 1]::DOUBLE > 0.2 THEN 0.0 ELSE embedding[8 * g + k + 1]::DOUBLE END AS p, CASE WHEN embedding[8 * g + k + 5]::DOUBLE > 0.2 THEN 0.0 ELSE embedding[8 * g + k + 5]::DOUBLE END AS q FROM embeddings, (SELECT unnest(range(8)) AS g), (SELECT unnest(range(4)) AS k))"
for _name, _e in (("add", "p + q"), ("subtract", "p - q"), ("multiply", "p * q"), ("divide", "CASE WHEN q = 0 THEN 0.0 ELSE p / q END")):
    register(f"vector_{_name}", vector_query(getattr(vectors, _name)), f"{PQ} SELECT vec_id, k, {s6(_e)} AS v FROM r")
register("vector_dot", lambda s, d: r6(vector_rows(s, d).select("vec_id", vectors.dot(F.col("p"), F.col("q")).alias("v"))), f"{PQ} SELECT vec_id, {s6('sum(p * q)')} AS v FROM r GROUP BY vec_id")


def rects(s: SparkSession, d: str) -> DataFrame:
    r = vectors.rect(F.col("p_partkey"), F.col("p_partkey") * 2, F.col("p_size"), F.col("p_size") + 3)
    return read(s, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", vectors.area(F.col("r")).alias("area"), vectors.bottom_right(F.col("r"))["x"].alias("right"), vectors.bottom_right(F.col("r"))["y"].alias("bottom"))


register("rect_helpers", rects, 'SELECT p_partkey, p_size * (p_size + 3) AS area, p_partkey + p_size AS "right", p_partkey * 2 + p_size + 3 AS bottom FROM part')
register("rotated_rect", lambda s, d: read(s, d, "part").select("p_partkey", vectors.rotated_rect(F.col("p_partkey") * 1.0, F.col("p_size") * 2.0, F.col("p_size") * 1.0, F.col("p_size") + 1.0, (F.col("p_partkey") % 360) * 1.0).alias("r")).select("p_partkey", F.col("r.center.x").alias("cx"), F.col("r.center.y").alias("cy"), vectors.area(F.col("r.size")).alias("area"), F.col("r.angle").alias("angle")), "SELECT p_partkey, p_partkey::DOUBLE AS cx, p_size * 2.0::DOUBLE AS cy, (p_size * (p_size + 1))::DOUBLE AS area, (p_partkey % 360)::DOUBLE AS angle FROM part")
register("frames", lambda s, d: frames.frames(read(s, d, "events")), "SELECT time_bucket(INTERVAL 1 day, ts) AS frame, event_type, hour(ts)::INT AS slot, count(*)::DOUBLE AS v FROM events GROUP BY ALL")


def streamed(s: SparkSession, d: str) -> DataFrame:
    return frames.run_to_end(s, f"{d}/events.parquet*", lambda events: frames.frame_totals(events, late="1 hour"), shared_folder(s, "frame_totals"))


register("stream_frame_totals", streamed, "SELECT time_bucket(INTERVAL 1 hour, ts) AS frame, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")


def stream_tracks(s: SparkSession, d: str) -> DataFrame:
    """Points followed through streams of ten frames each: embeddings as images of 8 x 8, blown up fourfold."""
    images = s.readStream.schema("vec_id long, embedding array<float>").parquet(f"{d}/embeddings.parquet*")
    data = "transform(sequence(0, 1023), p -> 1000D * embedding[(p div 128) * 8 + (p % 32) div 4])"
    shots = images.selectExpr("vec_id div 10 AS stream", "vec_id % 10 AS frame", f"{data} AS data")
    spots = [(k, x, y) for k, (x, y) in enumerate((x, y) for x in (10.0, 21.0) for y in (10.0, 21.0))]
    found = frames.run_to_table(tracks.follow(shots, Shape(32, 32), spots, (9, 9), 1), shared_folder(s, "tracks"))
    return found.select("stream", "frame", "id", "status", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


register("stream_tracks", stream_tracks)

"""Matrix algebra: products as joins and sums, small systems as a grouped kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.local import small_table
from ..sources.pixels import KEYS
from ..types import MatrixError
from .structural import transpose


def val() -> Column:
    return F.col("v")



def gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0, c: DataFrame | None = None, beta: float = 0.0, transposed: str = "") -> DataFrame:
    """alpha op(A) op(B) + beta op(C) by image and channel; ``transposed`` names those to transpose, as in "ac"."""
    a, b = (transpose(m) if n in transposed else m for m, n in ((a, "a"), (b, "b")))
    left = a.select("img", "c", "y", F.col("x").alias("_k"), val().alias("_a"))
    right = b.select("img", "c", F.col("y").alias("_k"), "x", val().alias("_b"))
    out = left.join(right, ["img", "c", "_k"]).groupBy(*KEYS).agg((F.sum(F.col("_a") * F.col("_b")) * alpha).alias("v"))
    if c is None or not beta:
        return out
    third = (transpose(c) if "c" in transposed else c).select(*KEYS, (val() * beta).alias("_c"))
    return out.join(third, list(KEYS), "left").select(*KEYS, (val() + F.coalesce("_c", F.lit(0.0))).alias("v"))


def product_with(a: DataFrame, b: list[list[float]], alpha: float = 1.0) -> DataFrame:
    """A times one small matrix, which is broadcast."""
    cells = [(k, j, float(w)) for k, row in enumerate(b) for j, w in enumerate(row)]
    table = F.broadcast(small_table(a.sparkSession, cells, "_k int, _j int, _b double"))
    return a.join(table, a["x"] == table["_k"]).groupBy("img", "y", F.col("_j").alias("x"), "c").agg((F.sum(val() * F.col("_b")) * alpha).alias("v")).select(*KEYS, "v")


def cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cross products of 3-vectors (row or column matrices)."""
    at = F.col("y") + F.col("x")
    pick = lambda df, n: df.groupBy("img").agg(*[F.max(F.when(at == k, val())).alias(f"{n}{k}") for k in range(3)])
    j = pick(a, "a").join(pick(b, "b"), "img")
    c = lambda i, k: F.col(f"a{i}") * F.col(f"b{k}") - F.col(f"a{k}") * F.col(f"b{i}")
    return j.select("img", F.posexplode(F.array(c(1, 2), c(2, 0), c(0, 1))).alias("y", "v")).select("img", "y", F.lit(0).alias("x"), F.lit(0).alias("c"), "v")


def _matrix(df: pd.DataFrame) -> np.ndarray:
    m = np.zeros((int(df["y"].max()) + 1, int(df["x"].max()) + 1))
    m[df["y"], df["x"]] = df["v"]
    return m


def determinant(px: DataFrame, n: int) -> DataFrame:
    """(img, det) of square matrices: a formula up to 3 x 3, elimination beyond."""
    if n <= 3:
        cell = lambda y, x: F.sum(F.when((F.col("y") == y) & (F.col("x") == x), val())).alias(f"m{y}{x}")
        flat = px.where("c = 0").groupBy("img").agg(*[cell(y, x) for y in range(n) for x in range(n)])
        m = lambda y, x: F.col(f"m{y}{x}")
        det: Column
        if n == 1:
            det = m(0, 0)
        elif n == 2:
            det = m(0, 0) * m(1, 1) - m(0, 1) * m(1, 0)
        else:
            det = m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
        return flat.select("img", det.alias("det"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(df)
        return pd.DataFrame({"img": [df["img"].iloc[0]], "det": [float(np.linalg.det(m)) if m.shape[0] == m.shape[1] else 0.0]})

    return px.where("c = 0").groupBy("img").applyInPandas(run, "img long, det double")


def eliminate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray | None, float]:
    """Solution by LU with partial pivoting and the determinant; None where a pivot is under 1e-12."""
    a, b, det = a.astype(float).copy(), b.astype(float).copy(), 1.0
    n = len(a)
    for k in range(n):
        p = k + int(np.abs(a[k:, k]).argmax())
        if abs(a[p, k]) < 1e-12:
            return None, 0.0
        if p != k:
            a[[k, p]], b[[k, p]], det = a[[p, k]], b[[p, k]], -det
        det *= a[k, k]
        f = a[k + 1 :, k] / a[k, k]
        a[k + 1 :] -= f[:, None] * a[k]
        b[k + 1 :] -= f[:, None] * b[k]
    for k in range(n - 1, -1, -1):
        b[k] = (b[k] - a[k, k + 1 :] @ b[k + 1 :]) / a[k, k]
    return b, det


def solve(a: DataFrame, b: DataFrame) -> DataFrame:
    """(img, y, x, c, v, solved) of A X = B for square matrices; a singular system gives zeros and solved = false."""
    both = a.where("c = 0").withColumn("_side", F.lit(0)).unionByName(b.where("c = 0").withColumn("_side", F.lit(1)))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        m, r = _matrix(df[df["_side"] == 0]), _matrix(df[df["_side"] == 1])
        if m.shape[0] != m.shape[1] or len(r) != len(m):
            raise MatrixError("a square system is needed")
        x, _ = eliminate(m, r)
        ok = x is not None
        x = x if ok else np.zeros_like(r)
        y, k = np.indices(x.shape)
        return pd.DataFrame({"img": df["img"].iloc[0], "y": y.ravel(), "x": k.ravel(), "c": 0, "v": x.ravel(), "solved": ok})

    return both.groupBy("img").applyInPandas(run, "img long, y int, x int, c int, v double, solved boolean")


def invert(px: DataFrame) -> DataFrame:
    """(img, y, x, c, v, det); a singular matrix gives zeros and a determinant of 0."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(df)
        x, det = eliminate(m, np.eye(len(m)))
        x = x if x is not None else np.zeros_like(m)
        y, k = np.indices(x.shape)
        return pd.DataFrame({"img": df["img"].iloc[0], "y": y.ravel(), "x": k.ravel(), "c": 0, "v": x.ravel(), "det": det})

    return px.where("c = 0").groupBy("img").applyInPandas(run, "img long, y int, x int, c int, v double, det double")


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """Real roots in ascending order; linear where a is (nearly) 0."""
    flat, level = F.abs(a) < 1e-12, F.abs(b) < 1e-12
    d = b * b - 4 * a * c
    root = F.sqrt(F.when(d > 0, d).otherwise(0.0))
    safe = F.when(flat, 1.0).otherwise(a)
    none = F.array().cast("array<double>")
    line = F.when(level, none).otherwise(F.array(-c / F.when(level, 1.0).otherwise(b)))
    two = F.array_sort(F.array((-b - root) / (2 * safe), (-b + root) / (2 * safe)))
    return F.when(flat, line).when(d < 0, none).when(d == 0, F.array(-b / (2 * safe))).otherwise(two)


def cubic_roots(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Real roots in ascending order (one where there aren't three different ones); quadratic where a is (nearly) 0."""
    flat = F.abs(a) < 1e-12
    safe = F.when(flat, 1.0).otherwise(a)
    p, q, r = b / safe, c / safe, d / safe
    s = (p * p - 3 * q) / 9
    t = (2 * p * p * p - 9 * p * q + 27 * r) / 54
    three = t * t < s * s * s
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t / F.sqrt(F.when(three, s * s * s).otherwise(1.0)))))
    size = -2 * F.sqrt(F.when(three, s).otherwise(0.0))
    many = F.array_sort(F.array(*[size * F.cos((angle + k * 2 * np.pi) / 3) - p / 3 for k in (0, 1, -1)]))
    d2 = F.sqrt(F.when(three, 0.0).otherwise(t * t - s * s * s))
    one = F.array(F.cbrt(d2 - t) + F.cbrt(-t - d2) - p / 3)
    return F.when(flat, quadratic_roots(b, c, d)).when(three, many).otherwise(one)


def solve_poly(df: DataFrame, key: str, coefficients: str, rounds: int = 300) -> DataFrame:
    """(key, root, re, im, residual) of polynomials with ascending coefficients, by simultaneous iteration."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, c in zip(pdf[key], pdf[coefficients]):
                c = np.trim_zeros(np.asarray(c, complex), "b")
                n = len(c) - 1
                if n < 1:
                    continue
                c = c / c[-1]
                z = (0.4 + 0.9j) ** np.arange(n)
                value = lambda z: np.polyval(c[::-1], z)  # noqa: E731, B023
                for _ in range(rounds if rounds > 0 else 300):
                    gaps = z[:, None] - z[None, :]
                    np.fill_diagonal(gaps, 1)
                    step = value(z) / gaps.prod(1)
                    z = z - step
                    if np.abs(step).max() < 1e-15:
                        break
                z.imag[np.abs(z.imag) < 1e-12] = 0
                residual = float(np.abs(value(z)).max())
                z = z[np.lexsort((z.imag.round(9), z.real.round(9)))]
                out += [(k, i, float(r.real), float(r.imag), residual) for i, r in enumerate(z)]
            yield pd.DataFrame(out, columns=[key, "root", "re", "im", "residual"])

    return df.select(key, coefficients).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, root int, re double, im double, residual double")

"""Neighbourhood filters, as kernels over tiles with halos (``dense``): one exchange each, whatever the size of an image.

What a missing pixel is to them is said there.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import taps as T
from ..sources.local import small_table
from ..sources.pixels import KEYS
from ..types import Border, MatrixError, Shape, truncate_cast
from . import dense, elementwise


def val() -> Column:
    return F.col("v")



def along(px: DataFrame, taps: list[T.Tap], axis: str) -> DataFrame:
    """Weighted sums along one axis by a join with the tap table, for images whose shape isn't known."""
    keys = [k for k in KEYS if k != axis]
    table = F.broadcast(small_table(px.sparkSession, taps, f"_t int, {axis} int, _w double"))
    out = px.join(table, axis).groupBy(*keys, "_t").agg(F.sum(val() * F.col("_w")).alias("v"))
    return out.withColumnRenamed("_t", axis).select(*KEYS, "v")


def separable(px: DataFrame, shape: Shape, across: list[T.Tap], down: list[T.Tap]) -> DataFrame:
    """Weighted sums along both axes of images of this shape."""
    return dense.tapped(px, shape, across, down)


def finish(px: DataFrame, depth: str) -> DataFrame:
    return elementwise.mapped(px, lambda v: truncate_cast(v, depth))


def box_filter(px: DataFrame, shape: Shape, ksize: tuple[int, int], anchor: tuple[int, int] = (-1, -1), normalize: bool = True, border: Border = Border.REFLECT_101, depth: str = "f64") -> DataFrame:
    """``ksize`` and ``anchor`` are (width, height)."""
    kw, kh = ksize
    out = separable(px, shape, T.kernel_taps(shape.cols, [1.0] * kw, anchor[0], border), T.kernel_taps(shape.rows, [1.0] * kh, anchor[1], border))
    return elementwise.mapped(out, lambda v: truncate_cast(v / float(kw * kh) if normalize else v, depth))


def blur(px: DataFrame, shape: Shape, ksize: tuple[int, int], anchor: tuple[int, int] = (-1, -1), border: Border = Border.REFLECT_101, depth: str = "f64") -> DataFrame:
    return box_filter(px, shape, ksize, anchor, True, border, depth)


def gaussian_blur(px: DataFrame, shape: Shape, ksize: tuple[int, int], sigma_x: float = 0.0, sigma_y: float = 0.0, border: Border = Border.REFLECT_101, depth: str = "f64") -> DataFrame:
    kx = T.gaussian_kernel(ksize[0], sigma_x)
    ky = T.gaussian_kernel(ksize[1], sigma_y if sigma_y > 0 else sigma_x)
    return finish(separable(px, shape, T.kernel_taps(shape.cols, kx, border=border), T.kernel_taps(shape.rows, ky, border=border)), depth)


def sobel(px: DataFrame, shape: Shape, dx: int, dy: int, ksize: int = 3, scale: float = 1.0, delta: float = 0.0, border: Border = Border.REFLECT_101, depth: str = "f64") -> DataFrame:
    kx, ky = T.sobel_kernels(ksize, dx, dy)
    out = separable(px, shape, T.kernel_taps(shape.cols, kx, border=border), T.kernel_taps(shape.rows, ky, border=border))
    return elementwise.mapped(out, lambda v: truncate_cast(v * scale + delta, depth))


def scharr(px: DataFrame, shape: Shape, dx: int, dy: int, scale: float = 1.0, delta: float = 0.0, border: Border = Border.REFLECT_101, depth: str = "f64") -> DataFrame:
    if dx + dy != 1 or min(dx, dy) < 0:
        raise MatrixError("Scharr takes dx + dy = 1")
    return sobel(px, shape, dx, dy, -1, scale, delta, border, depth)


def neighbours(px: DataFrame, shape: Shape, offsets: list[tuple[int, int, float]], border: Border = Border.REFLECT_101) -> DataFrame:
    """One row for each target place and offset: the source pixel's v, the weight _w and the offset (_dy, _dx).

    ``offsets`` are (dy, dx, weight). Targets whose source lies outside get no row where the border has none.
    """
    spark = px.sparkSession
    across = sorted({(t, T.border_index(t + dx, shape.cols, border), dx) for t in range(shape.cols) for _, dx, _ in offsets})
    down = sorted({(t, T.border_index(t + dy, shape.rows, border), dy) for t in range(shape.rows) for dy, _, _ in offsets})
    xs = F.broadcast(small_table(spark, [r for r in across if r[1] >= 0], "_tx int, x int, _dx int"))
    ys = F.broadcast(small_table(spark, [r for r in down if r[1] >= 0], "_ty int, y int, _dy int"))
    w = F.broadcast(small_table(spark, [(dy, dx, float(k)) for dy, dx, k in offsets], "_dy int, _dx int, _w double"))
    out = px.join(xs, "x").join(ys, "y").join(w, ["_dy", "_dx"])
    return out.select("img", F.col("_ty").alias("y"), F.col("_tx").alias("x"), "c", "v", "_w", "_dy", "_dx")


def reach_of(offsets: list[tuple[int, int]]) -> tuple[int, int]:
    return tuple(max((abs(o[k]) for o in offsets), default=0) for k in (0, 1))


def kept(out: dict[str, np.ndarray], where: np.ndarray | None) -> dict[str, np.ndarray]:
    return out if where is None else out | {"_keep": where}


def filter_2d(px: DataFrame, shape: Shape, kernel: list[list[float]], border: Border = Border.REFLECT_101, depth: str = "f64", delta: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Correlation with a dense kernel, anchored in its middle."""
    h, w = len(kernel), len(kernel[0])
    offsets = [(y - h // 2, x - w // 2, kernel[y][x]) for y in range(h) for x in range(w) if kernel[y][x]]
    at = [(dy, dx) for dy, dx, _ in offsets]
    out = dense.filtered(px, shape, reach_of(at), border, lambda f: kept({"v": sum(p * k for p, (_, _, k) in zip(f.shifts(at), offsets))}, f.seen(at)))
    return elementwise.mapped(out, lambda v: truncate_cast(v * scale + delta, depth))


def laplacian(px: DataFrame, shape: Shape, ksize: int = 1, scale: float = 1.0, delta: float = 0.0, border: Border = Border.REFLECT_101, depth: str = "f64") -> DataFrame:
    if ksize == 1:
        return filter_2d(px, shape, [[0, 1, 0], [1, -4, 1], [0, 1, 0]], border, depth, delta, scale)
    xx, yy = sobel(px, shape, 2, 0, ksize, border=border), sobel(px, shape, 0, 2, ksize, border=border)
    return elementwise.paired(xx, yy, lambda a, b: truncate_cast((a + b) * scale + delta, depth))


def median_blur(px: DataFrame, shape: Shape, ksize: int) -> DataFrame:
    """Median of an odd window, mirrored at the borders; of an even number of pixels the mean of the middle two."""
    if ksize < 3 or ksize % 2 == 0:
        raise MatrixError("a median window is odd and above 1")
    r = ksize // 2
    window = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]

    def middle(f: dense.Frame) -> dict[str, np.ndarray]:
        seen = f.seen(window)
        if seen is None:
            return {"v": np.median(np.stack(list(f.shifts(window))), axis=0)}
        values = np.sort(np.stack(list(f.shifts(window))), axis=0)  # missing pixels, NaN, come last
        n = (~np.isnan(values)).sum(0)
        pick = lambda k: np.take_along_axis(values, np.maximum(k, 0)[None], 0)[0]
        return {"v": (pick((n - 1) // 2) + pick(n // 2)) / 2, "_keep": seen}

    return dense.filtered(px, shape, (r, r), Border.REFLECT_101, middle, fill=math.nan)


def _extreme(px: DataFrame, shape: Shape, offsets: list[tuple[int, int]], border: Border, lowest: bool) -> DataFrame:
    fold, none = (np.minimum, math.inf) if lowest else (np.maximum, -math.inf)
    return dense.filtered(px, shape, reach_of(offsets), border, lambda f: kept({"v": fold.reduce(list(f.shifts(offsets)))}, f.seen(offsets)), fill=none, outside=none)


def erode(px: DataFrame, shape: Shape, element: list[tuple[int, int]], iterations: int = 1, border: Border = Border.CONSTANT) -> DataFrame:
    """Least value under the element's offsets; what lies outside a constant border doesn't count."""
    for _ in range(iterations):
        px = _extreme(px, shape, element, border, True)
    return px


def dilate(px: DataFrame, shape: Shape, element: list[tuple[int, int]], iterations: int = 1, border: Border = Border.CONSTANT) -> DataFrame:
    for _ in range(iterations):
        px = _extreme(px, shape, element, border, False)
    return px


def morphology_ex(px: DataFrame, shape: Shape, op: str, element: list[tuple[int, int]], iterations: int = 1, border: Border = Border.CONSTANT) -> DataFrame:
    """op: erode, dilate, open, close, gradient, tophat, blackhat."""
    low = lambda p: erode(p, shape, element, iterations, border)
    high = lambda p: dilate(p, shape, element, iterations, border)
    forms = {
        "erode": lambda: low(px),
        "dilate": lambda: high(px),
        "open": lambda: high(low(px)),
        "close": lambda: low(high(px)),
        "gradient": lambda: elementwise.subtract(high(px), low(px), "f64"),
        "tophat": lambda: elementwise.subtract(px, high(low(px)), "f64"),
        "blackhat": lambda: elementwise.subtract(low(high(px)), px, "f64"),
    }
    if op not in forms:
        raise MatrixError(f"no morphology {op}")
    return forms[op]()


def bilateral_filter(px: DataFrame, shape: Shape, d: int, sigma_color: float, sigma_space: float, border: Border = Border.REFLECT_101, depth: str = "f64") -> DataFrame:
    """Weights fall with distance and with the colour difference over all channels.

    Under a constant border, places outside count as 0, with their weight; a missing pixel has no weight and no result,
    and counts as 0 in the colour differences of its image's other channels.
    """
    r = d // 2 if d > 0 else max(1, math.floor(1.5 * sigma_space + 0.5))
    space = [(dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2))) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    at = [(dy, dx) for dy, dx, _ in space]

    def smooth(f: dense.Frame) -> dict[str, np.ndarray]:
        a = f.shift(f.v, 0, 0)
        total, weights = np.zeros_like(a), np.zeros_like(a)
        for p, (dy, dx, near) in zip(f.shifts(at), space):
            w = near * np.exp(((p - a) ** 2).sum(3, keepdims=True) * (-0.5 / sigma_color**2))
            if f.missing is not None:
                w = w * ~f.shift(f.missing, dy, dx)
            total, weights = total + w * p, weights + w
        out = {"v": total / np.where(weights > 0, weights, 1.0)}
        return out if f.missing is None else out | {"_keep": f.present(np.ones(a.shape, bool))}

    return finish(dense.filtered(px, shape, (r, r), border, smooth, channels=shape.channels), depth)


def rounded(px: DataFrame) -> DataFrame:
    """Half away from zero."""
    return elementwise.mapped(px, lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5))


def pyr_down(px: DataFrame, shape: Shape, border: Border = Border.REFLECT_101) -> tuple[DataFrame, Shape]:
    out = Shape((shape.rows + 1) // 2, (shape.cols + 1) // 2, shape.channels)
    return rounded(separable(px, shape, T.half_taps(shape.cols, border), T.half_taps(shape.rows, border))), out


def pyr_up(px: DataFrame, shape: Shape, border: Border = Border.REFLECT_101) -> tuple[DataFrame, Shape]:
    out = Shape(2 * shape.rows, 2 * shape.cols, shape.channels)
    return rounded(separable(px, shape, T.double_taps(shape.cols, border, by_source=True), T.double_taps(shape.rows, border))), out


def build_pyramid(px: DataFrame, shape: Shape, levels: int, border: Border = Border.REFLECT_101) -> DataFrame:
    """All levels in one table with a column level; level 0 is the image."""
    out, now = px.select(*KEYS, "v").withColumn("level", F.lit(0)), px
    for k in range(1, levels + 1):
        now, shape = pyr_down(now, shape, border)
        out = out.unionByName(now.withColumn("level", F.lit(k)))
    return out


def resize(px: DataFrame, shape: Shape, rows: int, cols: int, round_output: bool = True) -> DataFrame:
    out = separable(px, shape, T.resize_taps(shape.cols, cols), T.resize_taps(shape.rows, rows))
    return rounded(out) if round_output else out


def dct(px: DataFrame, shape: Shape) -> DataFrame:
    return separable(px, shape, T.dct_taps(shape.cols), T.dct_taps(shape.rows))


def idct(px: DataFrame, shape: Shape) -> DataFrame:
    return separable(px, shape, T.dct_taps(shape.cols, True), T.dct_taps(shape.rows, True))


def optimal_dft_size(n: int) -> int:
    """The least 2^a 3^b 5^c that isn't under n."""
    best = None
    a = 1
    while best is None or a < best:
        b = a
        while best is None or b < best:
            c = b
            while c < n:
                c *= 5
            best = c if best is None else min(best, c)
            b *= 3
        a *= 2
    return best


def dft(px: DataFrame, shape: Shape, inverse: bool = False, scale: bool = False, rows_only: bool = False, nonzero_rows: int = 0) -> DataFrame:
    """Two-dimensional discrete Fourier transform; channel 0 is the real and 1 the imaginary part.

    Rows are transformed in stripes of whole rows, then columns in stripes of whole columns (an image of one tile at once), by fast
    transforms; a real image needs no channel 1. Missing pixels count as 0.
    """
    if nonzero_rows and shape.channels == 1:
        px = px.where(F.col("y") < nonzero_rows)
    stripes = lambda n: dense.reaching(n, 0, Border.CONSTANT)
    line = lambda n: dense.Axis(n, (0, n), (np.arange(n),))

    def transform(*axes: int) -> dense.Kernel:
        def run(a: np.ndarray, *_) -> dict[str, np.ndarray]:
            z = a[..., 0] + 1j * a[..., 1]
            z = np.fft.ifftn(z, axes=axes, norm="forward") if inverse else np.fft.fftn(z, axes=axes)
            return {"v": np.stack([z.real, z.imag], axis=3)}

        return run

    if dense.one_tile(shape) and not rows_only:
        out = dense.by_tile(px, line(shape.rows), line(shape.cols), transform(1, 2), channels=2)
    else:
        out = dense.by_tile(px, stripes(shape.rows), line(shape.cols), transform(2), channels=2)
        if not rows_only:
            out = dense.by_tile(out, line(shape.rows), stripes(shape.cols), transform(1), channels=2)
    return elementwise.mapped(out, lambda v: v / float(shape.cols * (1 if rows_only else shape.rows))) if scale else out


def idft(px: DataFrame, shape: Shape, rows_only: bool = False) -> DataFrame:
    return dft(px, shape, True, True, rows_only)

"""Histograms: bins are projections, counts are aggregations, dense results come from a left join on all bins."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce as fold

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.taps import border_index
from ..sources.local import small_table
from ..sources.pixels import KEYS
from ..types import Border, MatrixError, Shape
from . import dense
from .reduce import masked


def val() -> Column:
    return F.col("v")



def bin_of(v: Column, size: int, bounds: list[float]) -> Column:
    """Bin of a value, or null outside: two bounds cut evenly, size + 1 bounds are the edges (upper edge excluded)."""
    if len(bounds) == 2:
        low, high = float(bounds[0]), float(bounds[1])
        k = F.floor((v - low) * (size / (high - low))).cast("int")
        return F.when((v >= low) & (v < high), F.least(F.lit(size - 1), F.greatest(F.lit(0), k)))
    if len(bounds) != size + 1:
        raise MatrixError("edges are one more than bins")
    out = F.lit(None).cast("int")
    for k in range(size):
        out = F.when((v >= float(bounds[k])) & (v < float(bounds[k + 1])), k).otherwise(out)
    return out


def _binned(images: list[tuple[DataFrame, int]], channels: list[int], sizes: list[int], ranges: list[list[float]], mask: DataFrame | None) -> DataFrame:
    """(img, y, x, b0, b1, ...) of places where every dimension has a bin; channels are numbered across images."""
    starts = [sum(n for _, n in images[:k]) for k in range(len(images))]
    parts = []
    for d, ch in enumerate(channels):
        k = max(i for i, s in enumerate(starts) if s <= ch)
        px = masked(images[k][0], mask)
        parts.append(px.where(F.col("c") == ch - starts[k]).select("img", "y", "x", bin_of(val(), sizes[d], ranges[d]).alias(f"b{d}")).where(f"b{d} is not null"))
    return fold(lambda a, b: a.join(b, ["img", "y", "x"]), parts)


def calc_hist(images: list[tuple[DataFrame, int]], channels: list[int], sizes: list[int], ranges: list[list[float]], mask: DataFrame | None = None, accumulate: DataFrame | None = None) -> DataFrame:
    """(img, bin, n) with all bins, flattened row-major; ``images`` are (pixels, channels)."""
    flat = F.lit(0)
    for d, n in enumerate(sizes):
        flat = flat * n + F.col(f"b{d}")
    counts = _binned(images, channels, sizes, ranges, mask).groupBy("img", flat.alias("bin")).agg(F.count("*").alias("n"))
    if accumulate is not None:
        counts = counts.unionByName(accumulate.select("img", "bin", F.col("n").cast("long").alias("n")))
    total = 1
    for n in sizes:
        total *= n
    frame = images[0][0].select("img").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    counts = counts.groupBy("img", "bin").agg(F.sum("n").alias("n"))
    return frame.join(counts, ["img", "bin"], "left").select("img", "bin", F.coalesce("n", F.lit(0)).cast("double").alias("n"))


def calc_back_project(images: list[tuple[DataFrame, int]], channels: list[int], sizes: list[int], ranges: list[list[float]], hist: DataFrame, scale: float = 1.0) -> DataFrame:
    """hist[bin of the place] * scale, 0 outside; ``hist`` is (img, bin, n)."""
    flat = F.lit(0)
    for d, n in enumerate(sizes):
        flat = flat * n + F.col(f"b{d}")
    binned = _binned(images, channels, sizes, ranges, None).select("img", "y", "x", flat.alias("bin"))
    found = binned.join(hist, ["img", "bin"], "left").select("img", "y", "x", "n")
    every = images[0][0].where("c = 0").select("img", "y", "x", "c")
    return every.join(found, ["img", "y", "x"], "left").select(*KEYS, (F.coalesce("n", F.lit(0.0)) * scale).alias("v"))


EPS = 2.220446049250313e-16


def compare_hist(a: DataFrame, b: DataFrame, method: str) -> DataFrame:
    """(img, distance): correl, chisqr, chisqr_alt, intersection, bhattacharyya or kl_div, in one aggregation."""
    h1, h2 = F.col("_a"), F.col("_b")
    both = a.select("img", "bin", F.col("n").alias("_a")).join(b.select("img", "bin", F.col("n").alias("_b")), ["img", "bin"])
    safe = lambda x, y: F.when(F.abs(y) > EPS, x / F.when(F.abs(y) > EPS, y).otherwise(1.0)).otherwise(0.0)
    g = both.groupBy("img")
    if method == "correl":
        s = g.agg(F.sum(h1).alias("s1"), F.sum(h2).alias("s2"), F.sum(h1 * h1).alias("s11"), F.sum(h2 * h2).alias("s22"), F.sum(h1 * h2).alias("s12"), F.count("*").alias("m"))
        den = (F.col("s11") - F.col("s1") * F.col("s1") / F.col("m")) * (F.col("s22") - F.col("s2") * F.col("s2") / F.col("m"))
        num = F.col("s12") - F.col("s1") * F.col("s2") / F.col("m")
        return s.select("img", F.when(F.abs(den) > EPS, num / F.sqrt(F.when(den > EPS, den).otherwise(1.0))).otherwise(1.0).alias("distance"))
    if method == "bhattacharyya":
        s = g.agg(F.sum(h1).alias("s1"), F.sum(h2).alias("s2"), F.sum(F.sqrt(h1 * h2)).alias("bc"))
        norm = F.col("s1") * F.col("s2")
        k = F.when(F.abs(norm) > EPS, 1 / F.sqrt(F.when(norm > EPS, norm).otherwise(1.0))).otherwise(1.0)
        return s.select("img", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("bc") * k)).alias("distance"))
    forms = {
        "chisqr": F.sum(safe((h1 - h2) * (h1 - h2), h1)),
        "chisqr_alt": 2 * F.sum(safe((h1 - h2) * (h1 - h2), h1 + h2)),
        "intersection": F.sum(F.least(h1, h2)),
        "kl_div": F.sum(F.when(F.abs(h1) > EPS, h1 * F.ln(F.when(h1 > EPS, h1).otherwise(1.0) / F.when(F.abs(h2) <= EPS, 1e-10).otherwise(h2))).otherwise(0.0)),
    }
    if method not in forms:
        raise MatrixError(f"no comparison {method}")
    return g.agg(forms[method].alias("distance"))


def equalize_hist(px: DataFrame) -> DataFrame:
    """Values by the cumulated histogram without its first bin; constant images stay."""
    counts = px.groupBy("img", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("img").orderBy("v")
    table = counts.withColumns({
        "_sum": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_first": F.first("n").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_all": F.sum("n").over(Window.partitionBy("img")),
    })
    rest = F.col("_all") - F.col("_first")
    out = F.when(rest == 0, val()).otherwise(F.floor((F.col("_sum") - F.col("_first")) * (255.0 / F.when(rest == 0, 1).otherwise(rest)) + 0.5))
    return px.join(table.select("img", "v", out.alias("_out")), ["img", "v"]).select(*KEYS, F.col("_out").cast("double").alias("v"))


@dataclass(frozen=True)
class Equaliser:
    """The law of contrast-limited equalisation: ``ty`` x ``tx`` tiles of an image, mirrored right and down to whole tiles."""

    shape: Shape
    tx: int
    ty: int
    bins: int
    clip: int  # of a bin's count; 0: none

    @property
    def size(self) -> tuple[int, int]:
        """Rows and columns of a tile."""
        return -(-self.shape.rows // self.ty), -(-self.shape.cols // self.tx)

    def sources(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(place, tile) of the rows and of the columns of the mirrored image."""
        return tuple([(border_index(i, n, Border.REFLECT_101), i // size) for i in range(count * size)] for n, count, size in zip((self.shape.rows, self.shape.cols), (self.ty, self.tx), self.size))

    def blends(self) -> tuple[list[tuple[int, int, float]], list[tuple[int, int, float]]]:
        """(place, tile, weight) of the two nearest tiles of rows and of columns."""
        out = []
        for n, count, size in zip((self.shape.rows, self.shape.cols), (self.ty, self.tx), self.size):
            rows = []
            for i in range(n):
                at = i / size - 0.5
                low = int(at // 1)
                d = at - low
                rows += [(i, min(max(low, 0), count - 1), 1 - d), (i, min(max(low + 1, 0), count - 1), d)]
            out.append(rows)
        return tuple(out)

    @property
    def gain(self) -> float:
        return (self.bins - 1) / (self.size[0] * self.size[1])


def _equalised(law: Equaliser, k: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Results of images (planes, rows, cols) of bins, of which those ``there`` count.

    Of a tile only the bins that occur are held: what the cut counts give to all bins in equal parts is known in closed form.
    """
    (ys, tys), (xs, txs) = (np.array(t).T for t in law.sources())
    planes, tiles = len(k), law.ty * law.tx
    first = np.arange(planes)[:, None, None] * tiles
    seen = there[:, ys][:, :, xs]
    keys, n = np.unique(((first + (tys[:, None] * law.tx + txs)) * law.bins + k[:, ys][:, :, xs])[seen], return_counts=True)
    kept = np.minimum(n, law.clip) if law.clip else n
    over = np.bincount(keys // law.bins, n - kept, planes * tiles).astype(np.int64)
    batch, left = over // law.bins, over % law.bins
    step = np.maximum(1, law.bins // np.maximum(1, left))
    below = np.concatenate([[0], np.cumsum(kept)])
    start = below[np.searchsorted(keys, np.arange(planes * tiles) * law.bins)]
    out = np.zeros(k.shape)
    down, across = (np.array(b).reshape(-1, 2, 3) for b in law.blends())
    for a in range(2):
        for b in range(2):
            tile = first + (down[:, a, 1].astype(np.int64)[:, None] * law.tx + across[:, b, 1].astype(np.int64))
            sums = below[np.searchsorted(keys, tile * law.bins + k, "right")] - start[tile] + batch[tile] * (k + 1) + np.minimum(left[tile], k // step[tile] + 1)
            out += np.minimum(law.bins - 1.0, np.floor(sums * law.gain + 0.5)) * down[:, a, 2][:, None] * across[:, b, 2]
    return np.floor(np.round(out, 9) + 0.5)


def clahe(px: DataFrame, shape: Shape, clip_limit: float = 40.0, tiles: tuple[int, int] = (8, 8), bits: int = 8, bit_shift: int = 0) -> DataFrame:
    """Contrast-limited equalisation by tiles: clipped histograms, and a blend of the four nearest tiles' tables.

    ``tiles`` is (across, down); images are mirrored right and down to whole tiles. Channels are equalised each for itself; values outside
    the range count nowhere and have no result.
    """
    tx, ty = tiles
    bins = (1 << bits) >> bit_shift
    law = Equaliser(shape, tx, ty, bins, 0)
    if clip_limit > 0:
        law = replace(law, clip=max(1, int(clip_limit * law.size[0] * law.size[1] / bins)))
    if not dense.one_tile(shape):
        return _spread_clahe(px, law, bit_shift)

    def kernel(stack: np.ndarray, there: np.ndarray | None, *_: int) -> dict[str, np.ndarray]:
        v = stack[..., 0]
        keep = np.isfinite(v) if there is None else there[..., 0] & np.isfinite(v)
        k = np.trunc(np.where(keep, v, -1.0))
        keep &= (k >= 0) & (k < 1 << bits)
        k = np.where(keep, k, 0).astype(np.int64) >> bit_shift
        return {"v": _equalised(law, k, keep)[..., None] * float(1 << bit_shift), "_keep": keep[..., None]}

    return dense.filtered(px, shape, (0, 0), Border.REFLECT_101, lambda f: kernel(f.v, None if f.missing is None else ~f.missing))


def _spread_clahe(px: DataFrame, law: Equaliser, bit_shift: int) -> DataFrame:
    """The same of images larger than a task's tile, as joins; of a tile's table only the bins that occur or are asked for."""
    tile = ["img", "c", "_ty", "_tx"]
    table = lambda rows, names: F.broadcast(small_table(px.sparkSession, rows, names))
    shifted = px.withColumn("_k", F.shiftright(val().cast("int"), bit_shift)).where(F.col("_k").between(0, law.bins - 1))
    (ys, xs), (down, across) = law.sources(), law.blends()
    counts = shifted.join(table(ys, "y int, _ty int"), "y").join(table(xs, "x int, _tx int"), "x").groupBy(*tile, "_k").agg(F.count("*").alias("n"))
    spread = shifted.join(table(down, "y int, _ty int, _wy double"), "y").join(table(across, "x int, _tx int, _wx double"), "x")
    asked = spread.select(*tile, "_k").distinct().withColumn("n", F.lit(0).cast("long"))
    found = counts.unionByName(asked).groupBy(*tile, "_k").agg(F.sum("n").alias("n"))
    kept = F.least(F.col("n"), F.lit(law.clip)) if law.clip else F.col("n")
    over = F.sum(F.col("n") - kept).over(Window.partitionBy(*tile))
    below = F.sum(kept).over(Window.partitionBy(*tile).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    sums = found.select(*tile, "_k", over.alias("_e"), below.alias("_sum")).withColumns({"_batch": F.floor(F.col("_e") / law.bins), "_left": F.col("_e") % law.bins})
    step = F.greatest(F.lit(1), F.floor(F.lit(law.bins) / F.greatest(F.lit(1), F.col("_left"))))
    sums = sums.withColumn("_sum", F.col("_sum") + F.col("_batch") * (F.col("_k") + 1) + F.least(F.col("_left"), F.floor(F.col("_k") / step) + 1))
    curve = sums.select(*tile, "_k", F.least(F.lit(float(law.bins - 1)), F.floor(F.col("_sum") * law.gain + 0.5)).alias("_lut"))
    blended = spread.join(curve, [*tile, "_k"]).groupBy(*KEYS).agg(F.sum(F.col("_lut") * F.col("_wy") * F.col("_wx")).alias("v"))
    return blended.withColumn("v", F.floor(F.round(val(), 9) + 0.5) * float(1 << bit_shift))

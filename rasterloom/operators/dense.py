"""Tiles with halos: images of any size as arrays in tasks, through one kernel.

An image is cut into tiles of at most ``TILE`` rows and columns of results; a tile's task gets the pixels that its results
need, so a pixel near a tile's edge goes to the neighbours too (an ``Axis`` says which places each tile asks for). An image
that fits one tile is sent once. Tiles of one place in many images form a stack, of bounded size. That is one exchange and no
join but with the small tables of tile edges, whatever the size.

A missing pixel has no value: sums leave it out, the least, the largest and the middle value are those of the pixels that there
are, and a place under whose kernel no pixel lies gets no row. Pixels beyond the shape on any side aren't pixels of the image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.taps import Tap, border_index
from ..sources.local import small_table
from ..types import Border, Shape

TILE, STACK = 1 << 9, 1 << 20  # rows and columns of a tile; elements that a kernel gets at once
WIDE = 64  # taps a target from which on a dense matrix is multiplied


@dataclass(frozen=True)
class Axis:
    """Tiles along an axis: tile k has the results ``starts[k]`` to ``starts[k + 1]`` and needs the places ``sources[k]`` (sorted)."""

    size: int
    starts: tuple[int, ...]
    sources: tuple[np.ndarray, ...]

    @property
    def tiles(self) -> int:
        return len(self.sources)

    def bounds(self, k: int) -> tuple[int, int]:
        return self.starts[k], self.starts[k + 1]

    @property
    def sent(self) -> int:
        return sum(map(len, self.sources))


def reaching(n: int, reach: int, border: Border) -> Axis:
    """Results where the pixels are, which need the places up to ``reach`` away, over the border too."""
    step = n if n <= TILE else max(TILE, reach)
    starts = (*range(0, n, step), n)
    sources = []
    for a, b in zip(starts, starts[1:]):
        around = {border_index(p, n, border) for p in [*range(a - reach, a), *range(b, b + reach)]} - {-1}
        sources.append(np.unique(np.concatenate([np.arange(a, b), np.array(sorted(around), np.int64)])))
    return Axis(n, starts, tuple(sources))


def of_taps(taps: list[Tap], n: int) -> Axis:
    """Results of a tap table over an axis of n places."""
    t, s = (np.array([x[k] for x in taps], np.int64) for k in (0, 1))
    size = int(t.max()) + 1
    starts = (*range(0, size, TILE), size)
    return Axis(n, starts, tuple(np.unique(s[(t >= a) & (t < b)]) for a, b in zip(starts, starts[1:])))


def one_tile(shape: Shape) -> bool:
    return max(shape.rows, shape.cols) <= TILE


Kernel = Callable[[np.ndarray, np.ndarray | None, int, int], dict[str, np.ndarray]]


def _dealt(px: DataFrame, down: Axis, across: Axis, *more: str) -> DataFrame:
    """Pixels with the numbers of the tiles that need them."""
    inside = F.col("y").between(0, down.size - 1) & F.col("x").between(0, across.size - 1)
    px = px.where(inside).select(F.col("img").cast("long").alias("img"), "y", "x", "c", F.col("v").cast("double").alias("v"), *more)
    for name, axis, tile in (("y", down, "_ty"), ("x", across, "_tx")):
        if axis.tiles == 1:
            px = px.withColumn(tile, F.lit(0))
        else:
            asked = [(int(s), k) for k, sources in enumerate(axis.sources) for s in sources]
            px = px.join(F.broadcast(small_table(px.sparkSession, asked, f"{name} int, {tile} int")), name)  # places of one axis
    return px


def _parted(df: DataFrame, down: Axis, across: Axis, *order: str) -> DataFrame:
    keys = ["img"] + (["_ty", "_tx"] if down.tiles * across.tiles > 1 else [])
    return df.repartition(*keys).sortWithinPartitions("_ty", "_tx", "img", *order)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row begins a new combination."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def by_tile(px: DataFrame, down: Axis, across: Axis, kernel: Kernel, names: Sequence[str] = ("v",), channels: int = 0) -> DataFrame:
    """(img, y, x, c, names) of ``kernel``: from a stack (planes, sources down, sources across, 1) of one tile with zeros for
    missing pixels, where pixels are (None: everywhere) and the tile's numbers, to arrays by name of its results, and perhaps a mask
    ``_keep`` of the places to return.

    A plane is a channel of an image; with ``channels`` an image's first channels stay together as the last axis.
    """
    schema = "img long, y int, x int, c int, " + ", ".join(f"{n} double" for n in names)
    px = px.where(F.col("c").between(0, channels - 1)) if channels else px

    def tile(img: np.ndarray, y: np.ndarray, x: np.ndarray, c: np.ndarray, v: np.ndarray, k: int, l: int) -> pa.RecordBatch:
        new = changes(img) if channels else changes(img, c)
        at, first = np.cumsum(new) - 1, np.flatnonzero(new)
        place = at, np.searchsorted(down.sources[k], y), np.searchsorted(across.sources[l], x), c if channels else np.zeros(len(c), np.int64)
        stack = np.zeros((len(first), len(down.sources[k]), len(across.sources[l]), channels or 1))
        stack[place] = v
        there = None
        if len(v) < stack.size:
            there = np.zeros(stack.shape, bool)
            there[place] = True
            there = None if there.all() else there
        out = kernel(stack, there, k, l)
        keep = out.pop("_keep", None)
        shape = out[names[0]].shape
        n, ty, tx, tc = (np.nonzero(np.broadcast_to(keep, shape)) if keep is not None else np.unravel_index(np.arange(np.prod(shape)), shape))
        found = [pa.array(out[name][n, ty, tx, tc]) for name in names]
        number = tc if channels else c[first][n]
        return pa.RecordBatch.from_arrays([pa.array(img[first][n]), *(pa.array(a.astype(np.int32)) for a in (ty + down.starts[k], tx + across.starts[l], number)), *found], names=["img", "y", "x", "c", *names])

    def rows(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ty, tx, *rest = cols
        starts = np.flatnonzero(changes(ty, tx))
        for a, b in zip(starts, np.append(starts[1:], len(ty))):
            k, l = int(ty[a]), int(tx[a])
            # Images with few pixels are as large as others once they are arrays: a stack is bounded by places, not rows.
            planes = a + np.flatnonzero(changes(rest[0][a:b]) if channels else changes(rest[0][a:b], rest[3][a:b]))
            most = max(1, STACK // (len(down.sources[k]) * len(across.sources[l]) * (channels or 1)))
            cuts = planes[::most]
            for i, j in zip(cuts, np.append(cuts[1:], b)):
                yield tile(*(r[i:j] for r in rest), k, l)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(n).to_numpy(zero_copy_only=False) for n in ("_ty", "_tx", "img", "y", "x", "c", "v")])
            count += batch.num_rows
            if count >= STACK:
                cols = [np.concatenate(a) for a in zip(*held)]
                cut = int(np.flatnonzero(changes(*cols[:3]))[-1])  # the last image's tile may go on
                if cut:
                    yield from rows([a[:cut] for a in cols])
                held, count = [[a[cut:] for a in cols]], len(cols[0]) - cut
        if held:
            yield from rows([np.concatenate(a) for a in zip(*held)])

    return _parted(_dealt(px, down, across), down, across, "c").select("_ty", "_tx", "img", "y", "x", "c", "v").mapInArrow(run, schema)


class Frame:
    """A tile with what lies up to ``reach`` (down, across) around it, over the image's border too.

    ``v`` (planes, rows, cols, channels) has ``fill`` where a pixel is missing and ``outside`` where the border gives none.
    """

    def __init__(self, stack: np.ndarray, there: np.ndarray | None, down: Axis, across: Axis, k: int, l: int, reach: tuple[int, int], border: Border, fill: float, outside: float):
        (self.y, end_y), (self.x, end_x) = down.bounds(k), across.bounds(l)
        self.height, self.width, self.rows, self.cols = end_y - self.y, end_x - self.x, down.size, across.size
        self.reach, self.border = reach, border
        if there is not None and fill:
            stack[~there] = fill
        self.v, self.missing, self.beyond = stack, None if there is None else ~there, None
        for axis, (first, end, n, r, sources) in enumerate(((self.y, end_y, down.size, reach[0], down.sources[k]), (self.x, end_x, across.size, reach[1], across.sources[l])), 1):
            place = np.arange(first - r, end + r)
            edge = (place < 0) | (place >= n)
            place[edge] = [border_index(int(p), n, border) for p in place[edge]]
            at = np.searchsorted(sources, np.maximum(place, sources[0]))
            self.v = np.take(self.v, at, axis)
            self.missing = None if self.missing is None else np.take(self.missing, at, axis)
            if (place < 0).any():
                empty = [slice(None)] * 4
                empty[axis] = place < 0
                self.v[tuple(empty)] = outside
                if self.missing is not None:
                    self.missing[tuple(empty)] = False
                self.beyond = np.zeros(self.v.shape[:0] + (1, self.height + 2 * reach[0], self.width + 2 * reach[1], 1), bool) if self.beyond is None else self.beyond
                side = [slice(None)] * 4
                side[axis] = place < 0
                self.beyond[tuple(side)] = True

    def shift(self, a: np.ndarray, dy: int, dx: int, reach: tuple[int, int] | None = None, more: int = 0) -> np.ndarray:
        """What lies at (dy, dx) from the tile's places (and ``more`` around them), in an array of the given reach."""
        ry, rx = reach or self.reach
        return a[:, ry - more + dy : ry + more + dy + self.height, rx - more + dx : rx + more + dx + self.width]

    def shifts(self, offsets: Sequence[tuple[int, int]], more: int = 0) -> Iterator[np.ndarray]:
        for dy, dx in offsets:
            yield self.shift(self.v, dy, dx, more=more)

    def seen(self, offsets: Sequence[tuple[int, int]]) -> np.ndarray | None:
        """Where at least one pixel lies at the offsets; None if that is everywhere."""
        if self.missing is None and self.beyond is None:
            return None
        gone = np.zeros(self.v.shape, bool)
        for part in (self.missing, self.beyond):
            gone = gone if part is None else gone | part
        return ~np.logical_and.reduce([self.shift(gone, dy, dx) for dy, dx in offsets])

    def near(self) -> np.ndarray | None:
        """Where at least one pixel lies within reach; None if that is everywhere."""
        if self.missing is None:
            return None
        return self.seen([(dy, dx) for dy in range(-self.reach[0], self.reach[0] + 1) for dx in range(-self.reach[1], self.reach[1] + 1)])

    def correlated(self, a: np.ndarray, across: Sequence[float], down: Sequence[float]) -> np.ndarray:
        """Separable correlation with odd kernels, without a border: smaller by their reach."""
        for axis, kernel in ((2, across), (1, down)):
            n = a.shape[axis] - len(kernel) + 1
            cut = lambda j: a[:, :, j : j + n] if axis == 2 else a[:, j : j + n]  # noqa: B023, E731
            a = sum(cut(j) * w for j, w in enumerate(kernel) if w or len(kernel) == 1)
        return a

    def bordered(self, a: np.ndarray, r: int, border: Border | None = None, outside: float = 0.0) -> np.ndarray:
        """Values computed on the tile and ``r`` around it, with the border's where that is outside the image."""
        border = self.border if border is None else border
        for axis, (first, size, n) in enumerate(((self.y, self.height, self.rows), (self.x, self.width, self.cols)), 1):
            place = np.arange(first - r, first + size + r)
            edge = (place < 0) | (place >= n)
            if not edge.any() or border == Border.WRAP:
                continue  # over a wrapped border the values are right already
            place[edge] = [border_index(int(p), n, border) for p in place[edge]]
            a = np.take(a, np.maximum(place - (first - r), 0), axis)
            if (place < 0).any():
                empty = [slice(None)] * 4
                empty[axis] = place < 0
                a[tuple(empty)] = outside
        return a

    def inner(self, margin: int, more: int = 0) -> np.ndarray:
        """Places (and ``more`` around) at least ``margin`` from the image's edge, as (1, rows, cols, 1)."""
        y, x = np.arange(self.y - more, self.y + self.height + more), np.arange(self.x - more, self.x + self.width + more)
        return (((y >= margin) & (y < self.rows - margin))[:, None] & ((x >= margin) & (x < self.cols - margin)))[None, :, :, None]

    def present(self, keep: np.ndarray) -> np.ndarray:
        """``keep``, less the places that have no pixel themselves."""
        return keep if self.missing is None else keep & ~self.shift(self.missing, 0, 0)


def filtered(px: DataFrame, shape: Shape, reach: tuple[int, int], border: Border, kernel: Callable[[Frame], dict[str, np.ndarray]], names: Sequence[str] = ("v",), fill: float = 0.0, outside: float = 0.0, channels: int = 0) -> DataFrame:
    """(img, y, x, c, names) of a kernel over frames."""
    down, across = reaching(shape.rows, reach[0], border), reaching(shape.cols, reach[1], border)
    return by_tile(px, down, across, lambda stack, there, k, l: kernel(Frame(stack, there, down, across, k, l, reach, border, fill, outside)), names, channels)


def along(a: np.ndarray, taps: list[Tap], axis: int, size: int = 0) -> np.ndarray:
    """Weighted sums along an axis, tap by tap in the order of the sources."""
    size = size or 1 + max(t for t, _, _ in taps)
    by_target: list[list[tuple[int, float]]] = [[] for _ in range(size)]
    for t, s, w in sorted(taps):
        by_target[t].append((s, w))
    widest = max(map(len, by_target))
    if widest > WIDE:
        matrix = np.zeros((size, a.shape[axis]))
        t, s, w = zip(*taps)
        np.add.at(matrix, (list(t), list(s)), list(w))
        return np.moveaxis(np.tensordot(a, matrix, (axis, 1)), -1, axis)
    shape = [1] * a.ndim
    shape[axis] = size
    out = None
    for k in range(widest):
        source = np.array([p[k][0] if k < len(p) else 0 for p in by_target])
        weight = np.array([p[k][1] if k < len(p) else 0.0 for p in by_target]).reshape(shape)
        part = np.take(a, source, axis) * weight
        out = part if out is None else out + part
    return out


def separable(a: np.ndarray, across: list[Tap], down: list[Tap]) -> np.ndarray:
    return along(along(a, across, 2), down, 1)


def _local(taps: list[Tap], axis: Axis) -> list[list[Tap]]:
    """The tap table of each tile, in its own numbers."""
    t, s, w = (np.array([x[k] for x in taps]) for k in range(3))
    out = []
    for k in range(axis.tiles):
        a, b = axis.bounds(k)
        own = (t >= a) & (t < b)
        out.append(list(zip((t[own] - a).tolist(), np.searchsorted(axis.sources[k], s[own]).tolist(), w[own].tolist())))
    return out


def tapped(px: DataFrame, shape: Shape, across: list[Tap], down: list[Tap]) -> DataFrame:
    """Separable weighted sums by tap tables. Tables that reach over many tiles go one axis at a time, in stripes of whole rows or columns."""
    axes = of_taps(down, shape.rows), of_taps(across, shape.cols)
    if any(a.tiles > 1 and a.sent > 2 * a.size for a in axes):
        out = Shape(shape.rows, axes[1].starts[-1])
        rows = _by_taps(px, reaching(shape.rows, 0, Border.CONSTANT), Axis(shape.cols, (0, out.cols), (np.arange(shape.cols),)), across, None)
        return _by_taps(rows, Axis(shape.rows, (0, axes[0].starts[-1]), (np.arange(shape.rows),)), reaching(out.cols, 0, Border.CONSTANT), None, down)
    return _by_taps(px, *axes, across, down)


def _by_taps(px: DataFrame, down_axis: Axis, across_axis: Axis, across: list[Tap] | None, down: list[Tap] | None) -> DataFrame:
    xs, ys = _local(across, across_axis) if across else None, _local(down, down_axis) if down else None

    def kernel(stack: np.ndarray, there: np.ndarray | None, k: int, l: int) -> dict[str, np.ndarray]:
        out, seen = stack, None if there is None else there.astype(float)
        for axis, tables, at, size in ((2, xs, l, across_axis), (1, ys, k, down_axis)):
            if tables is None:
                continue
            n = int(np.diff(size.bounds(at))[0])
            out = along(out, tables[at], axis, n)
            if seen is not None:
                seen = along(seen, [(t, s, 1.0) for t, s, w in tables[at] if w] or [(0, 0, 0.0)], axis, n)
        return {"v": out} if seen is None else {"v": out, "_keep": seen > 0}

    return by_tile(px, down_axis, across_axis, kernel)


AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def top_around(frame: Frame, a: np.ndarray) -> np.ndarray:
    """The largest of the eight neighbours, of values on the tile and one place around."""
    return np.maximum.reduce([frame.shift(a, dy, dx, (1, 1)) for dy, dx in AROUND])


PointKernel = Callable[[list[np.ndarray], list[np.ndarray], np.ndarray, tuple[int, int]], np.ndarray]


def at_points(images: Sequence[DataFrame], shape: Shape, points: DataFrame, columns: Sequence[str], kernel: PointKernel, names: Sequence[str], reach: int = 0, place: tuple[str, str] | None = None) -> DataFrame:
    """(img, id, names) of ``kernel``: from a tile of the first channels of an image in each of the tables (with up to ``reach`` around it, inside the image), where pixels
    are, points (rows of ``columns``) and the tile's first row and column, to a row of numbers for each point.

    ``place`` names the points' whole-numbered row and column, which decide their tile; without it an image is one tile.
    """
    if place:
        down, across = (reaching(n, reach, Border.CONSTANT) for n in (shape.rows, shape.cols))
    else:
        down, across = (Axis(n, (0, n), (np.arange(n),)) for n in (shape.rows, shape.cols))
    step = [a.starts[1] for a in (down, across)]
    tile = [F.floor(F.col(p) / s).cast("int") for p, s in zip(place, step)] if place else [F.lit(0), F.lit(0)]
    extra = ("side", "id", "p")
    asked = points.select(F.col("img").cast("long").alias("img"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("x"), F.lit(0).alias("c"), F.lit(None).cast("double").alias("v"), F.lit(-1).alias("side"), F.col("id").cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("p"), tile[0].alias("_ty"), tile[1].alias("_tx"))
    every, tables = asked, len(images)
    for k, px in enumerate(images):
        own = px.where("c = 0").select("img", "y", "x", "c", "v", F.lit(k).alias("side"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("p"))
        every = every.unionByName(_dealt(own, down, across, *extra))

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ty, tx, img, side = (table.column(n).to_numpy() for n in ("_ty", "_tx", "img", "side"))
        starts = np.flatnonzero(changes(ty, tx, img))
        for a, b in zip(starts, np.append(starts[1:], len(img))):
            cut = a + np.searchsorted(side[a:b], np.arange(-1, tables + 1))
            own = table.slice(cut[0], cut[1] - cut[0])
            if not len(own):
                continue
            rows_, cols = down.sources[ty[a]], across.sources[tx[a]]
            stack, there = [], []
            for k in range(tables):
                part = table.slice(cut[k + 1], cut[k + 2] - cut[k + 1])
                at = np.searchsorted(rows_, part.column("y").to_numpy()), np.searchsorted(cols, part.column("x").to_numpy())
                m, on = np.zeros((len(rows_), len(cols))), np.zeros((len(rows_), len(cols)), bool)
                m[at], on[at] = part.column("v").to_numpy(), True
                stack.append(m)
                there.append(on)
            wanted = own.column("p").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
            out = kernel(stack, there, wanted, (int(rows_[0]), int(cols[0])))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), img[a])), own.column("id").combine_chunks(), *(pa.array(np.ascontiguousarray(c, float)) for c in out.T)], names=["img", "id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= STACK:
                    table = pa.Table.from_batches(held)
                    cut = int(np.flatnonzero(changes(*(table.column(n).to_numpy() for n in ("_ty", "_tx", "img"))))[-1])
                    if cut:
                        yield from rows(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield from rows(pa.Table.from_batches(held))

    return _parted(every, down, across, "side").mapInArrow(run, "img long, id long, " + ", ".join(f"{n} double" for n in names))


def bilinear(a: np.ndarray, y: np.ndarray, x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values between pixels, places without a pixel counting as 0, and whether any of the four pixels is there."""
    y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    dy, dx = y - y0, x - x0
    total, seen = np.zeros(y.shape), np.zeros(y.shape, bool)
    for b, a_, w in ((0, 0, (1 - dx) * (1 - dy)), (0, 1, dx * (1 - dy)), (1, 0, (1 - dx) * dy), (1, 1, dx * dy)):
        j, i = y0 + b, x0 + a_
        inside = (j >= 0) & (j < a.shape[0]) & (i >= 0) & (i < a.shape[1])
        j, i = np.clip(j, 0, a.shape[0] - 1), np.clip(i, 0, a.shape[1] - 1)
        inside &= there[j, i]
        total += np.where(inside, a[j, i], 0.0) * w
        seen |= inside
    return total, seen

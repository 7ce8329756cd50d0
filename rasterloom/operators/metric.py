"""Nearest neighbours of query sets too large to broadcast: an exact index of pivots, cells and rings.

``PIVOTS`` rows of a bounded sample are the pivots, and every train row keeps its distances to all of them. Its cell is
its nearest pivot, its ring one of ``RINGS`` bands of equal counts around that pivot. Of each ring the least and the
greatest distance to every pivot are known, so the triangle inequality bounds a query's distance to all of its rows
from below, and from above. A query first visits the ring that promises most; what it finds there limits the rings it
must visit after that. Inside a ring the same bounds leave out stretches of rows, then rows.

Queries and rings meet in parts of bounded size: a large ring is many parts, and so are the queries that ask it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.local import small_table
from ..sources.spool import durable
from .distance import distances, matrix, rowwise

PIVOTS = 32
RINGS = 16
SAMPLE = 2048
TRAIN_PART, QUERY_PART = 1 << 15, 1 << 17
STRETCH = 64
FOUND = "query_idx long, train_idx long, distance double"


def pivots(train: DataFrame, norm: str, most: int = PIVOTS) -> np.ndarray:
    """Rows of a sample (the smallest hashes) that lie far from one another; ``SAMPLE`` rows reach the driver."""
    sample = matrix(train.orderBy(F.xxhash64("idx", F.lit(17)), "idx").limit(SAMPLE).toArrow().column("descriptor").combine_chunks())
    chosen = [0]
    near = distances(sample[:1], sample, norm)[0]
    while len(chosen) < min(most, len(sample)) and np.nanmax(near) > 0:
        chosen.append(int(np.nanargmax(near)))
        near = np.minimum(near, distances(sample[chosen[-1:]], sample, norm)[0])
    return sample[chosen]


def placed(df: DataFrame, centres: np.ndarray, norm: str) -> DataFrame:
    """Rows with their distances to the pivots, cell and distance in it; rows with a component that isn't finite have no neighbours and go."""
    sent = df.sparkSession.sparkContext.broadcast(centres)
    kind = df.schema["descriptor"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                x = matrix(batch.column("descriptor"))
                batch = batch.filter(pa.array(np.isfinite(x).all(1)))
                if batch.num_rows:
                    d = distances(matrix(batch.column("descriptor")), sent.value, norm)
                    cell = d.argmin(1)
                    arrays = [batch.column("idx"), batch.column("descriptor"), pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["idx", "descriptor", "far", "cell", "r"])

    return df.select("idx", "descriptor").mapInArrow(run, f"idx long, descriptor {kind}, far array<double>, cell int, r double").withColumn("n", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Rings:
    """What is known of the rings: at most ``PIVOTS`` * ``RINGS`` of them, so it may be broadcast."""

    centres: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    low: np.ndarray  # (rings, pivots): the least distance of the ring's rows to each pivot
    high: np.ndarray

    def bounds(self, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, rings) distances that no row of the ring falls below, and of each query one that k rows don't exceed."""
        below = np.zeros((len(far), len(self.ids)))
        above = np.full_like(below, np.inf)
        for j in range(far.shape[1]):
            q = far[:, j, None]
            np.maximum(below, np.maximum(q - self.high[:, j], self.low[:, j] - q), out=below)
            np.minimum(above, q + self.high[:, j], out=above)
        order = np.argsort(above, axis=1)
        enough = np.cumsum(self.counts[order], axis=1) >= k
        limit = np.where(enough.any(1), np.take_along_axis(above, order, 1)[np.arange(len(far)), enough.argmax(1)], np.inf)
        return below, limit


def by_ring(train: DataFrame, norm: str) -> tuple[DataFrame, Rings]:
    """The train rows (idx, descriptor, far, r, n) with their ring, and the rings."""
    centres = pivots(train, norm)
    rows = durable(placed(train, centres, norm))
    cuts = [k / RINGS for k in range(1, RINGS)]
    edges = {r["cell"]: r["e"] for r in rows.groupBy("cell").agg(F.percentile_approx("r", cuts, 1000).alias("e")).collect()}
    held = F.array(*[F.array(*[F.lit(float(e)) for e in edges.get(c, [0.0] * len(cuts))]) for c in range(len(centres))])
    passed = F.aggregate(F.element_at(held, F.col("cell") + 1), F.lit(0), lambda s, e: s + (F.col("r") > e).cast("int"))
    rows = rows.withColumn("ring", F.col("cell") * RINGS + passed)
    span = range(len(centres))
    known = rows.groupBy("ring").agg(F.count("*").alias("n"), F.array(*[F.min(F.col("far")[j]) for j in span]).alias("low"), F.array(*[F.max(F.col("far")[j]) for j in span]).alias("high")).orderBy("ring").toArrow()
    low, high = (matrix(known.column(c).combine_chunks()).reshape(known.num_rows, len(centres)) for c in ("low", "high"))
    return rows, Rings(centres, known.column("ring").to_numpy().astype(np.int32), known.column("n").to_numpy(), low, high)


def _slack(limit: np.ndarray) -> np.ndarray:
    """A limit and what rounding may have taken from the bounds."""
    return limit + 1e-9 * (1 + np.abs(limit))


def _asks(queries: DataFrame, rings: Rings, k: int, first: bool) -> DataFrame:
    """Queries once for each ring to visit: the most promising one, or all others within ``tau``."""
    known = queries.sparkSession.sparkContext.broadcast(rings)
    kind = queries.schema["descriptor"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = known.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                far = matrix(batch.column("far"))
                below, limit = r.bounds(far, k)
                home = below.argmin(1)
                if first:
                    q, at = np.arange(len(far)), home
                else:
                    limit = np.fmin(limit, batch.column("tau").to_numpy(zero_copy_only=False))  # none: NaN
                    open_ = ~(below > _slack(limit)[:, None])
                    open_[np.arange(len(far)), home] = False
                    q, at = np.nonzero(open_)
                taken = batch.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([pa.array(r.ids[at]), taken.column("idx"), taken.column("descriptor"), taken.column("far"), pa.array(limit[q]), taken.column("n")], names=["ring", "idx", "descriptor", "far", "limit", "n"])

    columns = ["idx", "descriptor", "far", "n"] + ([] if first else ["tau"])
    return queries.select(*columns).mapInArrow(run, f"ring int, idx long, descriptor {kind}, far array<double>, limit double, n long")


class _Lists:
    """The k best of each query so far: distances, then ids, in ascending order; places not filled are infinite."""

    def __init__(self, queries: int, k: int):
        self.d, self.idx = np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, d: np.ndarray, idx: np.ndarray) -> None:
        """Pairs of a query, a distance and a train id."""
        own = np.unique(q)
        k = self.d.shape[1]
        row = np.concatenate([np.repeat(own, k), q])
        d, idx = np.concatenate([self.d[own].ravel(), d]), np.concatenate([self.idx[own].ravel(), idx])
        order = np.lexsort((idx, d, row))
        row, d, idx = row[order], d[order], idx[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        self.d[row[keep], rank[keep]], self.idx[row[keep], rank[keep]] = d[keep], idx[keep]


def _meet(asked: pa.Table, rows: pa.Table, k: int, norm: str, apart: bool, counted: Accumulator | None) -> pa.Table:
    """The k best rows of a part for each query that asks it, nearest stretches first."""
    names = ["query_idx", "train_idx", "distance"]
    if not asked.num_rows or not rows.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    far = matrix(rows.column("far").combine_chunks())
    order = np.lexsort((rows.column("r").to_numpy(), np.argsort(far, axis=1)[:, min(1, far.shape[1] - 1)]))
    far, ti, t = far[order], rows.column("idx").to_numpy()[order], matrix(rows.column("descriptor").combine_chunks())[order]
    starts = np.arange(0, len(ti), STRETCH)
    low, high = np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts)
    qi, q, qfar, limit = asked.column("idx").to_numpy(), matrix(asked.column("descriptor").combine_chunks()), matrix(asked.column("far").combine_chunks()), asked.column("limit").to_numpy()
    out, compared = [], 0
    for a in range(0, len(qi), 256):
        part = slice(a, a + 256)
        mine, best = qfar[part], _Lists(len(qi[part]), k)
        below = np.maximum(mine[:, None] - high, low - mine[:, None]).max(2)
        for s in np.argsort(below.min(0), kind="stable"):
            tau = _slack(np.minimum(limit[part], best.d[:, -1]))
            alive = np.nonzero(~(below[:, s] > tau))[0]
            if not len(alive):
                continue
            at = slice(starts[s], starts[s] + STRETCH)
            near = ~(np.abs(mine[alive, None] - far[at]).max(2) > tau[alive, None])
            x, y = np.nonzero(near)
            x, y = alive[x], y + starts[s]
            if apart:
                x, y = (v[qi[part][x] != ti[y]] for v in (x, y))
            d = rowwise(q[part][x], t[y], norm)
            compared += len(d)
            good = d <= tau[x]
            if good.any():
                best.add(x[good], d[good], ti[y[good]])
        x, place = np.nonzero(np.isfinite(best.d))
        out.append((qi[part][x], best.idx[x, place], best.d[x, place]))
    if counted is not None:
        counted.add(compared)
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)


def _visit(asks: DataFrame, rows: DataFrame, rings: Rings, k: int, norm: str, apart: bool, counted: Accumulator | None) -> DataFrame:
    """Queries against the rings that they ask, part by part."""
    asks = durable(asks)
    spark = asks.sparkSession
    askers = {r["ring"]: -(-r["count"] // QUERY_PART) for r in asks.groupBy("ring").count().collect()}
    plan = [(int(i), -(-int(n) // TRAIN_PART), askers[int(i)]) for i, n in zip(rings.ids, rings.counts) if int(i) in askers]
    table = F.broadcast(small_table(spark, plan, "ring int, parts int, askers int"))
    t = rows.join(table, "ring").select("ring", F.pmod("n", "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("asker"), "idx", "descriptor", "far", "r")
    q = asks.join(table, "ring").select("ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod("n", "askers").cast("int").alias("asker"), "idx", "descriptor", "far", "limit")
    keys = ["ring", "part", "asker"]
    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(lambda a, b: _meet(a, b, k, norm, apart, counted), FOUND)


def best(queries: DataFrame, train: DataFrame, k: int, norm: str, apart: bool = False, counted: Accumulator | None = None) -> DataFrame:
    """The k nearest train rows of each query: (query_idx, train_idx, distance, rank from 1).

    Takes tables of (idx, descriptor). Equal distances go to the smaller train id; ``apart`` leaves out the query's
    own id. A repeated query id is one query of all its rows; repeated train rows are rows. Rows with a component
    that isn't finite have no neighbours; an empty side gives no rows. ``counted`` adds up the
    exact distances that were needed.
    """
    w = Window.partitionBy("query_idx").orderBy("distance", "train_idx")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if train.isEmpty():
        return ranked(queries.sparkSession.createDataFrame([], FOUND))
    rows, rings = by_ring(train, norm)
    if not len(rings.ids):
        return ranked(queries.sparkSession.createDataFrame([], FOUND))
    need = k + (1 if apart else 0)
    asked = durable(placed(queries, rings.centres, norm))
    home = durable(ranked(_visit(_asks(asked, rings, need, True), rows, rings, k, norm, apart, counted)))
    tau = home.where(F.col("rank") == k).select(F.col("query_idx").alias("idx"), F.col("distance").alias("tau"))
    others = _visit(_asks(asked.join(tau, "idx", "left"), rings, need, False), rows, rings, k, norm, apart, counted)
    return ranked(home.drop("rank").unionByName(others))

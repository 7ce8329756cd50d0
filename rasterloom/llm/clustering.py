"""Operator 11: centroid clustering of whole-number vectors with block-norm screening.

A vector is cut into segments of ``SEGMENT`` components. Its compressed form has two numbers a segment: the mean times
the root of the segment's length, and the norm of what is left of the segment without its mean. By Cauchy and Schwarz the distance of two
compressed vectors is at most that of the vectors themselves, so a centroid whose compressed distance exceeds the exact
distance of the best guess (the centroid nearest in compressed form) can't be nearest. Compressed vectors are computed
once and written beside the vectors; each round screens all centroids with a matrix product of a quarter of the width,
and only pairs that pass get exact distances in integers. Bounds are loosened by more than any rounding of floats, and ties
stay in, so results equal those of all distances (ties: the smaller number).

A round is one pass: each task returns a count and sums for each centroid, which Spark adds up; k rows reach the driver.
Vectors are those with exactly ``dimensions`` components, none null, NaN or infinite; others aren't in the result. A
component x becomes floor(scale * x), held within ``limit_of(dimensions)`` on both sides (over 10**8 for 64 components),
so that no distance leaves 64 bits; sums are exact, and inertia beyond 64 bits stays at the largest long. Repeated rows
and null keys are rows like any other; equal hashes of keys are told apart by their vectors. Fewer vectors than centroids
give as many centroids as vectors; an empty table gives an empty result. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.local import small_table
from .common import durable, tidy

SEGMENT = 8
PAIRS = 1 << 16  # pairs that get exact distances at once
CELLS = 1 << 20  # bounds that are held at once
ROUNDING = 2e-7  # more than compressed vectors in 32 bits and sums in 64 bits can be off, as a share of the norms
LONGEST = (1 << 63) - 1


def limit_of(dimensions: int) -> int:
    """Components within this bound have squared distances under 2**62."""
    return min(math.isqrt((1 << 60) // dimensions), (1 << 31) - 1)


def whole_numbers(vectors: DataFrame, key: str, column: str, dimensions: int, scale: int) -> DataFrame:
    """(id, x): the keys and whole numbers of the vectors that count."""
    most = limit_of(dimensions)
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    whole = lambda e: F.least(F.greatest(F.floor(e.cast("double") * float(scale)), F.lit(-most)), F.lit(most)).cast("int")
    kept = vectors.where((F.size(column) == dimensions) & ~F.exists(column, odd))
    return kept.select(F.col(key).alias("id"), F.transform(column, whole).alias("x"))


def compressed(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Two numbers for each segment, in 32 bits; the last segment is filled up with zeros."""
    n, d = x.shape
    parts = np.pad(x.astype(float), ((0, 0), (0, -d % segment))).reshape(n, -1, segment)
    mean = parts.mean(2)
    rest = np.sqrt(np.square(parts - mean[:, :, None]).sum(2))
    return np.concatenate([mean * math.sqrt(segment), rest], 1).astype(np.float32)


class Screen:
    """Nearest centroids of many vectors; ``tested`` counts the exact distances."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        self.short = compressed(self.centroids).astype(float)
        self.square = np.square(self.short).sum(1)
        self.tested = 0

    def _exact(self, x: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        for a in range(0, len(rows), PAIRS):
            gap = x[rows[a : a + PAIRS]] - self.centroids[to[a : a + PAIRS]]
            out[a : a + PAIRS] = np.einsum("ij,ij->i", gap, gap)
        self.tested += len(rows)
        return out

    def _nearest(self, x: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, short, every = x.astype(np.int64), short.astype(float), np.arange(len(x))
        own = np.square(short).sum(1)
        bound = np.sqrt(np.maximum(own[:, None] + self.square - 2 * (short @ self.short.T), 0))
        bound -= ROUNDING * (np.sqrt(own)[:, None] + np.sqrt(self.square))
        guess = bound.argmin(1)
        best = self._exact(x, every, guess)
        open_ = bound <= np.sqrt(best.astype(float))[:, None] * (1 + 1e-12)
        open_[every, guess] = False
        rows, to = np.nonzero(open_)
        table = np.full(open_.shape, LONGEST)
        table[every, guess] = best
        table[rows, to] = self._exact(x, rows, to)
        label = table.argmin(1)  # the first of equals
        return label, table[every, label]

    def nearest(self, x: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid."""
        step = max(1, CELLS // len(self.centroids))
        found = [self._nearest(x[a : a + step], short[a : a + step]) for a in range(0, len(x), step)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, kind)[o[0] // 4 : o[-1] // 4].reshape(len(column), width)


def prepared(rows: DataFrame, dimensions: int) -> DataFrame:
    """(id, x, short) with vectors and their compressed forms as bytes, written to the shared folder."""
    width = 4 * 2 * -(-dimensions // SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().astype("<i4").reshape(batch.num_rows, dimensions)
                packed = [pa.array([m[i].tobytes() for i in range(len(m))], pa.binary()) for m in (x, compressed(x).astype("<f4"))]
                assert packed[1][0].as_buffer().size == width
                yield pa.RecordBatch.from_arrays([batch.column("id"), *packed], names=["id", "x", "short"])

    return durable(rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, x binary, short binary"))


def _screened(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    centroids = sent.value
    screen, dimensions = Screen(centroids), centroids.shape[1]
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"), "<i4", dimensions)
            yield (batch, x, *screen.nearest(x, _matrix(batch.column("short"), "<f4", screen.short.shape[1])))


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid as the componentwise floor of its vectors' mean; one without vectors stays."""
    k, dimensions = len(centroids), len(centroids[0])
    sent = rows.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)

        def row() -> pa.RecordBatch:
            there = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([[counts[j], *sums[j]] for j in there], pa.list_(pa.int64()))], names=["label", "sums"])

        for _, x, label, _ in _screened(batches, sent):
            np.add.at(sums, label, x)
            np.add.at(counts, label, 1)
            if counts.sum() >= 1 << 31:  # sums stay under 2**63
                yield row()
                sums[:], counts[:] = 0, 0
        yield row()

    per_task = rows.select("x", "short").mapInArrow(tidy(run), "label int, sums array<bigint>")
    totals = per_task.select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()
    found: dict[int, dict[int, int]] = {}
    for label, i, v in totals:
        found.setdefault(label, {})[i] = int(v)
    return [[found[j][i + 1] // found[j][0] for i in range(dimensions)] if j in found else c for j, c in enumerate(centroids)]


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    sent = rows.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, label, distance in _screened(batches, sent):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(label.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def first_centroids(whole: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors whose keys, after ``salt``, have the smallest SHA-256, in that order."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) for r in whole.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()]


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, salt: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of every vector that counts, the final centroids)."""
    whole = whole_numbers(vectors, key, column, dimensions, scale)
    centroids = first_centroids(whole, k, salt)
    rows = prepared(whole, dimensions)
    if not centroids:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    return assigned(rows, centroids), centroids


def cluster_report(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", **options) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector; ``options`` as in ``cluster``."""
    found, centroids = cluster(vectors, key, column, **options)
    found = durable(found)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    whole = min(sum(sums.values()), LONGEST)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(j, min(sums.get(j, 0), LONGEST), whole, digest(c)) for j, c in enumerate(centroids)]
    table = small_table(found.sparkSession, facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return found.join(F.broadcast(table), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

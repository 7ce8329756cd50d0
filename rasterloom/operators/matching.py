"""Descriptor matching: queries against all train rows.

A query set of at most ``BLOCK_BYTES`` of descriptors is broadcast; every train task computes its distances to it slice
by slice, keeps the best k of each query while it reads, and sends these at its end; Spark merges them by query. A
larger one goes through the exact index of ``metric``. Nothing is joined with everything, and no task sends more than
k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.spool import durable
from ..types import MatrixError
from . import metric
from .distance import distances, matrix

BLOCK_BYTES = 16 << 20
SLICE = 1024


class Nearest:
    """The k nearest train rows of each query so far; equal distances go to the smaller index."""

    def __init__(self, queries: int, k: int):
        self.k, self.worst = k, np.full(queries, np.inf)
        self.row, self.idx, self.d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, first: int, d: np.ndarray, idx: np.ndarray) -> None:
        """Distances of the queries from ``first`` on to the train rows ``idx``."""
        limit = self.worst[first : first + len(d)]
        if d.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        row, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        self.waiting.append((row + first, idx[col], d[row, col]))
        if sum(len(w[0]) for w in self.waiting) > 4 * self.k * len(self.worst) + 1000:
            self.merge()

    def merge(self) -> None:
        row, idx, d = (np.concatenate([own, *(w[n] for w in self.waiting)]) for n, own in enumerate((self.row, self.idx, self.d)))
        self.waiting = []
        order = np.lexsort((idx, d, row))
        row, idx, d = row[order], idx[order], d[order]
        start = np.searchsorted(row, np.arange(len(self.worst)))
        keep = np.arange(len(row)) - start[row] < self.k
        self.row, self.idx, self.d = row[keep], idx[keep], d[keep]
        full = np.bincount(self.row, minlength=len(self.worst)) == self.k
        last = np.searchsorted(self.row, np.arange(len(self.worst)), side="right") - 1
        self.worst[full] = self.d[last[full]]


def _packed(df: DataFrame, idx: str, descriptor: str, norm: str) -> DataFrame:
    kind = "short" if norm == "hamming" else "double"
    return df.select(F.col(idx).cast("long").alias("idx"), F.transform(descriptor, lambda x: x.cast(kind)).alias("descriptor"))


def _best(queries: DataFrame, train: DataFrame, k: int, norm: str, apart: bool = False, index: bool | None = None) -> DataFrame:
    """The k nearest train rows of each query: (query_idx, train_idx, distance, rank from 1); ``apart``: not itself."""
    there = "idx is not null and descriptor is not null"  # others have no neighbours
    queries, train = queries.where(there), train.where(there)
    if index is None:
        index = (queries.agg(F.sum(F.size("descriptor") * 8 + 8)).first()[0] or 0) > BLOCK_BYTES
    if index:
        return metric.best(queries, train, k, norm, apart)
    table = queries.toArrow()  # BLOCK_BYTES at most
    ids = table.column("idx").to_numpy()
    sent = queries.sparkSession.sparkContext.broadcast((ids, matrix(table.column("descriptor").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, q = sent.value
        best = Nearest(len(qi), k)
        for whole in batches:
            for start in range(0, whole.num_rows if len(qi) else 0, SLICE):
                batch = whole.slice(start, SLICE)
                ti, t = batch.column("idx").to_numpy(), matrix(batch.column("descriptor"))
                for a in range(0, len(q), 256):
                    d = distances(q[a : a + 256], t, norm)
                    if apart:
                        d[qi[a : a + 256, None] == ti[None, :]] = np.inf
                    best.add(a, d, ti)
        if len(qi):
            best.merge()
            yield pa.RecordBatch.from_arrays([pa.array(qi[best.row]), pa.array(best.idx), pa.array(best.d)], names=["query_idx", "train_idx", "distance"])

    w = Window.partitionBy("query_idx").orderBy("distance", "train_idx")
    return train.mapInArrow(run, metric.FOUND).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_match(queries: DataFrame, train: DataFrame, k: int, norm: str = "l2", idx: str = "idx", descriptor: str = "descriptor", apart: bool = False, index: bool | None = None) -> DataFrame:
    """(query_idx, rank, train_idx, distance); equal distances go to the smaller index; ``apart``: no row matches itself.

    ``index`` chooses the way, which doesn't change the result; by default the size of the query set does.
    """
    return _best(_packed(queries, idx, descriptor, norm), _packed(train, idx, descriptor, norm), k, norm, apart, index).select("query_idx", "rank", "train_idx", "distance")


def match_descriptors(queries: DataFrame, train: DataFrame, norm: str = "l2", cross_check: bool = False, idx: str = "idx", descriptor: str = "descriptor", apart: bool = False) -> DataFrame:
    """(query_idx, train_idx, distance) of the nearest train row; with ``cross_check`` only mutual nearest pairs."""
    nearest = knn_match(queries, train, 1, norm, idx, descriptor, apart).drop("rank")
    return mutual(durable(nearest), queries, train, norm, idx, descriptor, apart) if cross_check else nearest


def mutual(nearest: DataFrame, queries: DataFrame, train: DataFrame, norm: str = "l2", idx: str = "idx", descriptor: str = "descriptor", apart: bool = False) -> DataFrame:
    """Those of the ``nearest`` pairs (query_idx, train_idx, distance) whose train row has no nearer query."""
    q, t = _packed(queries, idx, descriptor, norm), _packed(train, idx, descriptor, norm)
    # Only train rows that are someone's nearest can be mutual: they are the query set of the way back.
    asked = t.join(nearest.select(F.col("train_idx").alias("idx")).distinct(), "idx", "left_semi")
    back = _best(asked, q, 1, norm, apart).select(F.col("query_idx").alias("train_idx"), F.col("train_idx").alias("query_idx"))
    return nearest.join(back, ["query_idx", "train_idx"], "left_semi")


def filter_matches(matches: DataFrame, ratio: float) -> DataFrame:
    """Nearest matches that are closer than ``ratio`` times the second nearest, from ``knn_match`` with k of 2 or more."""
    w = Window.partitionBy("query_idx").orderBy("rank")
    return matches.withColumn("_next", F.lead("distance").over(w)).where((F.col("rank") == 1) & (F.col("distance") < F.lit(ratio) * F.col("_next"))).select("query_idx", "train_idx", "distance")


def compute_distance(pairs: DataFrame, a: str, b: str, norm: str = "l2") -> DataFrame:
    """``pairs`` with the distance of two array columns, by array functions."""
    if norm == "l2":
        d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    elif norm == "hamming":
        d = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("int").bitwiseXOR(y.cast("int")))), F.lit(0), lambda s, x: s + x).cast("double")
    else:
        raise MatrixError(f"no norm {norm}")
    return pairs.withColumn("distance", d)

"""Groups of rows as arrays in tasks: one exchange brings a group together, as packed chunks; groups that are too large for that stay spread."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.spool import durable
from .dense import changes

WHOLE = 1 << 18  # rows of a group that one task takes at once
HELD, CHUNK = 1 << 18, 1 << 15  # rows that a task packs at once, and that a chunk has at most


def by_size(points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(group, n_points) of all groups, the rows of groups that fit a task, and those of larger ones (None: there are none)."""
    counts = durable(points.groupBy("group").agg(F.count("*").alias("n_points")))
    large = counts.where((F.col("n_points") > WHOLE) & F.col("group").isNotNull()).select("group")
    known = points.where(F.col("group").isNotNull())
    if large.isEmpty():
        return counts, known, None
    return counts, known.join(F.broadcast(large), "group", "left_anti"), points.join(F.broadcast(large), "group", "left_semi")


def packed(points: DataFrame, columns: Sequence[str], words: Sequence[str] = ()) -> DataFrame:
    """(group, data): chunks of rows of the group; ``columns`` as doubles, and ``words`` (longs) as they are, of 8 bytes each."""
    every = (*columns, *words)

    def chunks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        cols = [np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) for n in ("group", *every)]
        order = np.argsort(cols[0], kind="stable")
        group = cols[0][order]
        data = np.empty((len(order), len(every)))
        for k, c in enumerate(cols[1:]):
            data[:, k] = c.view(np.float64)[order]
        new = np.flatnonzero(changes(group))
        size = np.diff(np.append(new, len(group)))
        parts = -(-size // CHUNK)
        cut = np.repeat(new, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * CHUNK
        ends = (np.append(cut, len(group)) * 8 * len(every)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(group[cut]), pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(data)])], names=["group", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= HELD:
                    yield chunks(held)
                    held = []
        if held:
            yield chunks(held)

    return points.select(F.col("group").cast("long").alias("group"), *[F.col(c).cast("double").alias(c) for c in columns], *words).mapInArrow(pack, "group long, data binary")


Fit = Callable[[int, np.ndarray, "list[float] | None"], tuple]


def in_tasks(points: DataFrame, columns: Sequence[str], words: Sequence[str], fit: Fit, schema: str, given: DataFrame | None = None) -> DataFrame:
    """A row (group first) of ``fit`` for each group: from its number, its rows as an array (``packed``) and what ``given`` (group, model) has for it."""
    none = F.lit(None).cast("array<double>").alias("model")
    chunks = packed(points, columns, words).select("group", "data", none)
    if given is not None:
        chunks = chunks.unionByName(given.where("group is not null").select(F.col("group").cast("long").alias("group"), F.lit(None).cast("binary").alias("data"), F.col("model").cast("array<double>").alias("model")))
    names = [f.strip().split()[0] for f in schema.split(",")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    types = [kinds[f.strip().split()[1]] for f in schema.split(",")]

    def told(group: int, parts: list[bytes], model: list[float] | None) -> list[tuple]:
        if not parts:
            return []  # a given model of a group without rows
        data = np.frombuffer(b"".join(parts), np.float64).reshape(-1, len(columns) + len(words))
        return [(group, *fit(group, data, model))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, model = None, [], None
        for batch in batches:
            rows: list[tuple] = []
            for group, data, own in zip(batch.column("group").to_pylist(), batch.column("data"), batch.column("model").to_pylist()):
                if group != now:
                    rows += told(now, parts, model)
                    now, parts, model = group, [], None
                if data.is_valid:
                    parts.append(data.as_buffer())
                else:
                    model = own
            if rows:
                yield table(rows)
        if parts:
            yield table(told(now, parts, model))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), types)], names=names)

    return chunks.repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)

"""Helpers that the operators share: durable cuts of lineage, Arrow text access, bounded batches and memory."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

T = TypeVar("T")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; where none is set, a local session (tests) gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir isn't set: executors need a shared folder")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


_kept: dict[object, object] = {}


def kept(name: object, make: Callable[[], T]) -> T:
    """What this Python worker needs again in its next tasks: one thing at a time, the last one asked for."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow. Spark uses Python workers again: when a task ends, its memory goes back to the system,
    and, unless ``run`` ``keeps`` something for the next task, what earlier operators have kept."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _kept.clear()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return whole


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so lost executors cost no recomputation.

    The shuffle files that this took go as soon as it is written. Spark notes how when a plan is made, so the plan
    is made anew here, and nobody else has it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, memoryview]:
    """Offsets and UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return o, memoryview(data) if data is not None else memoryview(b"")


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row; null counts as empty."""
    o, data = text_buffers(column)
    for a, b in zip(o[:-1].tolist(), o[1:].tolist()):
        yield bytes(data[a:b])


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its text reaches ``most_bytes``; a longer single text is a slice of its own."""
    o, _ = text_buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(o, o[start] + most_bytes, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def crc_fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


BATCH_BYTES = 6 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark send Python at most ``BATCH_BYTES`` at a time (the default is 64 MB), unless less is set already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, in parts enough for all cores, to be sent to Python in bounded batches."""
    bounded_batches(spark)
    return read_table(spark, sf_dir, name, spread=True)


def side_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Labels and benchmarks, as they are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def text_key(column: str):
    """A 64-bit fingerprint of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""A bit table of fixed size over 64-bit keys, to leave rows out before a shuffle; false positives only cost work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

BITS = 1 << 25  # 4 MB, however many keys


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of all keys, OR-ed together by Spark; at most BITS / 64 words reach the driver."""
    place = keys.select(F.shiftrightunsigned(F.col(column), 39).alias("p"))  # keys are hashes: their top bits are as good as any
    words = place.selectExpr("cast(shiftright(p, 6) as int) as w", "shiftleft(1L, cast(p & 63 as int)) as b")
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(BITS // 64, np.uint64)
    table[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
    return table


def maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (uint64) may be in the table."""
    place = keys >> np.uint64(39)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def maybe_in(df: DataFrame, table: np.ndarray, once: bool = True, inside: bool = True, key: str = "text_key") -> DataFrame:
    """Rows whose key may be (``inside``) or surely isn't in the table; ``once``: rows of equal keys once a task."""
    sent = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            take = np.flatnonzero(maybe(sent.value, keys.view(np.uint64)) == inside).tolist()
            if once:
                take = [i for i in take if keys[i] not in seen and not seen.add(keys[i])]
            if take:
                yield batch.take(pa.array(take, pa.int64()))

    return df.mapInArrow(tidy(run), df.schema)

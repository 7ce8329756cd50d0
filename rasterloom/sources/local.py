"""Small tables from Python rows as local relations: no job is needed to broadcast them, and plans show their size."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def small_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """Rows of plain numbers and strings."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = [(f.name, kinds[f.dataType.simpleString()]) for f in StructType.fromDDL(ddl)]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table({n: pa.array(list(c), k) for (n, k), c in zip(fields, columns)}))

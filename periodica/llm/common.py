"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The strings of an Arrow column as UTF-8; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of one text column, so that a worker's arrays stay small.

    A single longer text still comes whole, alone in its batch.
    """
    for batch in batches:
        sizes = np.fromiter((x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()), np.int64, batch.num_rows)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names an operator is about to set (names compare as Spark compares them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer name if ``df`` has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def plus_longs(df: DataFrame, *names: str) -> StructType:
    """The schema of ``df`` with more columns of longs at the end."""
    return StructType([*df.schema.fields, *[StructField(n, LongType()) for n in names]])

"""Reading inputs defensively and keeping intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.session import scratch_path

# Rows handled at once inside a Python task; bounds memory, not results.
SLICE_ROWS = 1000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str):
    """``name`` as ``kind``, found without regard to duplicate or dotted neighbours."""
    return df[f"`{name}`"].cast(kind).alias(name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and scan it from there.

    Later jobs read the files, so a lost executor repeats a read and not the
    work before it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_bytes(df: DataFrame, *keys: tuple[str, str], text: str = "text") -> DataFrame:
    """The key columns and the text as UTF-8 bytes."""
    return df.select(*[column(df, k, t) for k, t in keys], F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

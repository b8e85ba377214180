"""Class counts per day over a stream of scored posts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postpulse.operators.trend import CLASS_COLUMNS
from postpulse.sources.folders import folders, move_folder

COUNTS_SCHEMA = T.StructType(
    [T.StructField("day", T.DateType()), *[T.StructField(c, T.LongType()) for c in CLASS_COLUMNS.values()]]
)


def stream_daily_counts(scored: DataFrame, watermark: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``by, day, neg, neu, pos`` from ``date, label``.

    State is one row per (group, day).  Without a ``watermark`` no row is late and
    every day stays open, which update and complete mode report.  With one, append
    mode emits a day once it is closed, and rows of closed days are left out.
    Roll days up to months with :func:`postpulse.operators.trend.roll_up_months`.
    """
    counts = [F.count_if(F.col("label") == value).alias(name) for value, name in CLASS_COLUMNS.items()]
    timed = scored.withWatermark("date", watermark) if watermark else scored
    daily = timed.groupBy(*by, F.window("date", "1 day").alias("window")).agg(*counts)
    return daily.select(*by, F.to_date(F.col("window.start")).alias("day"), *CLASS_COLUMNS.values())


def store_daily_counts(
    scored: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the counts of all days seen so far below ``path``; by default drain the feed and stop.

    Each micro-batch writes the days it changed into a folder of its own, so a
    batch repeated after a failure replaces its own rows.  A query with a new
    checkpoint counts from the start; its folders stand apart from older ones.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        run = _run_of(spark, path, query)
        batch.write.mode("overwrite").parquet(f"{path}/batches/{run}/batch={number}")

    return (
        stream_daily_counts(scored)
        .writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _run_of(spark: SparkSession, path: str, query: str) -> str:
    """The folder of a query: named by its first batch's time, so that the newest query comes last."""
    known = [name for name in folders(spark, f"{path}/batches") if name.endswith(query)]
    return known[0] if known else f"run={int(time.time() * 1000):015d}-{query}"


def _newest(spark: SparkSession, path: str) -> tuple[str | None, int]:
    """(the newest run's folder, the batch up to which its snapshot reaches or -1)."""
    runs = folders(spark, f"{path}/batches")
    if not runs:
        return None, -1
    upto = [int(name.removeprefix("upto=")) for name in folders(spark, f"{path}/snapshots/{runs[-1]}")]
    return runs[-1], max(upto, default=-1)


def _latest_counts(spark: SparkSession, path: str, run: str, upto: int) -> DataFrame:
    """``day, neg, neu, pos, batch`` of a run: its snapshot and the batches after it."""
    schema = T.StructType([*COUNTS_SCHEMA, T.StructField("batch", T.LongType())])
    # the batch number is a folder name: older batches are listed but not read
    rows = spark.read.schema(schema).parquet(f"{path}/batches/{run}").filter(F.col("batch") > upto)
    if upto >= 0:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/snapshots/{run}/upto={upto}"))
    latest = F.max_by(F.struct(*CLASS_COLUMNS.values()), "batch").alias("c")
    return rows.groupBy("day").agg(latest, F.max("batch").alias("batch")).select("day", "c.*", "batch")


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """``day, neg, neu, pos``: the latest counts of every day, open or closed, of the newest query.

    Reads one snapshot and the batches after it; counts of an older query below
    the same path are never served.
    """
    run, upto = _newest(spark, path)
    if run is None:
        return spark.createDataFrame([], COUNTS_SCHEMA)
    return _latest_counts(spark, path, run, upto).drop("batch")


def compact_daily_counts(spark: SparkSession, path: str) -> int:
    """Write a snapshot of the newest query's days; returns the batch that it reaches, or -1.

    The snapshot is written aside and appears under its name by one rename, so a
    reader sees the old state or the new one.  Nothing is deleted.
    """
    run, upto = _newest(spark, path)
    if run is None:
        return -1
    reached = max(int(name.removeprefix("batch=")) for name in folders(spark, f"{path}/batches/{run}"))
    if reached > upto:
        aside = f"{path}/snapshots/_{uuid.uuid4().hex}"
        counts = _latest_counts(spark, path, run, upto).filter(F.col("batch") <= reached)
        counts.coalesce(1).write.parquet(aside)  # a row per day
        move_folder(spark, aside, f"{path}/snapshots/{run}/upto={reached}")
    return reached

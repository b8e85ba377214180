"""Continuous ingest of landed listing files into the stored post table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from postpulse.operators.ingest import dedupe_first_seen, new_posts, only_sources_of, to_posts
from postpulse.sources.posts import append_posts, read_stored
from postpulse.sources.schemas import LISTING_SCHEMA


def read_listing_stream(
    spark: SparkSession,
    path: str,
    file_format: str = "json",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Landed listing files as a stream."""
    reader = spark.readStream.schema(LISTING_SCHEMA).format(file_format)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def store_batch(batch: DataFrame, table: str) -> None:
    """Append what one batch adds: first sightings whose ID is not stored yet.

    Running the same batch again adds nothing, so a batch repeated after a
    failure is harmless.  Only the directories of the batch's sources are read.
    """
    # used twice; without this each use would read the landed files again
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        posts = to_posts(dedupe_first_seen(batch))
        stored = read_stored(batch.sparkSession, table)
        append_posts(new_posts(posts, only_sources_of(stored, batch)), table)
    finally:
        batch.unpersist()


def stream_ingest(
    listings: DataFrame,
    table: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the ingest query; by default it drains what has landed and stops.

    Within a batch the listing priority decides which sighting is kept.  Across
    batches the stored table does, however old a post is: listings such as "top of
    all time" bring posts that are years older than the newest.
    """
    return (
        listings.writeStream.foreachBatch(lambda batch, _: store_batch(batch, table))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

"""Landed listing dumps: one row per (source, listing, position)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postpulse.sources.schemas import LISTING_SCHEMA


def read_listings(spark: SparkSession, path: str | list[str], file_format: str = "json") -> DataFrame:
    """Scan landed dumps (``json`` lines or ``parquet``) with a fixed schema."""
    return spark.read.schema(LISTING_SCHEMA).format(file_format).load(path)


def write_listings(listings: DataFrame, path: str, file_format: str = "json") -> None:
    """Land a dump; used by collectors and by tests."""
    columns = LISTING_SCHEMA.fieldNames()
    # a post stands in several listings: the wider window finds its text again
    packed = {"compression": "zstd"} if file_format == "parquet" else {}
    listings.select(*columns).write.mode("append").format(file_format).options(**packed).save(path)

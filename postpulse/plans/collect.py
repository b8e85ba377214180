"""Batch jobs: landed listings to the stored table, stored table to clean posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postpulse.functions.posts import MAX_BODY_CHARS
from postpulse.operators.clean import clean_posts, route_analysis, route_training
from postpulse.operators.ingest import dedupe_first_seen, limit_per_listing, new_posts, to_posts
from postpulse.sources.catalog import ANALYSIS_SOURCE
from postpulse.sources.listings import read_listings
from postpulse.sources.posts import append_posts, read_stored


def collect(
    spark: SparkSession,
    landed: str,
    table: str,
    file_format: str = "json",
    limit: int | None = None,
) -> None:
    """Append every landed post that is not stored yet; running it twice adds nothing."""
    listings = limit_per_listing(read_listings(spark, landed, file_format), limit)
    posts = to_posts(dedupe_first_seen(listings))
    append_posts(new_posts(posts, read_stored(spark, table)), table)


def clean(
    posts: DataFrame,
    analysis_source: str = ANALYSIS_SOURCE,
    max_chars: int | None = MAX_BODY_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """(training posts, analysis posts).

    Two filters over one lazy plan; on a stored table each becomes a partition
    filter, so nothing is cached.
    """
    cleaned = clean_posts(posts, max_chars)
    return route_training(cleaned, analysis_source), route_analysis(cleaned, analysis_source)

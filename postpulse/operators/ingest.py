"""Ingest: cap, de-duplicate and anti-join landed listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postpulse.functions.posts import default_body, epoch_to_utc

# The order in which listings are visited; the first sighting wins.
LISTING_ORDER = (
    ("top", "all"),
    ("top", "year"),
    ("top", "month"),
    ("controversial", "all"),
    ("controversial", "year"),
    ("controversial", "month"),
    ("hot", None),
    ("rising", None),
    ("new", None),
)


def listing_rank() -> Column:
    """Position of a row's listing in :data:`LISTING_ORDER`; unknown listings come last."""
    rank = F.when(F.lit(False), F.lit(0))
    for number, (listing, time_filter) in enumerate(LISTING_ORDER):
        matches = F.col("listing") == listing
        if time_filter is not None:
            matches = matches & (F.col("time_filter") == time_filter)
        rank = rank.when(matches, number)
    return rank.otherwise(len(LISTING_ORDER))


def union_listings(*listings: DataFrame) -> DataFrame:
    """All listings in one frame; columns are matched by name."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), listings)


def limit_per_listing(listings: DataFrame, limit: int | None = None, salts: int = 64) -> DataFrame:
    """The first ``limit`` rows of every (source, listing, time filter) by position.

    Runs in two rounds so that a source holding much of the data is never
    ranked by one task: each of ``salts`` slices keeps its own first ``limit``
    rows, then at most ``salts * limit`` rows per listing are ranked.  Spark
    also drops surplus rows before either shuffle.
    """
    if limit is None:
        return listings
    keys = ["subreddit", "listing", "time_filter"]
    order = [F.col("position").asc(), F.col("id").asc()]
    sliced = W.partitionBy(*keys, "_salt").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    return (
        listings.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(sliced))
        .filter(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= limit)
        .drop("_salt", "_rank")
    )


def dedupe_first_seen(listings: DataFrame) -> DataFrame:
    """One row per (source, id): the sighting in the earliest listing and position.

    Each task keeps one row per id before the shuffle, so an id repeated in a
    large share of the rows costs one row per task.  Sightings at the same place,
    as two dumps of one listing have them, are decided by the newer creation time
    and then by the text, so the result does not depend on how rows are dealt
    out.  ``listing_rank`` and
    ``position`` stay in the result: ordered by them, rows are in first-seen order.
    """
    first = W.partitionBy("subreddit", "id").orderBy(
        "listing_rank", "position", F.desc("created_utc"), "title", "selftext", "listing", "time_filter"
    )
    return (
        listings.withColumn("listing_rank", listing_rank())
        .withColumn("_seen", F.row_number().over(first))
        .filter(F.col("_seen") == 1)
        .drop("_seen")
    )


def to_posts(listings: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Listing items to stored posts ``subreddit, ID, title, content, date``.

    Inside Spark a missing body stays null (``keep_missing``); the ``N/A`` text
    is only wanted when the rows go to a CSV file.
    """
    body = F.nullif(F.col("selftext"), F.lit(""))
    date = F.timestamp_seconds(F.floor("created_utc"))
    if not keep_missing:
        body, date = default_body("selftext"), epoch_to_utc("created_utc")
    return listings.select(
        "subreddit",
        F.col("id").alias("ID"),
        "title",
        body.alias("content"),
        date.alias("date"),
    )


def new_posts(posts: DataFrame, stored: DataFrame) -> DataFrame:
    """Posts whose (source, ID) is not stored yet.

    Only the two key columns of the stored table are read.  An ID may repeat
    across sources, so the source is part of the key.  A missing source or ID
    equals another missing one, so such posts are not stored twice either.
    """
    known = stored.select(F.col("subreddit").alias("_source"), F.col("ID").alias("_known"))
    return posts.join(known, F.expr("subreddit <=> _source AND ID <=> _known"), "left_anti")


def only_sources_of(stored: DataFrame, batch: DataFrame, max_sources: int = 1000) -> DataFrame:
    """Prune the stored table to the sources of a small batch.

    Turns into partition pruning on the source directories.  With more than
    ``max_sources`` sources the list would not be small, so nothing is pruned.
    """
    names = batch.select("subreddit").distinct().limit(max_sources + 1).collect()
    if len(names) > max_sources:
        return stored
    known = [row["subreddit"] for row in names if row["subreddit"] is not None]
    kept = F.col("subreddit").isin(known)
    return stored.filter(kept | F.col("subreddit").isNull() if len(known) < len(names) else kept)

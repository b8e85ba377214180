"""Cleaning and routing of collected posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.functions.posts import MAX_BODY_CHARS, strip_entity, truncate_body
from postpulse.sources.catalog import ANALYSIS_SOURCE


def drop_missing(posts: DataFrame) -> DataFrame:
    """Rows that have both a title and a body."""
    return posts.na.drop(subset=["title", "content"])


def clean_posts(posts: DataFrame, max_chars: int | None = MAX_BODY_CHARS) -> DataFrame:
    """Drop incomplete posts, cut bodies to ``max_chars``, then remove the entity.

    The cut comes first, so an entity on the boundary leaves a stub and a body
    may end up shorter than the limit.  ``max_chars=None`` keeps whole bodies.
    """
    posts = drop_missing(posts)
    body = F.col("content")
    if max_chars is not None:
        body = truncate_body(body, max_chars)
    return posts.withColumn("content", strip_entity(body))


def union_sources(*sources: DataFrame) -> DataFrame:
    """Stack per-source tables by column name; nothing is de-duplicated across sources."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), sources)


def route_analysis(posts: DataFrame, source: str = ANALYSIS_SOURCE) -> DataFrame:
    """The source whose trend is analysed."""
    return posts.filter(F.col("subreddit") == source)


def route_training(posts: DataFrame, source: str = ANALYSIS_SOURCE) -> DataFrame:
    """Every other source: the material labels and models are made from."""
    return posts.filter(F.col("subreddit") != source)

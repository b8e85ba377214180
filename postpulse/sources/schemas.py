"""Explicit schemas: nothing in this library infers types from data."""

from pyspark.sql import types as T

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("subreddit", T.StringType()),
        T.StructField("listing", T.StringType()),
        T.StructField("time_filter", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
    ]
)

# One file per source; identifiers stay text even when they are all digits.
POST_FILE_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("date", T.StringType()),
    ]
)

LABELLED_FILE_SCHEMA = T.StructType(
    POST_FILE_SCHEMA.fields + [T.StructField("sentiment", T.StringType())]
)

STORED_POST_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("subreddit", T.StringType()),
    ]
)

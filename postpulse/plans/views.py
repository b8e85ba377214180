"""The library's inputs (posts, labels, listings, scored posts) seen in generic tables.

Every view covers its whole table; nothing is filtered, cut or sampled here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.functions.labels import NO_SENTIMENT
from postpulse.functions.posts import combined_text
from postpulse.functions.text import normalise_tokens
from postpulse.session import apply_settings, spread
from postpulse.sources.schemas import LISTING_SCHEMA

ANALYSIS = "src0"


class Tables:
    """Generic Parquet tables of one directory, and post views over them."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = apply_settings(spark)
        self.directory = directory.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def posts(self) -> DataFrame:
        """``documents`` as posts: the title is the first line, the body the whole text."""
        return self.table("documents").select(
            F.col("source").alias("subreddit"),
            F.col("doc_id").cast("string").alias("ID"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("content"),
            _post_date().alias("date"),
        )

    def chat_posts(self) -> DataFrame:
        """``conversations`` as posts of one source per role."""
        return self.table("conversations").select(
            F.concat(F.lit("chat-"), "role").alias("subreddit"),
            F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("ID"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("content"),
        )

    def sentiments(self) -> DataFrame:
        """``ID, sentiment`` from ``labels``: toxic is negative, quality 0 positive, the rest neutral."""
        sentiment = (
            F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 0, "positive").otherwise("neutral")
        )
        return self.table("labels").select(
            F.col("doc_id").cast("string").alias("ID"), sentiment.alias("sentiment")
        )

    def labelled(self) -> DataFrame:
        """Posts with ``sentiment``; documents without a label are ``neither``."""
        joined = self.posts().join(self.sentiments(), "ID", "left")
        return joined.withColumn("sentiment", F.coalesce("sentiment", F.lit(NO_SENTIMENT)))

    def texts(self) -> DataFrame:
        """``subreddit, ID, date, text``: title and body, with contractions written into the prose."""
        body = F.col("content")
        for found, written in ((" and ", " don't "), (" of ", " it's "), (" to ", " cannot ")):
            body = F.replace(body, F.lit(found), F.lit(written))
        posts = spread(self.posts(), "ID")
        return posts.select("subreddit", "ID", "date", combined_text("title", body).alias("text"))

    def docs(self) -> DataFrame:
        """``subreddit, ID, date, tokens``."""
        return self.texts().select("subreddit", "ID", "date", normalise_tokens("text").alias("tokens"))

    def labelled_docs(self) -> DataFrame:
        """Tokenised documents that carry one of the three sentiments."""
        # only documents with a label are tokenised
        labelled = self.texts().join(self.sentiments(), "ID")
        return labelled.select("ID", "subreddit", "date", normalise_tokens("text").alias("tokens"), "sentiment")

    def scored(self) -> DataFrame:
        """``orders`` as scored posts: status F, O, P stands for -1, 0, 1."""
        label = F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderstatus") == "O", 0)
        return self.table("orders").select(
            F.col("o_orderkey").alias("ID"),
            F.col("o_orderpriority").alias("subreddit"),
            F.col("o_orderdate").cast("timestamp").alias("date"),
            label.when(F.col("o_orderstatus") == "P", 1).alias("label"),
        )

    def scored_events(self) -> DataFrame:
        """``events`` as scored posts."""
        return self.table("events").select(*scored_event_columns())

    def listings(self) -> DataFrame:
        """``documents`` as landed listing items: each one appears in every listing it qualifies for."""
        en, long = F.col("lang") == "en", F.col("n_chars") >= 1000
        by_length, by_id = F.lit(10_000_000) - F.col("n_chars"), F.col("doc_id")
        entries = [
            ("top", "all", en & long, by_length),
            ("top", "year", en, by_length),
            ("top", "month", long, by_length),
            ("controversial", "all", F.col("lang") == "de", by_id),
            ("controversial", "year", F.col("lang").isin("de", "fr"), by_id),
            ("controversial", "month", F.col("lang") == "fr", by_length),
            ("hot", None, ~long, by_length),
            ("rising", None, F.col("lang") == "es", by_id),
            ("new", None, F.lit(True), by_id),
        ]
        sightings = F.array(
            *[
                F.when(
                    member,
                    F.struct(
                        F.lit(listing).alias("listing"),
                        F.lit(time_filter).cast("string").alias("time_filter"),
                        position.cast("bigint").alias("position"),
                    ),
                )
                for listing, time_filter, member, position in entries
            ]
        )
        rows = self.table("documents").select(
            F.col("source").alias("subreddit"),
            F.explode(F.filter(sightings, lambda s: s.isNotNull())).alias("s"),
            F.col("doc_id").cast("string").alias("id"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.when(F.col("lang") == "fr", "").otherwise(F.col("text")).alias("selftext"),
            (F.unix_seconds(_post_date()) + F.lit(0.75)).alias("created_utc"),
        )
        return rows.select("*", "s.listing", "s.time_filter", "s.position").select(*LISTING_SCHEMA.fieldNames())

    def lexicon(self) -> DataFrame:
        """``token, tag, lemma`` read off the word endings that occur in the documents."""
        token = F.col("token")
        tag = (
            F.when(token.endswith("ing"), "VBG")
            .when(token.endswith("est"), "JJS")
            .when(token.endswith("ly"), "RB")
            .when(token.endswith("th"), "IN")
            .when(token.endswith("s"), "NNS")
            .otherwise("NN")
        )
        words = self.docs().select(F.explode_outer("tokens").alias("token")).filter(token.isNotNull()).distinct()
        lemma = F.regexp_replace("token", "(.)(ing|est|ly|th|s)$", "$1")
        return words.select("token", tag.alias("tag"), lemma.alias("lemma"))


def scored_event_columns() -> list[Column]:
    kind = F.col("event_type")
    label = F.when(kind == "error", -1).when(kind.isin("view", "click"), 0)
    return [
        F.col("ts").cast("timestamp").alias("date"),
        label.when(kind.isin("purchase", "signup"), 1).alias("label"),
    ]


def _post_date() -> Column:
    days = F.make_dt_interval((F.col("doc_id") % 2000).cast("int"))
    return F.to_timestamp(F.lit("2019-01-01 00:00:00")) + days

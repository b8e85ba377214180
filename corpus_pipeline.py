"""From raw documents to a deduplicated, decontaminated training mix, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postpulse.llm import decontaminate, mixing, ngram_join, quality, substring_dedup
from postpulse.llm.tables import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# Classifier, sampled mix: SQL cannot express them; the stages are tested against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    labels = table(spark, sf_dir, "labels").withColumn("label", F.col("quality"))
    return quality.keep_good(docs.select(*COLUMNS), quality.fit(quality.vectors(docs), labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar five-word shingles the one with the smallest doc_id.

    Rows without doc_id all stay, as nothing names the one to keep.
    """
    linked = ngram_join.link(docs, ngram_join.Rule(words=5, percent=80))
    kept = linked.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(*COLUMNS).join(kept.hint("merge"), F.expr("doc_id = kept_id"), "left")
    rows = rows.filter("kept_id is not null or doc_id is null").drop("kept_id")
    # repeated rows of one document are a group too
    repeat = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang", "n_chars")
    return rows.withColumn("_row", F.row_number().over(repeat)).filter("_row = 1 or doc_id is null").select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of an earlier document; a document of which nothing is left goes."""
    cut = substring_dedup.remove_passages(docs, carry=[docs[c] for c in ("doc_id", "lang", "source", "n_chars")])
    left = cut.filter("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: one row per copy of a document, with its shard, shuffled inside shards."""
    plan = mixing.plan_mix(docs.select(*COLUMNS))
    return mixing.mixed_rows(plan).select(*COLUMNS, "shard", "copy", "size", "source_size", "target")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources to target weights", mixed_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a stored table that the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

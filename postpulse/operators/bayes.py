"""Complement naive Bayes as joins and aggregates.

The model is a table with one row per term, so neither the vocabulary nor the
weights pass through the driver and both may outgrow one machine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.functions.labels import SENTIMENTS
from postpulse.operators.features import KEY, fit_vocabulary, term_freq, weigh_terms
from postpulse.operators.lookup import MAX_BROADCAST_TERMS, lookup_join
from postpulse.session import cut_lineage


@dataclass
class ComplementBayes:
    """``weights(term, df, idf, w array<double>)`` in the order of ``classes``."""

    weights: DataFrame
    rows: int
    classes: tuple[str, ...]
    max_n: int = 1

    def save(self, path: str) -> None:
        spark = self.weights.sparkSession
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        meta = [(self.rows, list(self.classes), self.max_n)]
        frame = spark.createDataFrame(meta, "rows bigint, classes array<string>, max_n int")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ComplementBayes:
        meta = spark.read.parquet(f"{path}/meta").first()
        weights = spark.read.parquet(f"{path}/weights")
        return cls(weights, meta["rows"], tuple(meta["classes"]), meta["max_n"])


def class_term_sums(weights: DataFrame, classes: Sequence[str] = SENTIMENTS, label: str = "sentiment") -> DataFrame:
    """``term`` with one summed weight column per class."""
    weight = F.col("weight")
    sums = [
        F.sum(F.when(F.col(label) == c, weight).otherwise(0.0)).alias(f"sum_{i}") for i, c in enumerate(classes)
    ]
    return weights.groupBy("term").agg(*sums)


def fit_bayes(
    docs: DataFrame,
    alpha: float = 1.0,
    terms: str = "tokens",
    label: str = "sentiment",
    key: Sequence[str] = KEY,
    classes: Sequence[str] = SENTIMENTS,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    max_n: int = 1,
) -> ComplementBayes:
    """Fit on labelled documents; ``terms`` already holds the n-grams up to ``max_n``.

    Tokens are read twice (vocabulary, weights), so they are written once first.
    """
    docs = cut_lineage(docs.select(*key, label, terms), "tokens")
    tf = term_freq(docs, terms, key, carry=[label])
    vocabulary, rows = fit_vocabulary(tf, docs.count(), min_df, max_df)
    weights = weigh_terms(tf, vocabulary, key, rows)
    sums = cut_lineage(class_term_sums(weights, classes, label))
    columns = [F.col(f"sum_{i}") for i in range(len(classes))]
    together = sum(columns[1:], columns[0])
    rest = [together - c + F.lit(alpha) for c in columns]
    totals = sums.agg(*[F.sum(r).alias(f"t{i}") for i, r in enumerate(rest)]).first()
    model = F.array(*[-F.log(r / F.lit(totals[f"t{i}"])) for i, r in enumerate(rest)])
    table = vocabulary.join(sums, "term").select("term", "df", "idf", model.alias("w"))
    return ComplementBayes(table, rows, tuple(classes), max_n)


def _best_class(scores: list[Column], classes: Sequence[str]) -> Column:
    """The class with the highest score; the first one on ties."""
    top = F.greatest(*scores)
    best = F.lit(classes[-1])
    for score, name in reversed(list(zip(scores[:-1], classes[:-1]))):
        best = F.when(score == top, F.lit(name)).otherwise(best)
    return best


def predict_bayes(
    docs: DataFrame,
    model: ComplementBayes,
    terms: str = "tokens",
    key: Sequence[str] = KEY,
    carry: Sequence[str] = (),
    max_broadcast: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """``key, carry, predicted`` for every document, also those without a known term.

    The score is linear in the term occurrences and dividing by a document's
    norm does not change its best class, so no per-term counts are needed: each
    task reduces a document to one row of sums over the terms that are broadcast,
    all of them or the most frequent; only words outside those are shuffled.
    """
    columns = [*key, *carry]
    placed = docs.select(*columns, terms)
    if model.rows > max_broadcast:
        # read once for frequent and once for rare terms
        placed = cut_lineage(placed, "to-score")
    words = placed.select(*columns, F.explode_outer(terms).alias("term"))
    table = cut_lineage(model.weights.select("term", "idf", "w"), "weights") if model.rows > max_broadcast else model.weights.select("term", "idf", "w")
    joined = lookup_join(words, table, "term", "left", model.rows, max_broadcast, rarity="idf")
    sums = [
        F.sum(F.coalesce(F.col("idf") * F.col("w")[i], F.lit(0.0))).alias(f"_s{i}")
        for i in range(len(model.classes))
    ]
    scored = joined.groupBy(*columns).agg(*sums)
    scores = [F.col(f"_s{i}") for i in range(len(model.classes))]
    return scored.select(*columns, _best_class(scores, model.classes).alias("predicted"))

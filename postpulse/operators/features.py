"""Term statistics and TF-IDF as joins and aggregates.

Documents are shuffled once, by key, as token arrays; counting terms, weighting
and the per-document norm then stay inside their partition.  The only other
shuffle is the small one that sums per term after map-side combination.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postpulse.operators.lookup import MAX_BROADCAST_TERMS, lookup_join
from postpulse.session import cut_lineage

KEY = ("subreddit", "ID")


def term_freq(docs: DataFrame, terms: str = "tokens", key: Sequence[str] = KEY, carry: Sequence[str] = ()) -> DataFrame:
    """``key, carry, term, tf``; ``carry`` columns depend on the key (a label, a date)."""
    columns = [*key, *carry]
    placed = docs.select(*columns, terms).repartition(*key)
    # explode_outer: a plain explode makes the optimiser repeat the token expression in a filter
    words = placed.select(*columns, F.explode_outer(terms).alias("term")).filter(F.col("term").isNotNull())
    return words.groupBy(*columns, "term").agg(F.count("*").alias("tf"))


def doc_freq(
    tf: DataFrame,
    n_docs: int | Column | None = None,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
) -> DataFrame:
    """``term, df``, pruned: whole numbers are document counts, fractions are shares of ``n_docs``."""
    df = F.col("df")
    counts = tf.groupBy("term").agg(F.count("*").alias("df"))

    def bound(value):
        if not isinstance(value, float):
            return F.lit(value)
        if n_docs is None:
            raise ValueError("a fractional bound needs n_docs")
        share = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
        return F.lit(value) * share

    if min_df not in (0, 1) or isinstance(min_df, float):
        counts = counts.filter(df >= bound(min_df))
    if not (isinstance(max_df, float) and max_df == 1.0):
        counts = counts.filter(df <= bound(max_df))
    return counts


def smooth_idf(n_docs: int | Column, df: Column | str = "df") -> Column:
    """``ln((1 + n) / (1 + df)) + 1``."""
    df = F.col(df) if isinstance(df, str) else df
    n_docs = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return F.log((1 + n_docs) / (1 + df)) + 1


def weigh_terms(
    tf: DataFrame,
    vocabulary: DataFrame,
    key: Sequence[str] = KEY,
    vocabulary_rows: int | None = None,
    max_broadcast: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """L2-normalised ``weight`` for each (document, term) of the vocabulary.

    ``vocabulary`` holds ``term, idf``; the norm is taken over known terms only.  Rows
    of :func:`term_freq` lie by key: entries of broadcast terms are not shuffled for it.
    """
    raw = lookup_join(tf, vocabulary.select("term", "idf"), "term", "inner", vocabulary_rows, max_broadcast, rarity="idf", far_by=key)
    raw = raw.withColumn("_w", F.col("tf") * F.col("idf")).drop("idf")
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(*key)))
    return raw.withColumn("weight", F.col("_w") / norm).drop("_w")


def fit_vocabulary(
    tf: DataFrame, n_docs: int, min_df: int | float = 1, max_df: int | float = 1.0
) -> tuple[DataFrame, int]:
    """(``term, df, idf`` on reliable storage, its row count)."""
    counts = doc_freq(tf, n_docs, min_df, max_df)
    vocabulary = cut_lineage(counts.withColumn("idf", smooth_idf(n_docs)))
    return vocabulary, vocabulary.count()


def tfidf(
    docs: DataFrame,
    terms: str = "tokens",
    key: Sequence[str] = KEY,
    carry: Sequence[str] = (),
    min_df: int | float = 1,
    max_df: int | float = 1.0,
) -> DataFrame:
    """``key, carry, term, tf, weight``: TF-IDF fitted on ``docs`` and applied to them.

    Tokens are read twice (vocabulary, weights), so they are written once first.
    """
    docs = cut_lineage(docs.select(*key, *carry, terms), "tokens")
    tf = term_freq(docs, terms, key, carry)
    vocabulary, rows = fit_vocabulary(tf, docs.count(), min_df, max_df)
    return weigh_terms(tf, vocabulary, key, rows)

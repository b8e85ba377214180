"""Batch job: clean posts of one or many sources to monthly trends."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.functions.labels import label_numeric
from postpulse.operators.bayes import ComplementBayes, predict_bayes
from postpulse.operators.learning import TextModel, predict
from postpulse.operators.trend import (
    date_histogram,
    monthly_counts,
    monthly_proportions,
    trend_regression,
)
from postpulse.plans.train import KEY, tokens_of
from postpulse.session import cut_lineage


@dataclass
class AnalysisReport:
    """Tables behind the trend report."""

    scored: DataFrame
    proportions: DataFrame
    regression: DataFrame
    histogram: DataFrame


def score_posts(
    posts: DataFrame,
    model: TextModel | ComplementBayes,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """``subreddit, ID, date, label`` for every post that has a title and a body."""
    docs = tokens_of(posts, lexicon).select(*KEY, "date", "tokens")
    if isinstance(model, ComplementBayes):
        guessed = predict_bayes(docs, model, carry=["date"])
    else:
        guessed = predict(docs, model)
    return guessed.select(*KEY, "date", label_numeric("predicted").alias("label"))


def analyse(
    posts: DataFrame,
    model: TextModel | ComplementBayes,
    lexicon: DataFrame | None = None,
    by: Sequence[str] = (),
) -> AnalysisReport:
    """Score posts and fit the trend of each class share, per ``by`` group.

    Scores are written once: the histogram and the monthly counts both read them.
    """
    scored = cut_lineage(score_posts(posts, model, lexicon))
    proportions = monthly_proportions(monthly_counts(scored, by))
    return AnalysisReport(
        scored=scored.select(*KEY, F.col("date"), F.col("label")),
        proportions=proportions,
        regression=trend_regression(proportions, by),
        histogram=date_histogram(scored),
    )

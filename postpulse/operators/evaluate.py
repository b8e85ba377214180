"""Scores and confusion counts of predicted labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.functions.labels import SENTIMENTS


def confusion(
    predictions: DataFrame,
    labels: Sequence[str] = SENTIMENTS,
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    """``actual`` with one count column per predicted label; zero cells present.

    Actual labels outside ``labels`` have a row too; rows without an actual label have none.
    """
    ordered = sorted(labels)
    counts = predictions.filter(F.col(actual).isNotNull()).groupBy(actual).agg(
        *[F.count_if(F.col(predicted) == name).alias(name) for name in ordered]
    )
    return _label_rows(predictions, ordered, actual).join(counts, actual, "full").na.fill(0, ordered)


def confusion_long(
    predictions: DataFrame,
    labels: Sequence[str] = SENTIMENTS,
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    """The same counts as ``actual, predicted, n`` rows."""
    ordered = sorted(labels)
    wide = confusion(predictions, ordered, actual, predicted)
    return wide.unpivot([actual], ordered, predicted, "n")


def _label_rows(predictions: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    one = predictions.sparkSession.range(1)
    return one.select(F.explode(F.array(*[F.lit(label) for label in labels])).alias(name))


def accuracy(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """``n, correct, accuracy``."""
    hit = F.col(actual) == F.col(predicted)
    counts = predictions.agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"))
    return counts.withColumn("accuracy", F.try_divide("correct", "n"))


def micro_f1(
    predictions: DataFrame,
    labels: Sequence[str] = SENTIMENTS,
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    """``tp, fp, fn, micro_f1`` pooled over ``labels``."""
    truth, guess = F.col(actual), F.col(predicted)
    known_truth, known_guess = truth.isin(*labels), guess.isin(*labels)
    same = truth.eqNullSafe(guess)
    counts = predictions.agg(
        F.count_if(known_guess & same).alias("tp"),
        F.count_if(known_guess & ~same).alias("fp"),
        F.count_if(known_truth & ~same).alias("fn"),
    )
    score = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.withColumn("micro_f1", score)

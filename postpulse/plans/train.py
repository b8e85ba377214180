"""Batch jobs: clean posts to labelled posts, labelled posts to saved models."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.functions.posts import combined_text
from postpulse.functions.text import STOPWORDS, normalise_tokens
from postpulse.operators.clean import drop_missing
from postpulse.operators.evaluate import confusion
from postpulse.operators.labelling import Scorer, label_by_bucket, label_posts, merge_neither
from postpulse.operators.learning import (
    DEFAULT_ITERATIONS,
    MODEL_NAMES,
    TextModel,
    predict,
    random_search,
    save_model,
)
from postpulse.operators.lexicon import lemmatise
from postpulse.operators.sampling import split_exact, undersample
from postpulse.session import cut_lineage

KEY = ("subreddit", "ID")
FAST_MODELS = ("cNB",)  # the one that trains quickly and did best


@dataclass
class TrainReport:
    """One trained model with its hold-out accuracy and confusion counts."""

    model: TextModel
    setting: dict
    search_score: float
    accuracy: float
    confusion: DataFrame


def label(posts: DataFrame, scorer: Scorer, partitions: int | None = None, path: str | None = None) -> DataFrame:
    """Clean posts with a ``sentiment`` column, stored: every post is scored once, whatever reads the labels.

    With ``path`` the labels are kept there, and a restart asks for those that are missing.
    """
    if path:
        return label_by_bucket(posts, scorer, path)
    return cut_lineage(label_posts(posts, scorer, partitions), "labels")


def tokens_of(
    posts: DataFrame,
    lexicon: DataFrame | None = None,
    stopwords: Iterable[str] = STOPWORDS,
) -> DataFrame:
    """Add ``tokens``: the one text chain that training and analysis share."""
    docs = drop_missing(posts).withColumn("tokens", normalise_tokens(combined_text(), stopwords))
    return docs if lexicon is None else lemmatise(docs, lexicon)


def training_set(
    labelled: DataFrame,
    lexicon: DataFrame | None = None,
    merge_mode: str = "relabel",
    seed: int = 0,
    cap: bool = False,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """Balanced ``key, sentiment, tokens``.

    Sampling comes before the text chain, so only kept posts are tokenised.
    In ``overwrite_row`` mode the overwritten rows share one key; they are drawn
    by their original key, kept in ``row_subreddit`` and ``row_id``.
    """
    origin = ("row_subreddit", "row_id")
    named = drop_missing(labelled).select(
        "*", F.col("subreddit").alias(origin[0]), F.col("ID").alias(origin[1])
    )
    merged = merge_neither(named, merge_mode, keep=origin)
    balanced = undersample(merged, key=origin, seed=seed, cap=cap)
    rows = balanced.select(
        F.col(origin[0]).alias("subreddit"), F.col(origin[1]).alias("ID"), "title", "content", "sentiment"
    )
    return tokens_of(rows, lexicon).select(*key, "sentiment", "tokens")


def train(
    labelled: DataFrame,
    directory: str | None = None,
    models: Sequence[str] = MODEL_NAMES,
    lexicon: DataFrame | None = None,
    n_iter: int = DEFAULT_ITERATIONS,
    folds: int = 5,
    seed: int = 0,
    grids: Mapping[str, Mapping] | None = None,
    merge_mode: str = "relabel",
    cap: bool = False,
    parallelism: int = 4,
) -> dict[str, TrainReport]:
    """Balance, split 80/20, search, evaluate and (with ``directory``) save each model.

    The balanced token table is written to reliable storage once, because the
    search reads it many times.
    """
    docs = cut_lineage(training_set(labelled, lexicon, merge_mode, seed, cap))
    inside, held_out = split_exact(docs, 0.2, KEY, seed)
    reports = {}
    for name in models:
        found = random_search(inside, name, n_iter, folds, seed, (grids or {}).get(name), parallelism, KEY)
        guessed = predict(held_out, found.model).withColumnRenamed("sentiment", "actual")
        guessed = cut_lineage(guessed.select(*KEY, "actual", "predicted"))
        hits = guessed.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double"))).first()[0]
        if directory:
            save_model(found.model, directory, name)
        reports[name] = TrainReport(found.model, found.best, found.best_score, hits, confusion(guessed))
    return reports

"""Expressions around weak sentiment labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label set, sorted, and the question put to a labelling model.
SENTIMENTS = ("negative", "neutral", "positive")
NO_SENTIMENT = "neither"
PROMPT_HEAD = (
    "Judge if following reddit post is about computer science career, "
    'is it a positive, negative, neutral or neither if not about career?: "'
)
PROMPT_TAIL = '" - answer in 1 word'


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def label_prompt(text: Column | str) -> Column:
    """The question asked about one post."""
    return F.concat(F.lit(PROMPT_HEAD), _col(text), F.lit(PROMPT_TAIL))


def normalise_label(answer: Column | str) -> Column:
    """Free-text answer to one of four labels.

    The leftmost whole word among the three sentiments wins, in any case;
    everything else, a missing answer included, is ``neither``.
    """
    pattern = r"(?U)\b(negative|neutral|positive)\b"
    found = F.regexp_extract(F.lower(_col(answer)), pattern, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(NO_SENTIMENT))


def label_numeric(sentiment: Column | str) -> Column:
    """negative, neutral, positive to -1, 0, 1; anything else to null."""
    sentiment = _col(sentiment)
    return (
        F.when(sentiment == "negative", -1)
        .when(sentiment == "neutral", 0)
        .when(sentiment == "positive", 1)
    )

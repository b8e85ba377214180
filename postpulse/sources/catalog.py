"""Which sources play which role.  All functions take the lists as parameters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default sources to collect, to clean and to analyse.
COLLECTED_SOURCES = (
    "cscareerquestions",
    "csMajors",
    "cscareerquestionsCAD",
    "cscareers",
    "cscareerquestionsEU",
    "developersIndia",
    "cscareerquestionsuk",
    "computerscience",
    "cscareerquestionsOCE",
    "learnprogramming",
    "DevelEire",
    "dataengineering",
    "ITCareerQuestions",
    "compsci",
    "AskComputerScience",
    "ExperiencedDevs",
    "webdev",
)
CLEANING_SOURCES = (
    "csMajors",
    "cscareerquestionsCAD",
    "cscareerquestionsEU",
    "developersIndia",
    "cscareerquestionsuk",
    "computerscience",
    "ExperiencedDevs",
    "webdev",
)
ANALYSIS_SOURCE = "csMajors"


def source_catalog(
    spark: SparkSession,
    collected: Iterable[str] = COLLECTED_SOURCES,
    cleaning: Iterable[str] = CLEANING_SOURCES,
    analysis: str = ANALYSIS_SOURCE,
) -> DataFrame:
    """``subreddit, collected, role``: a small dimension, one row per source."""
    collected, cleaning = set(collected), set(cleaning)
    names = sorted(collected | cleaning | {analysis})
    rows = [(name, name in collected, name in cleaning) for name in names]
    frame = spark.createDataFrame(rows, "subreddit string, collected boolean, cleaned boolean")
    role = (
        F.when(F.col("subreddit") == analysis, "analysis")
        .when(F.col("cleaned"), "training")
        .otherwise("unused")
    )
    return frame.select("subreddit", "collected", role.alias("role"))

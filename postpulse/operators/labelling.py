"""Weak labels: ask a scorer, normalise its answers, merge classes."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postpulse.functions.labels import NO_SENTIMENT, label_prompt, normalise_label
from postpulse.functions.posts import combined_text
from postpulse.session import scratch_path
from postpulse.sources.folders import exists, folders

PROMPTS_AT_ONCE = 500
Scorer = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def keyword_scorer(
    positive: Iterable[str] = ("great", "good", "happy", "love", "thanks"),
    negative: Iterable[str] = ("bad", "hate", "worthless", "terrible", "fail"),
) -> Scorer:
    """A deterministic stand-in for a language model, for tests and dry runs.

    Takes prompts, answers in free text.  A real scorer has the same shape and
    loads its model once per Python worker, before the first batch.
    """
    words = {word: "Positive." for word in positive} | {word: "Negative." for word in negative}
    pattern = r"\b(" + "|".join(sorted(words)) + r")\b"

    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            hits = prompts.str.lower().str.extract(pattern, expand=False)
            yield hits.map(words).fillna("Neutral")

    return answer


def _in_slices(scorer: Scorer) -> Scorer:
    """``scorer`` with at most ``PROMPTS_AT_ONCE`` prompts in a batch, which bounds what it copies."""

    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts: deque[int] = deque()

        def slices() -> Iterator[pd.Series]:
            for prompts in batches:
                counts.append(max(1, -(-len(prompts) // PROMPTS_AT_ONCE)))
                for i in range(counts[-1]):
                    yield prompts.iloc[i * PROMPTS_AT_ONCE : (i + 1) * PROMPTS_AT_ONCE]

        held: list[pd.Series] = []
        for answers in scorer(slices()):
            held.append(answers)
            if len(held) == counts[0]:
                counts.popleft()
                yield pd.concat(held, ignore_index=True)
                held = []

    return answer


def label_posts(
    posts: DataFrame,
    scorer: Scorer,
    partitions: int | None = None,
    null_as_nan_text: bool = True,
) -> DataFrame:
    """Add ``sentiment`` by asking ``scorer`` about every post, in Arrow batches.

    Scoring is far slower than reading, so ``partitions`` may spread few large
    input splits over more tasks.
    """
    # an answer may vary, so the optimiser must not ask again in filters or planning
    ask = F.pandas_udf(_in_slices(scorer), T.StringType()).asNondeterministic()
    if partitions:
        posts = posts.repartition(partitions)
    text = combined_text(null_as_nan_text=null_as_nan_text)
    answers = posts.withColumn("_answer", ask(label_prompt(text)))
    return answers.withColumn("sentiment", normalise_label("_answer")).drop("_answer")


def label_by_bucket(posts: DataFrame, scorer: Scorer, path: str, buckets: int = 64, key: Sequence[str] = ("subreddit", "ID")) -> DataFrame:
    """Posts with ``sentiment``, kept below ``path``: a restart asks only about posts without a stored label.

    Posts are dealt to ``buckets`` by their key, and each bucket's answers are
    committed by a job of its own, so a failure costs the answers of one bucket.
    Posts of one key are one post, a missing key is a value like others.
    """
    spark = posts.sparkSession
    schema = T.StructType([*posts.schema.fields, T.StructField("sentiment", T.StringType())])
    kept = f"{path}/labels"

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(kept) if exists(spark, kept) else spark.createDataFrame([], schema)

    known = stored().select(*[F.col(c).alias(f"_{c}") for c in key])
    same = reduce(lambda a, b: a & b, [posts[c].eqNullSafe(known[f"_{c}"]) for c in key])
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    missing = posts.join(known, same, "left_anti").dropDuplicates(list(key)).withColumn("_bucket", bucket)
    todo = scratch_path(spark, "to-label")
    missing.write.partitionBy("_bucket").parquet(todo)
    waiting = spark.read.schema(missing.schema).parquet(todo)
    for name in folders(spark, todo):
        number = int(name.removeprefix("_bucket="))
        mine = waiting.filter(F.col("_bucket") == number).drop("_bucket")
        label_posts(mine, scorer).select(*schema.fieldNames()).write.mode("append").parquet(kept)
    return stored()


def merge_neither(posts: DataFrame, mode: str = "relabel", keep: Iterable[str] = ()) -> DataFrame:
    """Fold ``neither`` into ``neutral``.

    ``relabel`` changes the label alone.  ``overwrite_row`` also replaces every
    other column of such rows with the text ``neutral``, as results produced by
    row-wide assignment have it; all columns become text.  Columns named in
    ``keep`` are left alone.
    """
    is_neither = F.col("sentiment") == NO_SENTIMENT
    if mode == "relabel":
        return posts.withColumn("sentiment", F.when(is_neither, "neutral").otherwise(F.col("sentiment")))
    if mode == "overwrite_row":
        kept = set(keep)
        return posts.select(
            *[
                F.col(c) if c in kept else F.when(is_neither, "neutral").otherwise(F.col(c).cast("string")).alias(c)
                for c in posts.columns
            ]
        )
    raise ValueError(f"unknown mode {mode!r}: use 'relabel' or 'overwrite_row'")


def of_class(posts: DataFrame, *classes: str) -> DataFrame:
    """Rows whose label is one of ``classes``."""
    return posts.filter(F.col("sentiment").isin(*classes))

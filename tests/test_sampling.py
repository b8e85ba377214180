import collections

import pytest
from conftest import values
from pyspark.sql import functions as F

from postpulse.operators import sampling
from postpulse.operators.sampling import (
    add_class_weight,
    class_weights,
    rank_thresholds,
    row_hash,
    sample_exact,
    split_by_hash,
    split_exact,
    stratified_folds,
    undersample,
)

SCHEMA = "subreddit string, ID string, sentiment string"


def labelled(frame, **sizes):
    rows = [("s", f"{name}{i}", name) for name, n in sizes.items() for i in range(n)]
    return frame(rows, SCHEMA)


def test_undersample_is_exact_and_repeatable(frame):
    df = labelled(frame, neutral=10, positive=3, negative=2)
    drawn = undersample(df)
    assert collections.Counter(values(drawn, "sentiment")) == {"neutral": 3, "positive": 3, "negative": 2}
    assert sorted(values(undersample(df.repartition(7)))) == sorted(values(drawn))
    assert sorted(values(undersample(df, seed=1))) != sorted(values(drawn))


def test_undersample_refuses_or_caps_a_small_pool(frame):
    df = labelled(frame, neutral=2, positive=3)
    with pytest.raises(ValueError):
        undersample(df)
    assert collections.Counter(values(undersample(df, cap=True), "sentiment")) == {"neutral": 2, "positive": 3}


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 4999, 5000])
def test_thresholds_match_a_full_sort(spark, n, monkeypatch):
    monkeypatch.setattr(sampling, "PREFIX_STEP", 1)
    monkeypatch.setattr(sampling, "SMALL_PREFIX", 4)
    df = spark.range(5000).withColumnRenamed("id", "k")
    ordered = sorted(values(df.select(row_hash(["k"]).alias("h")), "h"))
    assert rank_thresholds(df, {None: [n]}, ["k"])[(None, n)] == ordered[n - 1]
    assert sample_exact(df, n, ["k"]).count() == n


def test_duplicate_keys_are_refused(frame):
    df = frame([("a",)] * 50 + [("b",)] * 50, "k string")
    with pytest.raises(ValueError, match="unique"):
        sample_exact(df, 10, ["k"])
    big = frame([("a",)] * 500, "k string")
    with pytest.raises(ValueError, match="unique"):
        sample_exact(big, 10, ["k"])


@pytest.mark.parametrize("n, held", [(1, 1), (5, 1), (6, 2), (100, 20), (101, 21)])
def test_exact_split_rounds_up(spark, n, held):
    df = spark.range(n).withColumnRenamed("id", "k")
    train, valid = split_exact(df, 0.2, ["k"])
    assert (train.count(), valid.count()) == (n - held, held)
    assert train.intersect(valid).count() == 0


def test_hash_split_is_complete_and_stable(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    train, valid = split_by_hash(df, 0.2, ["k"])
    assert train.count() + valid.count() == 10_000 and 1800 < valid.count() < 2200
    more = split_by_hash(spark.range(20_000).withColumnRenamed("id", "k"), 0.2, ["k"])[1]
    assert sorted(values(more.filter("k < 10000"), "k")) == sorted(values(valid, "k"))


def test_folds_are_stratified(frame):
    df = labelled(frame, neutral=203, positive=11, negative=3)
    counts = collections.Counter(values(stratified_folds(df).select("sentiment", "fold")))
    for name, n in (("neutral", 203), ("positive", 11), ("negative", 3)):
        sizes = [counts[(name, fold)] for fold in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_weights(frame):
    df = labelled(frame, neutral=6, positive=2, negative=1)
    got = {r["sentiment"]: r["weight"] for r in class_weights(df).collect()}
    assert got == {"neutral": 9 / 18, "positive": 9 / 6, "negative": 9 / 3}
    total = add_class_weight(df).agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(9)

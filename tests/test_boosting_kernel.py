"""Boosted trees against a plain implementation, the kernel map against its kernel."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import vector_to_array

from postpulse.operators import boosting, kernel
from postpulse.operators.boosting import Setting, fit_boosted, predict_boosted
from postpulse.operators.term_index import with_vectors

SCHEMA = "i int, label int, ids array<bigint>, weights array<double>"


def sparse(frame, matrix, labels):
    rows = [(i, int(k), [j for j, x in enumerate(row) if x], [float(x) for x in row if x]) for i, (row, k) in enumerate(zip(matrix, labels))]
    return frame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    rnd = np.random.default_rng(5)
    matrix = rnd.integers(0, 5, (150, 6)) * (rnd.random((150, 6)) < 0.6) / 4
    labels = (matrix[:, 0] > 0.3).astype(int) + (matrix[:, 1] + matrix[:, 2] > 0.9)
    labels[rnd.random(150) < 0.1] = 0
    return sparse(spark.createDataFrame, matrix, labels).repartition(4).cache(), matrix, labels


def brute(matrix, labels, classes, setting):
    """One split at a time, over every column and every value."""
    n = len(matrix)
    margins = np.tile(np.log(np.bincount(labels, minlength=classes) / n), (n, 1))
    for _ in range(setting.rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        residual = np.eye(classes)[labels] - p
        step = np.zeros_like(margins)
        for k in range(classes):
            r = residual[:, k]

            def leaf(rows, r=r):
                return (classes - 1) / classes * r[rows].sum() / (abs(r[rows]) * (1 - abs(r[rows]))).sum()

            def grow(rows, depth, k=k, r=r):
                best = (0.0, None)
                if depth < setting.depth:
                    for j in range(matrix.shape[1]):
                        for bound in [0.0, *sorted(set(matrix[:, j]) - {0.0})]:
                            right = rows & (matrix[:, j] > bound)
                            left = rows & ~right
                            a, b = left.sum(), right.sum()
                            if a >= setting.min_leaf and b >= setting.min_leaf and a and b:
                                gain = round(a * b / (a + b) * (r[left].mean() - r[right].mean()) ** 2, 10)
                                if gain > best[0]:
                                    best = (gain, (left, right))
                if best[1] is None:
                    step[rows, k] = leaf(rows)
                else:
                    for side in best[1]:
                        grow(side, depth + 1)

            grow(np.ones(n, bool), 0)
        margins = margins + setting.learning_rate * step
    return margins


@pytest.mark.parametrize("setting", [Setting(4, 2, 0.3), Setting(25, 1, 0.2, 10), Setting(3, 4, 0.5, 5)])
def test_trees_equal_brute_force(sample, setting):
    rows, matrix, labels = sample
    model = fit_boosted(rows, 3, setting, slots=3)
    expected = brute(matrix, labels, 3, setting)
    ids = [np.flatnonzero(r) for r in matrix]
    import pyarrow as pa

    batch = boosting._Rows(pa.array(ids, pa.list_(pa.int64())), pa.array([r[i] for r, i in zip(matrix, ids)], pa.list_(pa.float64())))
    margins = batch.add(np.tile(np.array(model.start), (150, 1)), model.rounds, model.rate, weights=True)
    assert np.allclose(margins, expected)
    got = {r["i"]: r["class"] for r in predict_boosted(rows, model).collect()}
    assert [got[i] for i in range(150)] == expected.argmax(axis=1).tolist()


def test_margins_that_were_stored_change_nothing(sample, monkeypatch):
    rows, _, _ = sample
    whole = fit_boosted(rows, 3, Setting(7, 2), slots=2)
    monkeypatch.setattr(boosting, "STORED_ROUNDS", 2)
    pieces = fit_boosted(rows, 3, Setting(7, 2), slots=5)
    assert [[t.term for t in r] for r in whole.rounds] == [[t.term for t in r] for r in pieces.rounds]
    assert np.allclose([t.value for r in whole.rounds for t in r], [t.value for r in pieces.rounds for t in r])


def test_save_load_and_subsample(spark, sample, tmp_path):
    rows, _, labels = sample
    model = fit_boosted(rows, 3, Setting(10, 3, 0.3, subsample=0.7, seed=3), slots=2)
    model.save(spark, str(tmp_path / "m"))
    loaded = boosting.Boosted.load(spark, str(tmp_path / "m"))
    assert loaded == model
    guessed = {r["i"]: r["class"] for r in predict_boosted(rows, loaded).collect()}
    assert np.mean([guessed[i] == k for i, k in enumerate(labels)]) > 0.85
    marks = np.arange(20_000, dtype=np.int64) * 7919
    parts = [boosting.sampled(marks, number, Setting(subsample=0.7)) for number in (0, 1)]
    assert all(abs(p.mean() - 0.7) < 0.02 for p in parts) and abs((parts[0] & parts[1]).mean() - 0.49) < 0.02


def test_bins_of_many_and_few_weights(frame):
    rows = [(i, 0, [0, 1], [float(i + 1), float(i % 3 + 1)]) for i in range(200)] + [(200, 0, [], []), (201, 0, [2], [5.0])]
    df = frame(rows, SCHEMA)
    edges = boosting.bin_edges(df)
    ends = {r["term"]: r["edges"] for r in edges.collect()}
    assert ends[1] == [1.0, 2.0] and ends[2] == [] and len(ends[0]) == boosting.BINS - 1
    got = {r["i"]: dict(zip(r["ids"], r["bins"])) for r in boosting.binned(df, edges, ["i"]).collect()}
    assert got[200] == {} and got[201] == {2: 1} and [got[i][1] for i in range(3)] == [1, 2, 3]
    assert got[0][0] == 1 and got[199][0] == boosting.BINS
    counts = np.bincount([got[i][0] for i in range(200)])[1:]
    assert counts.min() > 5 and counts.max() < 20


def test_a_class_or_all_terms_may_be_missing(frame):
    bare = frame([(i, 0, [], []) for i in range(5)], SCHEMA)
    model = fit_boosted(bare, 3, Setting(2, 2), slots=2)
    assert {r["class"] for r in predict_boosted(bare, model).collect()} == {0}


# --- kernel map --------------------------------------------------------------------


@pytest.fixture(scope="module")
def ring(spark):
    """A disc inside a ring."""
    rnd = np.random.default_rng(1)
    angle, inner = rnd.uniform(0, 2 * math.pi, 400), np.arange(400) % 2 == 0
    radius = np.where(inner, rnd.uniform(0, 1, 400), rnd.uniform(2, 3, 400))
    matrix = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)
    return sparse(spark.createDataFrame, matrix, inner.astype(int)).cache(), matrix


def accuracy(frame):
    frame = frame.cache()
    model = LinearSVC(maxIter=100, regParam=0.001).fit(frame)
    return model.transform(frame).filter("prediction = label").count() / frame.count()


def test_kernel_features_separate_a_ring(ring):
    rows, _ = ring
    assert accuracy(with_vectors(rows, 2)) < 0.75
    mapped = kernel.with_kernel_features(rows, kernel.fit_map(rows, 2, landmarks=60))
    assert accuracy(mapped) > 0.98


def test_inner_products_are_the_kernel(spark, ring, tmp_path):
    rows, matrix = ring
    chosen = kernel.fit_map(rows.limit(40), 2, landmarks=100, gamma=0.5)
    chosen.save(spark, str(tmp_path / "k"))
    chosen = kernel.KernelMap.load(spark, str(tmp_path / "k"))
    own = {r["i"]: np.array(r["f"]) for r in kernel.with_kernel_features(rows.limit(40), chosen).select("i", vector_to_array("features").alias("f")).collect()}
    for i in list(own)[:10]:
        for j in own:
            assert own[i] @ own[j] == pytest.approx(math.exp(-0.5 * ((matrix[i] - matrix[j]) ** 2).sum()), abs=1e-6)


def test_kernel_edges(frame, ring):
    rows, matrix = ring
    assert kernel.scale_gamma(rows, 2) == pytest.approx(1 / (2 * matrix.var()))
    odd = frame([(0, 0, [], []), (1, 1, [], []), (2, 0, [7], [1.0]), (3, 1, [7], [1.0])], SCHEMA)
    chosen = kernel.fit_map(odd, 9, gamma=1.0)
    assert len(chosen.ids) == 2  # equal rows are one landmark
    found = {r["i"]: r["f"] for r in kernel.with_kernel_features(odd, chosen).select("i", vector_to_array("features").alias("f")).collect()}
    assert found[0] == found[1] and found[2] == found[3]
    assert kernel.with_kernel_features(odd.filter("false"), chosen).collect() == []


def test_blocks_and_slots_change_nothing(sample, monkeypatch):
    rows, _, _ = sample
    whole = fit_boosted(rows, 3, Setting(3, 2, 0.5, 5), slots=1)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 16)
    monkeypatch.setattr(boosting, "HELD_ENTRIES", 40)
    pieces = fit_boosted(rows, 3, Setting(3, 2, 0.5, 5), slots=5)
    assert [[(t.term, t.bin) for t in r] for r in whole.rounds] == [[(t.term, t.bin) for t in r] for r in pieces.rounds]
    assert np.allclose([t.value for r in whole.rounds for t in r], [t.value for r in pieces.rounds for t in r])


def test_slot_keys_fall_into_different_partitions(spark):
    keys = spark.createDataFrame([(k,) for k in boosting._slot_keys(spark, 7)], "slot bigint").repartition(7, "slot")
    assert keys.selectExpr("spark_partition_id() p").distinct().count() == 7


def test_rounds_are_not_jobs_of_their_own(spark, sample):
    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"boosting-{rounds}", "")
        fit_boosted(sample[0], 3, Setting(rounds, 2))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosting-{rounds}"))

    few = jobs(2)
    assert jobs(20) <= few + 3
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

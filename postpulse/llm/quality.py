"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics.  The classes are
Gaussians whose covariances are shrunk towards the pooled covariance and a
multiple of the identity.  Their Cholesky factors are kept in the model; a score
is the difference of the two log densities (Mahalanobis distances and log
determinants), turned into a probability by a logistic curve.

The fit reads sums and products of the vectors only, added up per task, over all
labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.tables import column, slices, stored, text_bytes

FEATURES = (
    "words word_length word_spread capitals digits symbols stops marked_ends bars new_words new_pairs most_frequent stutter "
    "lines repeated_lines line_length packed letters lower_starts"
).split()
THRESHOLD = 0.3
# Width of the log-density range that the logistic curve is fitted on, and its bins.
RANGE, BINS = 60.0, 1200

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = rb"#$%&*+/<=>@\^_`{|}~[]"
_STOPS = b".,;:?"
_DIGITS = b"0123456789"
_LETTERS = _CAPITALS + _CAPITALS.lower() + bytes(range(0x80, 0x100))
_MARKED = re.compile(rb"[#$%&*+/<=>@\\^_`{|}~!]+(?=\s|$)")
_LOWER = re.compile(rb"(?:^|[.!?]\s+)[a-z]")
_SENTENCE = re.compile(rb"(?:^|[.!?]\s+)\S")


def _count_of(characters: bytes, text: bytes) -> int:
    """How many bytes of ``text`` are among ``characters``."""
    return len(text) - len(text.translate(None, characters))


def statistics(text: bytes | None) -> np.ndarray:
    """The feature vector of a whole text; a text without words gives a vector of its own."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    size = len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds = Counter(words)
    letters = _count_of(_LETTERS, text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    near = lambda count, of: np.sqrt(count / max(of, 1))
    return np.array(
        [
            np.log(n),
            np.log(lengths.mean()),
            np.log1p(lengths.std()),
            near(_count_of(_CAPITALS, text), letters),
            near(_count_of(_DIGITS, text), size),
            near(_count_of(_SYMBOLS, text), size),
            near(_count_of(_STOPS, text), n),
            near(len(_MARKED.findall(text)), n),
            near(kinds.get(b"|", 0), n),
            np.log(len(kinds)) / np.log(n + 1),
            np.sqrt(len(set(zip(words, words[1:]))) / max(n - 1, 1)),
            near(max(kinds.values()), n),
            near(sum(map(bytes.__eq__, words, words[1:])), n - 1),
            np.log(len(lines)),
            near(len(lines) - len(set(lines)), len(lines)),
            np.log(size / len(lines)),
            np.log(len(zlib.compress(text, 1)) / size),
            near(letters, size),
            near(len(_LOWER.findall(text)), len(_SENTENCE.findall(text))),
        ]
    )


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float64).reshape(batch.num_rows, len(FEATURES))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per label, the count, sum and products of the task's vectors."""
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, d)
        y = batch.column("label").to_numpy()
        for label in (0, 1):
            own = x[y == label]
            sums[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    index = np.arange(sums.shape[1])
    for label in (0, 1):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), label)), pa.array(index), pa.array(sums[label])], names=["label", "at", "value"])


@dataclass(frozen=True)
class Quality:
    """Means, Cholesky factors and half log determinants of both classes, and the logistic curve."""

    means: np.ndarray
    factors: np.ndarray
    half_logs: np.ndarray
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            density.append(-0.5 * (z * z).sum(axis=0) - self.half_logs[k])
        return np.clip(density[1] - density[0], -RANGE, RANGE)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.offset)))


def shrink(own: np.ndarray, pooled: np.ndarray, to_pooled: float, to_identity: float) -> np.ndarray:
    mixed = (1 - to_pooled) * own + to_pooled * pooled
    return (1 - to_identity) * mixed + to_identity * (np.trace(mixed) / len(mixed) + 1e-9) * np.eye(len(mixed))


def logistic(x: np.ndarray, ones: np.ndarray, all_: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset by damped Newton steps on binned counts; the slope stays positive."""
    beta = np.array([0.1, 0.0])
    target = (ones + 1e-3) / (all_ + 2e-3)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (all_ * (target - p)) - 1e-3 * beta
        curve = design.T @ (design * (all_ * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta = beta + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return float(max(beta[0], 1e-3)), float(beta[1])


def vectors(documents: DataFrame) -> DataFrame:
    """(doc_id, x) of every row, as a stored table: a text is read and measured once for both fit and score."""
    return stored(text_bytes(documents, ("doc_id", "long")).mapInArrow(_vectors, "doc_id long, x array<double>"), "vectors")


def fit(measured: DataFrame, labels: DataFrame, to_pooled: float = 0.1, to_identity: float = 0.01) -> Quality:
    """Fit on every row of ``measured`` (see ``vectors``) that has a label (doc_id, label 0 or 1).

    Only 2 * (1 + d + d * d) sums and a histogram reach the driver.  Repeated
    equal labels count once, contradicting ones both; other labels and null ids
    are ignored.  Without both classes the score is the share of label 1 (0.5
    without any label).
    """
    d = len(FEATURES)
    known = labels.select(column(labels, "doc_id", "long"), column(labels, "label", "int")).filter("label in (0, 1) and doc_id is not null").distinct()
    known = known.select(F.col("doc_id").alias("of"), "label")
    training = stored(measured.join(known, F.expr("doc_id = of")).select("x", "label"), "training")
    sums = training.mapInArrow(_moments, "label long, at long, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).toPandas()
    table = np.zeros((2, 1 + d + d * d))
    if len(sums):
        table[sums["label"], sums["at"]] = sums["value"]
    n = table[:, 0]
    if not n.all():
        share = n[1] / n.sum() if n.sum() else 0.5
        offset = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Quality(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0, offset)
    means = table[:, 1 : d + 1] / n[:, None]
    own = table[:, d + 1 :].reshape(2, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    # features differ in scale, so shrinkage works on standardised covariances
    pooled = np.tensordot(n / n.sum(), own, axes=1)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    unit = scale[:, None] * scale[None, :]
    covariances = [shrink(own[k] / unit, pooled / unit, to_pooled, to_identity) * unit for k in (0, 1)]
    factors = np.stack([np.linalg.cholesky(c) for c in covariances])
    half_logs = np.array([np.log(np.diag(f)).sum() for f in factors])
    model = Quality(means, factors, half_logs, 1.0, 0.0)

    def bins(batches):
        for batch in batches:
            diff = model.difference(batch.column("x").flatten().to_numpy().reshape(-1, d))
            at = np.minimum(((diff + RANGE) * BINS / (2 * RANGE)).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], names=["at", "label"])

    counts = training.mapInArrow(bins, "at long, label int").groupBy("at").agg(F.count("*").alias("all"), F.sum("label").alias("ones")).toPandas()
    middle = (counts["at"].to_numpy() + 0.5) * 2 * RANGE / BINS - RANGE
    slope, offset = logistic(middle, counts["ones"].to_numpy(float), counts["all"].to_numpy(float))
    return Quality(means, factors, half_logs, slope, offset)


def score(measured: DataFrame, model: Quality) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``measured``; null and empty texts have a zero vector."""

    def run(batches):
        for batch in batches:
            value = model.score(batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return measured.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(documents: DataFrame, model: Quality) -> DataFrame:
    """The rows of ``documents`` with a score of at least ``THRESHOLD``, all columns unchanged."""

    def run(batches):
        for batch in slices(batches):
            texts = [t and t.encode() for t in batch.column("text").to_pylist()]
            x = np.array([statistics(t) for t in texts], np.float64).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return documents.mapInArrow(run, documents.schema)

"""An explicit feature map for the RBF kernel, so that a linear solver learns a kernel machine.

A bounded number of landmark rows is drawn; a row's features are its kernel
values with the landmarks, whitened by the landmarks' own kernel matrix (the
Nystroem approximation).  Their inner products equal the kernel between
landmarks and approximate it elsewhere.  Only the landmarks reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANDMARKS = 256
SMALLEST = 1e-10  # eigenvalues of the landmark kernel below this share of the largest are dropped


@dataclass
class KernelMap:
    """Landmarks as sparse rows, ``exp(-gamma * distance^2)``, and the whitening matrix."""

    ids: list[np.ndarray]
    weights: list[np.ndarray]
    gamma: float

    def __post_init__(self):
        owners = np.repeat(np.arange(len(self.ids)), [len(i) for i in self.ids])
        flat = np.concatenate(self.ids) if self.ids else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        # landmark entries by term
        self._term, self._first = np.unique(flat[order], return_index=True)
        self._last = np.r_[self._first[1:], len(flat)]
        self._owner = owners[order]
        self._value = (np.concatenate(self.weights) if self.weights else np.empty(0))[order]
        self._length = np.array([w @ w for w in self.weights])
        values, vectors = np.linalg.eigh(self.kernel(self.ids, self.weights))
        keep = values > SMALLEST * max(values[-1], SMALLEST)
        self.whitening = vectors[:, keep] / np.sqrt(values[keep])

    @property
    def width(self) -> int:
        return self.whitening.shape[1]

    def kernel(self, ids: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """(row, landmark) kernel values."""
        rows, marks = len(ids), len(self.ids)
        owner = np.repeat(np.arange(rows), [len(i) for i in ids])
        flat = np.concatenate(ids) if rows else np.empty(0, np.int64)
        value = np.concatenate(weights) if rows else np.empty(0)
        products = np.zeros(rows * marks)
        if len(self._term) and len(flat):
            where = np.minimum(np.searchsorted(self._term, flat), len(self._term) - 1)
            hit = self._term[where] == flat
            owner, value, where = owner[hit], value[hit], where[hit]
            count = self._last[where] - self._first[where]
            place = np.repeat(self._first[where] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            cell = np.repeat(owner, count) * marks + self._owner[place]
            products = np.bincount(cell, np.repeat(value, count) * self._value[place], minlength=rows * marks)
        own = np.array([w @ w for w in weights])
        apart = own[:, None] + self._length[None, :] - 2 * products.reshape(rows, marks)
        return np.exp(-self.gamma * np.maximum(apart, 0.0))

    def features(self, ids: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        return self.kernel(ids, weights) @ self.whitening

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, list(map(int, ids)), list(map(float, w)), self.gamma) for i, (ids, w) in enumerate(zip(self.ids, self.weights))]
        frame = spark.createDataFrame(rows, "place int, ids array<bigint>, weights array<double>, gamma double")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/landmarks")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KernelMap:
        rows = spark.read.parquet(f"{path}/landmarks").orderBy("place").collect()
        return cls([np.array(r["ids"], np.int64) for r in rows], [np.array(r["weights"], float) for r in rows], rows[0]["gamma"])


def scale_gamma(rows: DataFrame, size: int) -> float:
    """1 / (features * variance of all cells, zeros included); 1 when they do not vary."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    squares = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w)
    n, total, squares = rows.agg(F.count("*"), F.sum(total), F.sum(squares)).first()
    cells = n * size
    variance = squares / cells - (total / cells) ** 2 if cells else 0.0
    return 1.0 / (size * variance) if variance > 0 else 1.0


def fit_map(rows: DataFrame, size: int, landmarks: int = LANDMARKS, gamma: float | None = None, seed: int = 0) -> KernelMap:
    """Landmarks drawn from the distinct rows of ``rows(ids, weights)`` by the order of their hash."""
    placed = rows.select("ids", "weights", F.xxhash64(F.lit(seed), "ids", "weights").alias("_h"))
    # hashes first: only the landmarks' own rows are shuffled
    lowest = placed.select("_h").distinct().orderBy("_h").limit(landmarks)
    drawn = placed.join(F.broadcast(lowest), "_h", "left_semi").dropDuplicates(["_h"]).orderBy("_h").collect()
    gamma = scale_gamma(rows, size) if gamma is None else gamma
    return KernelMap([np.array(r["ids"], np.int64) for r in drawn], [np.array(r["weights"], float) for r in drawn], gamma)


def _mapped(kernel_map):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [x.values.to_numpy() for x in part.column("ids")]
                weights = [x.values.to_numpy() for x in part.column("weights")]
                found = pa.array(list(kernel_map.value.features(ids, weights)), pa.list_(pa.float64()))
                names = [n for n in part.schema.names if n not in ("ids", "weights")]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], found], names=[*names, "mapped"])

    return run


def with_kernel_features(rows: DataFrame, kernel_map: KernelMap, column: str = "features") -> DataFrame:
    """``ids, weights`` replaced by the dense vector ``column``."""
    kept = [c for c in rows.columns if c not in ("ids", "weights")]
    kinds = "".join(f"`{c}` {dict(rows.dtypes)[c]}, " for c in kept)
    shared = rows.sparkSession.sparkContext.broadcast(kernel_map)
    mapped = rows.select(*kept, "ids", "weights").mapInArrow(_mapped(shared), f"{kinds}mapped array<double>")
    return mapped.select(*kept, array_to_vector("mapped").alias(column))

"""Vectors as short codes: one codebook entry per part, found with slice masks.

A vector is cut into consecutive parts, and each part is replaced by the number
of its nearest codebook entry.  Method of the search: for every dimension the
entries are sorted by coordinate, and place i of that order carries the bit mask
of the i entries before it.  The entries whose coordinate lies in [x - r, x + r]
are then the XOR of two such prefix masks, and ANDing these over all dimensions
leaves the entries inside a box around the point.  An entry within distance r
lies in the box; so once a candidate is within r, the nearest entry is among the
candidates.  Points without one double their radius.  The result is exact, ties
go to the lower entry.

Components are integers, so sums do not depend on their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.tables import column, slices, stored

PARTS = 4
ENTRIES = 256  # two hex digits
ROUNDS = 4
SCALE = 1024
# Components beyond this saturate, so squared distances and their sums stay in 64 bits.
LARGEST = 1 << 25
# Points whose nearest entries are found in full to choose the first radius of a slice.
PROBES = 16


@dataclass
class Masks:
    """The entries of one part with their prefix masks."""

    entries: np.ndarray
    every: np.ndarray
    values: list[np.ndarray]
    prefixes: list[np.ndarray]

    @classmethod
    def of(cls, entries: np.ndarray) -> Masks:
        count, width = entries.shape
        words = -(-count // 64)
        values, prefixes = [], []

        def running(order: np.ndarray) -> np.ndarray:
            bits = np.zeros((count + 1, words), np.uint64)
            bits[np.arange(1, count + 1), order // 64] = np.uint64(1) << (order % 64).astype(np.uint64)
            return np.bitwise_or.accumulate(bits, axis=0)

        for j in range(width):
            order = np.argsort(entries[:, j], kind="stable")
            values.append(entries[order, j])
            prefixes.append(running(order))
        return cls(entries, running(np.arange(count))[-1], values, prefixes)

    def candidates(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Per point the mask of the entries that differ by ``radius`` at most in every dimension."""
        found = np.tile(self.every, (len(points), 1))
        for j, (values, prefix) in enumerate(zip(self.values, self.prefixes, strict=True)):
            low = np.searchsorted(values, points[:, j] - radius, "left")
            high = np.searchsorted(values, points[:, j] + radius, "right")
            found &= prefix[high] ^ prefix[low]
        return found

    def first_radius(self, points: np.ndarray) -> int:
        some = points[:: max(1, len(points) // PROBES)][:PROBES]
        least = ((some[:, None, :] - self.entries[None, :, :]) ** 2).sum(axis=2).min(axis=1)
        return int(np.sqrt(np.median(least))) + 1

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per point."""
        best = np.zeros(len(points), np.int64)
        least = np.zeros(len(points), np.int64)
        if not len(points):
            return best, least
        left = np.arange(len(points))
        radius = np.full(len(points), self.first_radius(points), np.int64)
        while len(left):
            masks = self.candidates(points[left], radius[left])
            member = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, : len(self.entries)]
            at, entry = np.nonzero(member)
            done = np.zeros(len(left), bool)
            if len(at):
                away = ((points[left[at]] - self.entries[entry]) ** 2).sum(axis=1)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                nearest = np.minimum.reduceat(away, first)
                # candidates come in entry order, so the first equal one is the lowest
                hits = np.flatnonzero(away == np.repeat(nearest, np.diff(np.r_[first, len(at)])))
                owners, where = np.unique(at[hits], return_index=True)
                good = nearest <= radius[left[owners]] ** 2
                rows = left[owners[good]]
                best[rows], least[rows] = entry[hits[where]][good], nearest[good]
                done[owners[good]] = True
            left = left[~done]
            radius[left] *= 2
        return best, least


@dataclass
class Codebooks:
    """Per part an array (entries, width); ``cuts`` are the part borders in the vector."""

    parts: list[np.ndarray]
    cuts: list[int]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimal text."""
        texts = [",".join(map(str, row.tolist())) for part in self.parts for row in part if len(row)]
        return hashlib.sha256(",".join(texts).encode()).hexdigest()

    def split(self, column_: pa.Array) -> list[np.ndarray]:
        flat = column_.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column_), self.cuts[-1])
        return [flat[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", carry: tuple[str, ...] = ("label",)) -> DataFrame:
    """``vec_id, carry, point``: whole components; vectors that are null or hold null or non-finite ones go."""
    wide = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bound = float(LARGEST)
    whole = F.transform(wide, lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x * SCALE))).cast("int"))
    kept = embeddings.filter(wide.isNotNull() & finite)
    return kept.select(column(embeddings, "vec_id", "long"), *[embeddings[f"`{c}`"].alias(c) for c in carry], whole.alias("point"))


def first_codebooks(points: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the rows with the smallest ids; at most ``entries`` rows reach the driver."""
    rows = points.orderBy(F.col("vec_id").asc_nulls_last(), "point").select("point").limit(entries).collect()
    width = len(rows[0]["point"]) if rows else 0
    alike = [r["point"] for r in rows if len(r["point"]) == width]
    table = np.array(alike, np.int64).reshape(len(alike), width)
    cuts = [p * width // parts for p in range(parts + 1)]
    return Codebooks([table[:, a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], cuts)


def _sums(books: Codebooks):
    """Per task and used entry: the sum of its parts, and behind it how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [Masks.of(p) for p in books.parts]
        sums = [np.zeros_like(p) for p in books.parts]
        counts = [np.zeros(len(p), np.int64) for p in books.parts]
        for batch in slices(batches):
            for number, block in enumerate(books.split(batch.column("point"))):
                entry, _ = masks[number].nearest(block)
                np.add.at(sums[number], entry, block)
                counts[number] += np.bincount(entry, minlength=len(counts[number]))
        for number, count in enumerate(counts):
            used = np.flatnonzero(count)
            if len(used):
                part = pa.array(np.full(len(used), number), pa.int32())
                total = pa.array(list(np.c_[sums[number][used], count[used]]), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part, pa.array(used.astype(np.int32)), total], names=["part", "entry", "total"])

    return run


def _moved(points: DataFrame, books: Codebooks) -> Codebooks:
    """Every used entry replaced by the floor of its parts' mean; the result has the codebooks' size."""
    sums = points.select("point").mapInArrow(_sums(books), "part int, entry int, total array<long>")
    spread = sums.select("part", "entry", F.posexplode("total").alias("position", "x"))
    totals = spread.groupBy("part", "entry", "position").agg(F.sum("x").alias("x")).toArrow().to_pydict()
    parts, counts = [p.copy() for p in books.parts], {}
    for part, entry, position, x in zip(*totals.values(), strict=True):
        if position == parts[part].shape[1]:
            counts[part, entry] = x
    for part, entry, position, x in zip(*totals.values(), strict=True):
        if position < parts[part].shape[1]:
            parts[part][entry, position] = x // counts[part, entry]
    return Codebooks(parts, books.cuts)


def _codes(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [Masks.of(p) for p in books.parts]
        for batch in slices(batches):
            found = [m.nearest(b) for m, b in zip(masks, books.split(batch.column("point")), strict=True)]
            table = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            errors = np.sum([away for _, away in found], axis=0)
            codes = pa.array([row.tobytes().hex() for row in table], pa.string())
            carried = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "point"]
            names = [name for name in batch.schema.names if name != "point"]
            yield pa.RecordBatch.from_arrays([*carried, codes, pa.array(errors, pa.int64())], names=[*names, "code", "error"])

    return run


def compress(embeddings: DataFrame, vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(``vec_id, label, code, error``, the final codebooks).

    Codebooks start with the vectors of the 256 smallest ids (equal ids by
    components, null ids last) and are moved ``rounds`` times.  With fewer vectors
    there are fewer entries; without any the result is empty.  Vectors that are
    null or hold null or non-finite components are left out, and so are vectors
    of another length than the first one.  A length that 4 does not divide gives
    parts of nearly equal length.  Components beyond +-32768 saturate.  Repeated
    rows stay repeated, rows without id or label are coded like others, further
    columns are ignored.
    """
    points = integer_vectors(embeddings, vector, (label,)).withColumnRenamed(label, "label")
    points = stored(points, "points")
    books = first_codebooks(points)
    points = points.filter(F.size("point") == books.cuts[-1])
    kind = dict(points.dtypes)["label"]
    if not len(books.parts[0]):
        return points.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    for _ in range(rounds):
        books = _moved(points, books)
    return points.mapInArrow(_codes(books), f"vec_id long, label {kind}, code string, error long"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Add ``label_error``: the error summed over equal labels, nulls together.

    Sums are combined before their shuffle; adaptive execution broadcasts them
    back by measured size, and else splits the rows of a hot label.
    """
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(totals, F.expr("label <=> of")).drop("of")

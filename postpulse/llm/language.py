"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (1 to 3 characters of lower
case words, word ends included) in rank order.  A document's profile is compared
with each language's by the out-of-place distance: the sum of the differences in
rank, with the profile's length for an n-gram that the language lacks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.tables import column, slices

UNKNOWN = "und"
# n-grams of a language profile and of a document profile.
LANGUAGE_RANKS, DOCUMENT_RANKS = 400, 300
# Characters counted together; bounds a task's memory.
PIECE_CHARS = 4_000_000
_EDGE, _BITS = 1, 21
_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x10000)]))
    found = _letters[0][np.minimum(codes, 0xFFFF)]
    for code in np.unique(codes[codes > 0xFFFF]):
        found[codes == code] = unicodedata.category(chr(int(code))).startswith("L")
    return found


def grams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text: characters of 21 bits, word edges as character 1."""
    if not text:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one edge after every word
    first = int(np.argmax(letter))
    keep[max(first - 1, 0)] |= letter.any()  # and one before the first
    codes = np.where(letter, codes, _EDGE)[keep].astype(np.uint64)
    shift = np.uint64(_BITS)
    pairs = (codes[:-1] << shift) | codes[1:]
    triples = (pairs[:-1] << shift) | codes[2:]
    return np.concatenate([codes[codes != _EDGE], pairs, triples[codes[1:-1] != _EDGE]])


def ranked(codes: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:ranks]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts per language and task."""
    held: dict[str, list[np.ndarray]] = {}
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    size = 0

    def fold():
        for lang, parts in held.items():
            codes, counts = np.unique(np.concatenate(parts), return_counts=True)
            if lang in sums:
                both = np.concatenate([sums[lang][0], codes])
                codes, where = np.unique(both, return_inverse=True)
                counts = np.bincount(where, np.concatenate([sums[lang][1], counts])).astype(np.int64)
            sums[lang] = codes, counts
        held.clear()

    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = grams(text)
            held.setdefault(lang, []).append(found)
            size += len(found)
            if size >= PIECE_CHARS:
                fold()
                size = 0
    fold()
    for lang, (codes, counts) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def _leaders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one partition's n-grams, those that can be among a language's most frequent."""
    best = None
    for frame in frames:
        best = frame if best is None else pd.concat([best, frame])
        best = best.sort_values(["n", "gram"], ascending=[False, True]).groupby("lang").head(LANGUAGE_RANKS)
    if best is not None:
        yield best


@dataclass(frozen=True)
class Profiles:
    """Language names and, for each, its n-grams sorted by code with their ranks."""

    names: list[str]
    codes: list[np.ndarray]
    ranks: list[np.ndarray]

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language of a text and one minus its share of the largest possible distance."""
        found = grams(text)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(*np.unique(found, return_counts=True), DOCUMENT_RANKS)
        place = np.arange(len(own))
        distances = []
        for codes, ranks in zip(self.codes, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            apart = np.where(codes[at] == own, np.abs(ranks[at] - place), LANGUAGE_RANKS)
            distances.append(int(apart.sum()))
        best = int(np.argmin(distances))
        return self.names[best], 1 - distances[best] / (LANGUAGE_RANKS * len(own))


def learn(documents: DataFrame) -> Profiles:
    """Profiles from all rows of ``documents`` (text, lang) that have both.

    The driver receives ``LANGUAGE_RANKS`` n-grams per language.  Texts are
    counted whole; repeated rows count repeatedly.
    """
    rows = documents.select(column(documents, "lang", "string"), column(documents, "text", "string")).filter("lang is not null and text is not null")
    counted = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    leaders = counted.mapInPandas(_leaders, "lang string, gram long, n long")
    top = leaders.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "gram"))), 1, LANGUAGE_RANKS).alias("top"))
    names, codes, ranks = [], [], []
    for row in sorted(top.select("lang", "top.gram").collect()):
        own = np.array(row["gram"], np.int64).view(np.uint64)
        order = np.argsort(own)
        names.append(row["lang"])
        codes.append(own[order])
        ranks.append(order)
    return Profiles(names, codes, ranks)


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``und`` and 0 for null texts and texts without letters.

    Ties go to the first language by name.  Without any profile all is ``und``.
    """

    def run(batches):
        for batch in slices(batches):
            found = [profiles.nearest(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = documents.select(column(documents, "doc_id", "long"), column(documents, "text", "string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")

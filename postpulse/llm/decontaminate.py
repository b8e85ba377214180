"""Finding benchmark passages in documents with spaced seeds.

A mask selects some of the token positions of a window and ignores the others,
so two windows that differ only in ignored positions have the same hash.  The
hashes of all benchmark windows under a few fixed masks are looked up for every
document window; each hit fixes an alignment, along which the longest
well-matching stretch around the hit is verified token by token.

Benchmark items are taken in blocks of bounded size.  A block is sent to all
tasks, and every document is read once per block; documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.tables import column, slices, text_bytes
from postpulse.llm.words import BASE, Words, mixed, rolling

# Characters of the benchmark that are sent to every task at once.
BLOCK_CHARS = 16_000_000
_FILTER_BITS = 22
_TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class Seeds:
    """``masks`` of equal span; a verified stretch has ``least_words`` tokens (or the whole item) and this identity."""

    masks: tuple[str, ...] = ("11101001011", "11011000111", "10110110011", "11010110101")
    least_words: int = 13
    identity: float = 0.8

    @property
    def span(self) -> int:
        return len(self.masks[0])


def tokens(text: bytes | str | None) -> list[bytes]:
    """Runs of letters, digits and underscores, in lower case."""
    if not text:
        return []
    text = text.decode() if isinstance(text, bytes) else text
    return " ".join(_TOKEN.findall(text.lower())).encode().split()


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the selected positions of the window at every position."""
    size = len(hashes) - len(mask) + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    result = np.zeros(size, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            result = result * np.uint64(BASE) + hashes[i : i + size]
    return mixed(result)


class Index:
    """Seeds of a block of benchmark items, in the form that tasks look up."""

    def __init__(self, items: list[tuple[object, bytes | None]], seeds: Seeds):
        self.seeds = seeds
        lists = [tokens(text) for _, text in items]
        self.names = [name for name, _ in items]
        flat = Words.from_lists(lists)
        self.flat, self.starts = flat.hashes, flat.starts
        owner = np.repeat(np.arange(len(items)), flat.counts)
        self.tables: list[tuple[int | str, np.ndarray, np.ndarray, np.ndarray]] = []
        for mask in seeds.masks:
            own = seed_hashes(self.flat, mask)
            whole = np.arange(len(own)) + len(mask) <= flat.starts[1:][owner[: len(own)]]
            self._add(mask, own[whole], np.flatnonzero(whole))
        # items shorter than a mask are looked up as a whole
        for length in sorted({len(x) for x in lists if 0 < len(x) < seeds.span}):
            own = mixed(rolling(self.flat, length))
            at = np.array([flat.starts[i] for i, x in enumerate(lists) if len(x) == length])
            self._add(length, own[at], at)
        self.owner = owner

    def _add(self, kind: int | str, hashes: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        self.tables.append((kind, hashes[order], at[order], np.packbits(bits)))

    def hits(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions: in the documents' tokens and in the benchmark's."""
        for kind, hashes, at, packed in self.tables:
            if not len(hashes):
                continue
            if isinstance(kind, str):
                own = seed_hashes(flat, kind)
            else:
                own = mixed(rolling(flat, kind)) if len(flat) >= kind else np.empty(0, np.uint64)
            bits = np.unpackbits(packed).view(bool)
            maybe = np.flatnonzero(bits[own >> np.uint64(64 - _FILTER_BITS)])
            low = np.searchsorted(hashes, own[maybe])
            count = np.searchsorted(hashes, own[maybe], side="right") - low
            maybe, low, count = maybe[count > 0], low[count > 0], count[count > 0]
            if len(maybe):
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield np.repeat(maybe, count), at[np.repeat(low, count) + step]


def best_stretch(equal: np.ndarray, at: int, identity: float) -> tuple[int, int]:
    """The best-scoring stretch [from, to) around position ``at``.

    A match scores 1 - identity, a mismatch -identity, so the sum is not
    negative exactly for stretches of at least the identity; each side is
    extended to where its own sum is largest.
    """
    gain = np.where(equal, 1 - identity, -identity)
    right = np.cumsum(gain[at:])
    left = np.cumsum(gain[:at][::-1])
    end = at + 1 + int(len(right) - 1 - np.argmax(right[::-1]))
    start = at - (1 + int(len(left) - 1 - np.argmax(left[::-1])) if len(left) and left.max() > 0 else 0)
    return start, end


def overlaps(index: Index, texts: list[bytes | None]) -> list[tuple[int, object, int, int, int, int]]:
    """(text, item, text position, item position, tokens, matching tokens) of all verified overlaps."""
    seeds = index.seeds
    flat = Words.from_lists([tokens(t) for t in texts])
    if not len(flat.hashes):
        return []
    owner = np.repeat(np.arange(len(texts)), flat.counts)
    found = set()
    done: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for ours, theirs in index.hits(flat.hashes):
        for p, q in zip(ours.tolist(), theirs.tolist(), strict=True):
            doc, item = int(owner[p]), int(index.owner[q])
            key = (doc, item, p - q)
            if any(a <= p < b for a, b in done.get(key, ())):
                continue
            low = max(int(flat.starts[doc]) - p, int(index.starts[item]) - q)
            high = min(int(flat.starts[doc + 1]) - p, int(index.starts[item + 1]) - q)
            equal = flat.hashes[p + low : p + high] == index.flat[q + low : q + high]
            start, end = best_stretch(equal, -low, seeds.identity)
            done.setdefault(key, []).append((p + low + start, p + low + end))
            length = int(index.starts[item + 1] - index.starts[item])
            matched = int(equal[start:end].sum())
            if end - start >= min(seeds.least_words, length) and matched >= seeds.identity * (end - start):
                found.add((doc, index.names[item], p + low + start - int(flat.starts[doc]), q + low + start - int(index.starts[item]), end - start, matched))
    return sorted(found, key=lambda f: (f[0], str(f[1]), f[2:]))


def _blocks(benchmark: DataFrame, seeds: Seeds) -> Iterator[Index]:
    """Blocks of about ``BLOCK_CHARS``, drawn by hash; one after the other is on the driver."""
    items = benchmark.select(column(benchmark, "item_id", "string"), F.col("`text`").cast("string").cast("binary").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {k}"))
        rows = own.distinct().orderBy("item_id", "text").toArrow().to_pylist()
        yield Index([(r["item_id"], r["text"]) for r in rows], seeds)


def contaminated(documents: DataFrame, benchmark: DataFrame, seeds: Seeds | None = None) -> DataFrame:
    """(doc_id, item_id, doc_at, item_at, words, matched): verified overlaps, positions in tokens.

    Only documents with an overlap appear.  Null and empty texts, and items
    without tokens, have none.  Items shorter than a mask must occur whole and
    exactly.  Null ids are allowed on both sides; repeated document rows repeat
    their overlaps, repeated items count once.
    """
    seeds = seeds or Seeds()
    spark = documents.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    result = None
    for index in _blocks(benchmark, seeds):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in slices(batches):
                rows = overlaps(shared.value, batch.column("text").to_pylist())
                ids = batch.column("doc_id").to_pylist()
                columns = list(zip(*[(ids[r[0]], *r[1:]) for r in rows], strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "doc_at", "item_at", "words", "matched"])

        own = text_bytes(documents, ("doc_id", "long")).mapInArrow(run, "doc_id long, item_id string, doc_at long, item_at long, words long, matched long")
        result = own if result is None else result.union(own)
    return result.withColumn("item_id", F.col("item_id").cast(kind))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, seeds: Seeds | None = None) -> DataFrame:
    """The rows of ``documents`` without an overlap, all columns unchanged."""
    seeds = seeds or Seeds()
    for index in _blocks(benchmark, seeds):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in slices(batches):
                bad = {r[0] for r in overlaps(shared.value, batch.column("text").to_pylist())}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents

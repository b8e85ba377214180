"""Alignment of two tokenizers' tokens, scored with inverted bitmaps of id pairs.

The byte offsets at which tokens of both sides end cut a text into groups; every
A token of a group is linked with every B token of it.  How often a pair of ids
is linked in the corpus is counted with an inverted index: documents are numbered
inside blocks, and each block holds, per pair, a compressed bitmap of the
documents that link it (a sorted list of 16-bit numbers, or bits where these are
shorter) and multiplicity planes: plane k is the bitmap of the documents whose
number of links less one has bit k.  Blocks share no document, so ORing a pair's
bitmaps over the blocks is putting them side by side, and its document count is
the sum of their bit counts.  The counts then return to the postings, which hand
each document its links' scores.

A block is closed before 2^16 documents or after :data:`BLOCK_LINKS` links, so its
rows and the arrays of the last step are bounded.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.tables import slices, stored, text_bytes

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_DOCS = 1 << 16
# Distinct (pair, document) entries after which a block is closed.
BLOCK_LINKS = 1 << 20
# Text bytes and documents handled at once (a longer text is alone).
BATCH_BYTES, BATCH_DOCS = 1 << 19, 1 << 12
# Segments remembered in one Python task before the memory is cleared.
REMEMBERED = 1 << 19
# Links of one group beyond this are counted per distinct id, not one by one.
GROUP_LINKS = 1 << 16
BLANK = "\u2581"
# A text behind a blank is cut before each blank or line feed that follows a letter, digit or ASCII mark.
SEGMENT = re.compile(r"[ \n]+[^ \n]*(?:(?<![\w!-~])[ \n]+[^ \n]*)*")
BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")
# Fixed value: the published word rule of byte-level vocabularies.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level spelling: printable Latin-1 stands for itself, the rest is shifted to 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers with the bytes of every id, made inside a task from the files' content.

    B joins no characters over the border of a segment: it has no piece that goes
    on after a blank or holds a line feed (which is checked).  So a segment's
    pieces do not depend on its text and are remembered.  Other texts are encoded
    as a whole.  A is read into the faster of two libraries, whose merges go by id
    (checked too); it is used for texts of Latin letters, where word borders do
    not depend on a library's Unicode version.
    """

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        alphabet = byte_level_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            # specials are never produced and keep their own spelling
            self.a_bytes[number] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(number) for number in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.fast = self._fast(json.loads(a))
        self.prefix = self.b.piece_to_id(BLANK)
        self.by_segment = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        self.stride = max(len(self.a_bytes), len(self.b_bytes))
        self.spelled = [f"{i}{end}" for end in ",|;" for i in range(self.stride)]
        self.segments: dict[str, int] = {}
        self.known: list[list[int]] = []

    def _fast(self, a: dict) -> tiktoken.Encoding | None:
        """The same vocabulary for the faster library, if it merges in the order of ids and splits by the published rule."""
        model, before = a["model"], a["pre_tokenizer"] or {}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        published = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if a["normalizer"] or not published or merged != sorted(merged):
            return None
        special = {t["id"] for t in a["added_tokens"]}
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in special}
        return tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def learn(self, segments: list[str]) -> None:
        # B puts a blank before its text: it is the segment's own, or a token to drop
        found = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        start = len(self.known)
        self.segments.update(zip(segments, range(start, start + len(segments)), strict=True))
        self.known.extend([y if s[0] == " " else y[y[:1] == [self.prefix] :] for s, y in zip(segments, found, strict=True)])

    def whole(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides by the plain calls."""
        return self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)

    def spells(self, ids: tuple[list[int], list[int]], text: str) -> bool:
        wanted = (" " + text).encode()
        return all(b"".join(map(table.__getitem__, side)) == wanted for side, table in zip(ids, (self.a_bytes, self.b_bytes), strict=True))

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]] | None]:
        """Per text the ids of both sides; None where they do not spell a blank and the text."""
        if len(self.segments) > REMEMBERED:
            self.segments, self.known = {}, []
        cut = [SEGMENT.findall(" " + t) if t and self.by_segment and BLANK not in t else [] for t in texts]
        unknown = list(dict.fromkeys(s for c in cut for s in c if s not in self.segments))
        if unknown:
            self.learn(unknown)
        known, place = self.known, self.segments.__getitem__
        result = []
        for text, segments in zip(texts, cut, strict=True):
            ids = None
            if text and segments and self.fast and not BEYOND_LATIN.search(text):
                pieces = list(chain.from_iterable([known[n] for n in map(place, segments)]))
                # byte-level tokens spell any text
                if b"".join(map(self.b_bytes.__getitem__, pieces)) == (" " + text).encode():
                    ids = self.fast.encode_ordinary(" " + text), pieces
            if text and not ids:
                ids = self.whole(text)
                ids = ids if self.spells(ids, text) else None
            result.append(ids)
        return result


@dataclass
class Aligned:
    """Tokens of some documents one after another, with the (ascending) number of their group."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    count_a: np.ndarray
    count_b: np.ndarray
    groups: np.ndarray  # per document

    @classmethod
    def of(cls, documents: list[tuple[list[int], list[int]]], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
        """Every document has tokens, and both sides spell the same bytes: so group ends lie at document ends."""
        count_a, count_b = (np.array([len(d[side]) for d in documents], np.int64) for side in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(d[side] for d in documents), np.int64, n) for side, n in ((0, count_a.sum()), (1, count_b.sum())))
        end_a, end_b = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
        common = end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a
        ends = end_a[common]
        last = np.searchsorted(ends, end_a[np.cumsum(count_a) - 1]) + 1
        return cls(a, b, np.cumsum(common) - common, np.searchsorted(ends, end_b), count_a, count_b, np.diff(np.r_[0, last]))

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        total = int(self.groups.sum())
        return np.bincount(self.group_a, minlength=total), np.bincount(self.group_b, minlength=total)

    def link_counts(self) -> np.ndarray:
        """Links per document."""
        size_a, size_b = self.sizes()
        return np.add.reduceat(size_a * size_b, np.cumsum(self.groups) - self.groups)

    def spellings(self, pair: Pair) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per document."""
        size_a, size_b = self.sizes()
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        mark_a, mark_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        mark_a[end_a - 1], mark_b[end_b - 1] = 1, 2
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + (end_b - size_b)[self.group_a]] = self.a + mark_a * pair.stride
        codes[np.arange(len(self.b)) + end_a[self.group_b]] = self.b + mark_b * pair.stride
        spelled = list(map(pair.spelled.__getitem__, codes.tolist()))
        ends = np.cumsum(self.count_a + self.count_b).tolist()
        return ["".join(spelled[start:end])[:-1] for start, end in zip([0, *ends[:-1]], ends, strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times), sorted and distinct by document and pair (a << 32 | b)."""
        size_a, size_b = self.sizes()
        owner = np.repeat(np.arange(len(self.groups)), self.groups)
        small = size_a * size_b <= GROUP_LINKS
        start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        # every A token of a small group beside each B token of it
        use = small[self.group_a]
        group = self.group_a[use]
        repeats = size_b[group]
        right = np.arange(repeats.sum()) + np.repeat(start_b[group] - (np.cumsum(repeats) - repeats), repeats)
        found = [(np.repeat(owner[group], repeats), np.repeat(self.a[use], repeats) << 32 | self.b[right], np.ones(len(right), np.int64))]
        for g in np.flatnonzero(~small):
            x, times_x = np.unique(self.a[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
            y, times_y = np.unique(self.b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
            found.append((np.full(len(x) * len(y), owner[g]), np.add.outer(x << 32, y).ravel(), np.outer(times_x, times_y).ravel()))
        document, pairs, times = (np.concatenate(c) for c in zip(*found, strict=True))
        # ids have 16 bits or few more: one number sorts faster than two keys
        stride = int(max(self.a.max(), self.b.max())) + 1
        key = (document * stride + (pairs >> 32)) * stride + (pairs & 0xFFFFFFFF)
        order = np.argsort(key)
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        return document[order][first], pairs[order][first], np.add.reduceat(times[order], first)


def pack(places: np.ndarray, size: int) -> bytes:
    """Sorted places as 16-bit numbers, or as bits of a block of ``size`` documents if that is shorter."""
    if 2 * len(places) <= -(-size // 8):
        return b"\0" + places.astype("<u2").tobytes()
    bits = np.zeros(size, bool)
    bits[places] = True
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if packed[:1] == b"\0":
        return np.frombuffer(packed, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little"))


_ROW = pa.schema(
    [
        ("block", pa.int64()),
        ("place", pa.int32()),
        ("doc_id", pa.int64()),
        *[(name, pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")],
        ("groups_sha256", pa.string()),
        ("pair", pa.int64()),
        ("docs", pa.binary()),
        ("planes", pa.list_(pa.binary())),
        ("df", pa.int64()),
    ]
)
_ROW_SQL = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, docs binary, planes array<binary>, df long"


@dataclass
class _Block:
    """Links of the documents of an open block, by (pair, place)."""

    number: int
    size: int = 0
    held: int = 0
    parts: list = field(default_factory=list)

    def add(self, places: np.ndarray, found: Aligned) -> None:
        """Documents with tokens, at their places in the block."""
        document, pairs, times = found.links()
        self.parts.append((pairs, places[document], times))
        self.held += len(pairs)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        pairs, places, times = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(pairs, kind="stable")  # places stay ascending
        pairs, places, more = pairs[order], places[order], times[order] - 1
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        ends = np.r_[first[1:], len(pairs)]
        highest = np.maximum.reduceat(more, first)
        docs, planes = [], []
        for start, end, top in zip(first.tolist(), ends.tolist(), highest.tolist(), strict=True):
            at = places[start:end]
            docs.append(pack(at, self.size))
            planes.append([pack(at[more[start:end] >> k & 1 == 1], self.size) for k in range(top.bit_length())])
        for start in range(0, len(docs), 10_000):
            part = slice(start, start + 10_000)
            rows = len(docs[part])
            empty = [pa.nulls(rows, kind) for kind in _ROW.types[1:8]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, self.number)),
                    *empty,
                    pa.array(pairs[first[part]]),
                    pa.array(docs[part], pa.binary()),
                    pa.array(planes[part], pa.list_(pa.binary())),
                    pa.array((ends - first)[part]),
                ],
                schema=_ROW,
            )


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of about ``BATCH_BYTES`` bytes."""
    ids, texts, held = [], [], 0
    for batch in slices(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(None if text is None else text.decode())
            held += len(text or b"")
            if held >= BATCH_BYTES or len(ids) >= BATCH_DOCS:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _index(files):
    """Rows per document, and per block and pair its bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*files.value)
        block = _Block(TaskContext.get().partitionId() << 32)
        for ids, texts in _by_bytes(batches):
            if block.size + len(ids) > BLOCK_DOCS or block.held >= BLOCK_LINKS:
                yield from block.rows()
                block = _Block(block.number + 1)
            encoded = pair.encode(texts)
            full = [i for i, ids_ in enumerate(encoded) if ids_]
            numbers = np.zeros((4, len(ids)), np.int64)
            digests = [""] * len(ids)
            if full:
                found = Aligned.of([encoded[i] for i in full], pair.a_sizes, pair.b_sizes)
                numbers[:, full] = found.count_a, found.count_b, found.groups, found.link_counts()
                for i, spelled in zip(full, found.spellings(pair), strict=True):
                    digests[i] = hashlib.sha256(spelled.encode()).hexdigest()
                block.add(block.size + np.array(full), found)
            place = pa.array(np.arange(block.size, block.size + len(ids)), pa.int32())
            columns = [pa.array(np.full(len(ids), block.number)), place, pa.array(ids, pa.int64()), *[pa.array(n) for n in numbers], pa.array(digests, pa.string())]
            block.size += len(ids)
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(ids), kind) for kind in _ROW.types[8:]]], schema=_ROW)
        yield from block.rows()

    return run


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with their pair's count, sorted by block: per document the sum over its links."""
    number, best, total = None, None, None

    def result() -> pa.RecordBatch:
        places = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(places), number)), pa.array(places.astype(np.int32)), pa.array(best[places]), pa.array(total[places])],
            names=["in_block", "at", "n_best", "count_sum"],
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "docs", "planes", "df", "is_best")]
        for block, docs, planes, df, is_best in zip(*columns, strict=True):
            if block != number:
                if number is not None:
                    yield result()
                number, best, total = block, np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
            for weight, places in [(1, unpack(docs)), *[(1 << k, unpack(plane)) for k, plane in enumerate(planes)]]:
                total[places] += weight * df
                if is_best:
                    best[places] += weight
    if number is not None:
        yield result()


def align(documents: DataFrame, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``documents``.

    The tokenizer files are read once and sent to the tasks (a few MB, whatever
    the input).  Texts that are null, empty, or not spelled back by both
    tokenizers have zeros and an empty ``groups_sha256``.  Repeated rows are
    documents of their own and count as such.  Null ids stay null, further columns
    are ignored.
    """
    contents = []
    for name in (a_file, b_file):
        with open(os.path.join(folder, name), "rb") as file:
            contents.append(file.read())
    files = documents.sparkSession.sparkContext.broadcast(tuple(contents))
    index = stored(text_bytes(documents, ("doc_id", "long")).mapInArrow(_index(files), _ROW_SQL), "pair-index")
    postings = index.filter("pair is not null").select("block", "pair", "docs", "planes", "df")
    counted = stored(postings.groupBy("pair").agg(F.sum("df").alias("df")), "pair-counts")
    a_id = F.shiftright("pair", 32)
    highest = counted.groupBy(a_id.alias("a")).agg(F.max("df").alias("top"))
    # one row per id of A, which its vocabulary bounds
    judged = counted.join(F.broadcast(highest), a_id == F.col("a")).select("pair", "df", (F.col("df") == F.col("top")).alias("is_best"))
    scored = postings.drop("df").join(judged.hint("merge"), "pair")
    sums = scored.select("block", "docs", "planes", "df", "is_best").repartition("block").sortWithinPartitions("block")
    sums = sums.mapInArrow(_returned, "in_block long, at int, n_best long, count_sum long")
    rows = index.filter("place is not null").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    found = rows.join(sums.hint("merge"), (F.col("block") == F.col("in_block")) & (F.col("place") == F.col("at")), "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )

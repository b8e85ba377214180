"""Removing word passages that an earlier document already has.

Method: relative Lempel-Ziv parsing.  The collection is cut into reference
blocks (scan tasks).  Each block indexes its windows of ``words`` words by
anchors: the k-gram with the smallest hash inside a window, so that equal
windows always have equal anchors.  One shuffle brings the windows of an anchor
from all blocks together, where every window finds the first document and
position that has it.  A document is then factored greedily against the
indexed blocks: a factor is a longest stretch that follows one earlier place
word by word; where the place changes, a new factor begins.  Factors of at least
``words`` words are duplicate spans.  Windows that straddle the boundary of two
factors are looked up as well, so no repeated window is lost between factors.

Windows of one block that repeat an earlier document of the same block are
settled there, and only the first of equal windows leaves the block: a passage
that a third of all documents share sends one row per block and window.

Before that, anchors alone are brought together, and each document learns which
of its anchors another document has too: only windows with such an anchor are
sent.  Windows are compared by 64 bits of their anchor and 64 bits of themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.llm.tables import slices
from postpulse.llm.words import Words, mixed, split

# Words of one reference block that are indexed before its windows are sent on.
BLOCK_WORDS = 1 << 20
# Sorted rows that are settled together.
GROUP_ROWS = 100_000


@dataclass(frozen=True)
class Passages:
    """Windows of ``words`` words; ``anchor`` words are hashed to find one inside each."""

    words: int = 13
    anchor: int = 4


def window_keys(flat: Words, rule: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, anchor hash and window hash of every full window of every document."""
    wide, whole = flat.windows(rule.words)
    if not len(wide):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    least = flat.windows(rule.anchor)[0]
    # smallest k-gram hash over the window, by doubling
    span, done = rule.words - rule.anchor + 1, 1
    while done * 2 <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    least = np.minimum(least[: len(wide)], least[span - done : span - done + len(wide)])
    start = np.flatnonzero(whole)
    return start, least[start], wide[start]


_ROW = "kind int, anchor long, doc_id long, at long, windows array<long>"
_ROWS = pa.schema([("kind", pa.int32()), ("anchor", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("windows", pa.list_(pa.int64()))])
_OPEN, _SETTLED = 0, 1
_FACTOR = ("at", "windows", "source", "source_at")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _runs(*breaks: np.ndarray) -> np.ndarray:
    """Start indexes of the runs in which none of the masks marks a break before an element."""
    first = np.logical_or.reduce(breaks)
    return np.flatnonzero(np.concatenate([[True], first]))


def first_places(anchor, window, doc, at) -> tuple[np.ndarray, np.ndarray]:
    """For rows of any order: the sort order, and per sorted row the index of its window's first place."""
    order = np.lexsort((at, doc, window, anchor))
    a, w = anchor[order], window[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])])
    return order, order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]


def _blocks(rule: Passages):
    """Index reference blocks; send each window's first place, settle the others."""

    def flush(pieces: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        anchor, window, doc, at = (np.concatenate(c) for c in zip(*pieces, strict=True))
        if not len(anchor):
            return
        order, first = first_places(anchor, window, doc, at)
        own, ref = order, first
        again = doc[own] != doc[ref]
        yield from _spans(doc[own[again]], at[own[again]], doc[ref[again]], at[ref[again]], window[own[again]])
        # only first places go on, one row per stretch of windows with one anchor; a later place
        # in the same document holds no news either, as its fate is that of the first
        index = np.sort(own[own == ref])
        yield from _stretches(anchor[index], window[index], doc[index], at[index])
        same = (own != ref) & ~again
        yield from _echoes(anchor[own[same]], window[own[same]], doc[own[same]], at[own[same]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = [], 0
        for batch in slices(batches):
            flat = Words.of(batch.column("text").to_pylist())
            start, anchor, window = window_keys(flat, rule)
            # a document knows all of its anchors that another one has
            sent = np.isin(anchor, batch.column("anchors").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            start, anchor, window = start[sent], anchor[sent], window[sent]
            owner = np.repeat(np.arange(batch.num_rows), flat.counts)[start] if len(start) else start
            doc = batch.column("of").to_numpy(zero_copy_only=False)
            pieces.append((anchor, window, doc[owner], start - flat.starts[owner]))
            held += len(start)
            if held >= BLOCK_WORDS:
                yield from flush(pieces)
                pieces, held = [], 0
        if pieces:
            yield from flush(pieces)

    return run


def _stretches(anchor, window, doc, at) -> Iterator[pa.RecordBatch]:
    if not len(anchor):
        return
    heads = _runs(anchor[1:] != anchor[:-1], doc[1:] != doc[:-1], at[1:] != at[:-1] + 1)
    ends = np.append(heads, len(anchor)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(window.view(np.int64)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(heads), _OPEN, np.int32)), pa.array(anchor[heads].view(np.int64)), pa.array(doc[heads]), pa.array(at[heads]), lists], schema=_ROWS
    )


def _echoes(anchor, window, doc, at) -> Iterator[pa.RecordBatch]:
    """Repeats inside one document; each still asks for an earlier document."""
    order = np.lexsort((at, doc))
    yield from _stretches(anchor[order], window[order], doc[order], at[order])


def checks(window: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """One number per run of windows, by which a text is told from another with the same id."""
    return np.add.reduceat(mixed(window), heads)


def _spans(doc, at, ref_doc, ref_at, window) -> Iterator[pa.RecordBatch]:
    """Settled windows as factors: maximal runs that follow one earlier place."""
    if not len(doc):
        return
    order = np.lexsort((window, at, doc))
    doc, at, ref_doc, ref_at, window = doc[order], at[order], ref_doc[order], ref_at[order], window[order]
    step = at[1:] != at[:-1] + 1
    heads = _runs(step, doc[1:] != doc[:-1], ref_doc[1:] != ref_doc[:-1], ref_at[1:] != ref_at[:-1] + 1)
    ends = np.append(heads[1:], len(doc)) - 1
    # a settled row keeps (windows in the factor, source document, source position, check) as its list
    cells = np.stack([at[ends] - at[heads] + 1, ref_doc[heads], ref_at[heads], checks(window, heads).view(np.int64)], axis=1).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(heads) + 1, dtype=np.int32) * 4), pa.array(cells.ravel()))
    # settled rows only pass through the shuffle, so any even key will do
    key = mixed(ref_doc[heads].astype(np.int64).view(np.uint64) + np.arange(len(heads), dtype=np.uint64)).view(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(heads), _SETTLED, np.int32)), pa.array(key), pa.array(doc[heads]), pa.array(at[heads]), lists], schema=_ROWS
    )


def _anchors(rule: Passages):
    """(anchor, doc_id): the anchors of each document, one row per stretch of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat = Words.of(batch.column("text").to_pylist())
            start, anchor, _ = window_keys(flat, rule)
            if not len(start):
                continue
            owner = np.repeat(np.arange(batch.num_rows), flat.counts)[start]
            heads = _runs(anchor[1:] != anchor[:-1], owner[1:] != owner[:-1])
            doc = batch.column("_id").to_numpy(zero_copy_only=False)[owner[heads]]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[heads].view(np.int64)), pa.array(doc.astype(np.int64))], names=["anchor", "doc_id"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and document those whose anchor several documents have."""
    known, waiting = None, None  # an anchor known to repeat; the last row, if its anchor had one document so far
    for batch in batches:
        anchor, doc = (batch.column(c).to_numpy() for c in ("anchor", "doc_id"))
        if not len(anchor):
            continue
        if waiting is not None:
            anchor, doc = np.r_[waiting[0], anchor], np.r_[waiting[1], doc]
        use = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
        anchor, doc = anchor[use], doc[use]
        heads = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes = np.diff(np.r_[heads, len(anchor)])
        several = np.repeat(sizes > 1, sizes)
        if known is not None:
            several |= anchor == known
        known = anchor[-1] if several[-1] else None
        waiting = None if several[-1] else (anchor[-1], doc[-1])
        yield pa.RecordBatch.from_arrays([pa.array(anchor[several]), pa.array(doc[several])], names=["anchor", "doc_id"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: windows whose first place is in an earlier document, as factors.

    Works through whole anchors in groups of bounded size; an anchor with more
    rows than that is held as its distinct windows only.
    """
    firsts: dict[int, tuple[int, int]] = {}
    current = None
    held: list[pa.RecordBatch] = []
    size = 0

    def arrays(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        if not table.num_rows:
            return (np.empty(0, np.int64),) * 4
        lists = table.column("windows").chunk(0)
        counts = np.diff(lists.offsets.to_numpy())
        window = lists.flatten().to_numpy().view(np.uint64)
        index = np.arange(len(window)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        get = lambda name: np.repeat(table.column(name).to_numpy(), counts)
        return get("anchor"), window, get("doc_id"), get("at") + index

    def work(parts):
        nonlocal current
        anchor, window, doc, at = arrays(parts)
        if not len(anchor):
            return
        order, first = first_places(anchor, window, doc, at)
        ref_doc, ref_at = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
        ref_doc[order], ref_at[order] = doc[first], at[first]
        # the group before may have ended inside this one's first anchor; its rows have smaller documents
        if current is not None and len(firsts):
            for i in np.flatnonzero(anchor == current):
                known = firsts.get(int(window[i]))
                if known is not None:
                    ref_doc[i], ref_at[i] = known
        last = anchor[-1]
        if last != current:
            firsts.clear()
            current = last
        mine = np.flatnonzero(anchor == last)
        for i in mine:
            firsts.setdefault(int(window[i]), (int(ref_doc[i]), int(ref_at[i])))
        later = ref_doc < doc
        yield from _spans(doc[later], at[later], ref_doc[later], ref_at[later], window[later])

    for batch in batches:
        settled = pc.equal(batch.column("kind"), _SETTLED)
        if pc.any(settled).as_py():
            yield batch.filter(settled)
            batch = batch.filter(pc.invert(settled))
        held.append(batch)
        size += batch.num_rows
        if size >= GROUP_ROWS:
            yield from work(held)
            held, size = [], 0
    if held:
        yield from work(held)


def factorise(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Greedy factors of one document from its looked-up stretches of windows.

    ``spans`` are (first window, windows, source document, source position).
    Going left to right, a stretch that continues the place of the factor before
    it extends that factor; any other begins a new one.
    """
    factors: list[list[int]] = []
    for start, count, source, place in sorted(spans):
        last = factors[-1] if factors else None
        if last and start == last[0] + last[1] and (source, place) == (last[2], last[3] + last[1]):
            last[1] += count
        else:
            factors.append([start, count, source, place])
    return [tuple(f) for f in factors]


def covered(factors: list[tuple[int, int, int, int]], words: int) -> list[tuple[int, int]]:
    """Disjoint word ranges [from, to) that the factors' windows cover."""
    ranges: list[list[int]] = []
    for start, count, *_ in sorted(factors):
        end = start + count + words - 1
        if ranges and start <= ranges[-1][1]:
            ranges[-1][1] = max(end, ranges[-1][1])
        else:
            ranges.append([start, end])
    return [tuple(r) for r in ranges]


def duplicate_spans(texts: DataFrame, rule: Passages) -> DataFrame:
    """(doc_id, at, windows, source, source_at, check): stretches of windows that start in an earlier document.

    ``texts`` has ``_id``, ``row`` and ``text`` (bytes).  Rows without id or text
    have no window.  Rows of one id count as one document whose windows never
    make each other duplicates.
    """
    spark = texts.sparkSession
    # a block's windows are about as large as its texts
    parts = max(spark.sparkContext.defaultParallelism, 2 * texts.rdd.getNumPartitions())
    named = texts.select("_id", "text").filter("_id is not null and text is not null")
    met = named.mapInArrow(_anchors(rule), "anchor long, doc_id long").repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id")
    shared = met.mapInArrow(_repeated, "anchor long, doc_id long").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    # the shuffle of the texts is the one that the found spans meet them in
    wanted = texts.join(shared.withColumnRenamed("doc_id", "of").hint("merge"), F.expr("_id <=> of")).select("_id", "row", "text", "of", "anchors")
    sent = wanted.mapInArrow(_blocks(rule), _ROW).repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id", "at")
    cell = lambda i: F.col("windows")[i]
    return sent.mapInArrow(_settle, _ROW).select(
        "doc_id", "at", cell(0).alias("windows"), cell(1).alias("source"), cell(2).alias("source_at"), cell(3).alias("check")
    )


def cut(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the ranges and the white space after each of them."""
    if not ranges:
        return text
    begins = [m.start() for m in _WORD.finditer(text)]
    begins.append(len(text))
    pieces, at = [], 0
    for start, end in ranges:
        pieces.append(text[at : begins[start]])
        at = begins[end]
    pieces.append(text[at:])
    return b"".join(pieces)


def _own(words: list[bytes], found: list[dict], rule: Passages) -> list[tuple[int, int, int, int]]:
    """The spans that are this text's: another text of the same id has other windows."""
    window = window_keys(Words.from_lists([words]), rule)[2]
    inside = [f for f in found if f["at"] + f["windows"] <= len(window)]
    return [
        (f["at"], f["windows"], f["source"], f["source_at"])
        for f in inside
        if checks(window[f["at"] : f["at"] + f["windows"]], np.zeros(1, np.int64)).view(np.int64)[0] == f["check"]
    ]


def _rest(rule: Passages):
    """Words, words removed, what is kept, and the factors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, removed, texts, digests, parsed = [], [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                words = split(text)
                factors = factorise(_own(words, found, rule)) if found else []
                ranges = covered(factors, rule.words)
                kept, at = [], 0
                for start, end in ranges:
                    kept.extend(words[at:start])
                    at = end
                kept.extend(words[at:])
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(None if text is None else cut(text, ranges).decode())
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                parsed.append([dict(zip(_FACTOR, f, strict=True)) for f in factors])
            factor = pa.list_(pa.struct([(n, pa.int64()) for n in _FACTOR]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(texts, pa.string()),
                    pa.array(digests, pa.string()),
                    pa.array(parsed, factor),
                ],
                names=["row", "n_words", "n_removed", "kept", "kept_sha256", "factors"],
            )

    return run


def remove_passages(documents: DataFrame, rule: Passages | None = None, carry: list[Column] | None = None) -> DataFrame:
    """Every row of ``documents`` (doc_id, text) with its repeated passages removed.

    Returns doc_id (or the columns ``carry``), n_words, n_removed, kept (the text
    without the removed words), kept_sha256 (of the kept words joined by one
    blank) and factors (what was removed and where it came from).  A word goes if
    some window that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input.  A null text has no words and stays null.
    Rows without doc_id lose nothing.  Rows of one doc_id are one document, also
    with different texts: they do not make each other's windows duplicates, and
    each loses what an earlier document has of it.  Other columns are ignored.
    """
    rule = rule or Passages()
    doc_id = F.col("`doc_id`").cast("long")
    texts = documents.select(
        doc_id.alias("_id"), F.struct(*(carry or [doc_id.alias("doc_id")])).alias("row"), F.col("`text`").cast("string").cast("binary").alias("text")
    )
    found = F.collect_set(F.struct("at", "windows", "source", "source_at", "check")).alias("found")
    spans = duplicate_spans(texts, rule).groupBy(F.col("doc_id").alias("of")).agg(found)
    joined = texts.join(spans.hint("merge"), F.expr("_id <=> of"), "left").select("row", "text", "found")
    row = joined.schema["row"].dataType.simpleString()
    rest = joined.mapInArrow(
        _rest(rule),
        f"row {row}, n_words long, n_removed long, kept string, kept_sha256 string, factors array<struct<at:long,windows:long,source:long,source_at:long>>",
    )
    return rest.select("row.*", "n_words", "n_removed", "kept", "kept_sha256", "factors")

"""Self-join of documents on the Jaccard similarity of their word n-gram sets.

Method: adaptive multi-match prefixes.  The n-grams of every set are put in one
global order, rare before frequent.  If two sets of sizes n and m overlap in at
least t n-grams, then their prefixes of n - t + l and m - t + l n-grams share at
least l.  Every document chooses its own l: a longer prefix reads more posting
lists but asks for more shared n-grams, and pays where lists are long.  A pair
uses the smaller l of its two documents.

The order is by estimated frequency (n-grams that repeat inside a task, the
``DICTIONARY`` most frequent of them) and then by hash.  Any order gives the same
links; the estimate only decides how long the posting lists are.

Documents with equal sets are one node from the start.  Posting lists are first
linked to one hub each, verified exactly, and merged; then only pairs of nodes
of different components are generated, so a group of thousands of near copies
is not expanded into all its pairs.  Pairs whose parity sketches differ in more
bits than linked sets could are left out; the bound is exact.  Every pair of nodes that could link is
either verified or already connected.  Whole sets are made again only for nodes of pairs that are
left: their texts are told by a bitmap of fixed size and then looked up by id.

N-grams are compared as 64-bit hashes and sets as 128-bit digests of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postpulse.llm.components import components
from postpulse.llm.tables import slices, stored, text_bytes
from postpulse.llm.words import BASE, Words, mixed, rolling, split

# N-grams whose estimated frequency is sent to every task (8 bytes and a count each).
DICTIONARY = 1 << 18
# N-grams gathered in a task before repeated ones are counted.
GATHERED = 1 << 21
# Words of 64 bits in the parity sketch of a set.
SKETCH = 8
# Bits of the bitmap of wanted ids (2 MB in every task); an id whose bit is set is looked up.
SIEVE = 1 << 24
# Assumed posting list length of an n-gram outside the dictionary.
UNLISTED = 1.2
# Prefix extensions that a document chooses from.
EXTENSIONS = (1, 2, 3, 4, 6, 8)


@dataclass(frozen=True)
class Rule:
    """Link when 100 * intersection >= percent * union, over sets of ``words``-grams."""

    words: int = 5
    percent: int = 80

    def least_overlap(self, n: int | np.ndarray):
        """Smallest intersection a set of ``n`` can have with any set it links to."""
        return -(-self.percent * n // 100)


def gram_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes per text; a shorter text is one n-gram, no word none."""
    lists = [split(t, lower=True) for t in texts]
    flat = Words.from_lists(lists)
    grams = mixed(rolling(flat.hashes, words)) if len(flat.hashes) >= words else np.empty(0, np.uint64)
    sets = []
    for i, (start, end) in enumerate(zip(flat.starts[:-1], flat.starts[1:], strict=True)):
        if end - start >= words:
            sets.append(np.unique(grams[start : end - words + 1]))
        elif end > start:
            # another hash function than that of full n-grams: the length is part of the text hashed
            sets.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(lists[i]), seed=1)], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def digest(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


_SUMMARY = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("sketch", pa.list_(pa.int64())), ("gram", pa.int64()), ("times", pa.int64())]
)


def _summaries(words: int):
    """Per document its set's size, digest and sketch; besides, n-grams that repeat inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        seen: set[bytes] = set()
        held = 0

        def repeated():
            grams, times = np.unique(np.concatenate(kept), return_counts=True)
            more = times > 1
            rows = int(more.sum())
            none = pa.nulls(rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.list_(pa.int64())), pa.array(grams[more].view(np.int64)), pa.array(times[more])],
                schema=_SUMMARY,
            )

        for batch in slices(batches):
            sets = gram_sets(batch.column("text").to_pylist(), words)
            nodes = [digest(s) for s in sets]
            for node, grams in zip(nodes, sets, strict=True):
                if node is not None and node not in seen:
                    seen.add(node)
                    kept.append(grams)
                    held += len(grams)
            none = pa.nulls(len(sets), pa.int64())
            sketches = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), sketches, none, none], schema=_SUMMARY
            )
            if held >= GATHERED:
                yield repeated()
                kept, held, seen = [], 0, set()
        if held:
            yield repeated()

    return run


def choose_extension(frequencies: np.ndarray, base: int, n: int) -> int:
    """The l with the lowest estimated cost for one document.

    ``frequencies`` are the estimated posting list lengths in prefix order and
    ``base`` the prefix length for l = 1.  Reading costs the sum of the lists.  A
    document that shares l n-grams lies in l of the lists, so their other entries
    divided by l bound the candidates; it also lies in one list other than the
    l - 1 longest, so these entries bound them too.  Each candidate costs a
    comparison of n n-grams.
    """
    best, cost = 1, math.inf
    for extension in EXTENSIONS:
        length = base + extension - 1
        if length > len(frequencies):
            break
        others = np.sort(frequencies[:length] - 1)
        candidates = min(others.sum() / extension, others[: length - extension + 1].sum())
        now = length + others.sum() + candidates * n
        if now < cost:
            best, cost = extension, now
    return best


_POSTING = pa.schema([("gram", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("at", pa.int32()), ("reach", pa.int32())])


def _postings(rule: Rule, grams: np.ndarray, times: np.ndarray):
    """The prefix n-grams of each distinct set with position and chosen extension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            nodes: list[bytes] = []
            for found in gram_sets(batch.column("text").to_pylist(), rule.words):
                n, node = len(found), digest(found)
                if node is None or node in seen:
                    continue
                seen.add(node)
                frequency = np.full(n, UNLISTED)
                if len(grams):
                    where = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
                    hit = grams[where] == found
                    frequency[hit] = times[where[hit]]
                order = np.lexsort((found, frequency))
                base = n - rule.least_overlap(n) + 1
                extension = choose_extension(frequency[order], base, n)
                length = base + extension - 1
                columns[0].append(found[order[:length]])
                columns[1].append(np.full(length, n, np.int32))
                columns[2].append(np.arange(length, dtype=np.int32))
                columns[3].append(np.full(length, extension, np.int32))
                nodes.extend([node] * length)
            if nodes:
                gram, n, at, reach = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(nodes, pa.binary()), pa.array(n), pa.array(at), pa.array(reach)], schema=_POSTING
                )
            if len(seen) > 1_000_000:
                seen.clear()

    return run


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parity of the set's n-grams per bit; two sketches differ in at most as many bits as their sets in n-grams."""
    bits = np.bincount((grams & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = gram_sets(batch.column("text").to_pylist(), words)
            rows = [(w, s.view(np.int64)) for w, s in zip(batch.column("wanted").to_pylist(), sets, strict=True) if digest(s) == w]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], names=["node", "grams"]
            )

    return run


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SIEVE))


def _sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in the only column of ``wanted``; null is a key like others."""
    bit = wanted.select(_bit(wanted.columns[0]).alias("bit"))
    masks = bit.groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toArrow()
    bitmap = np.zeros(SIEVE // 64, np.int64)
    bitmap[masks.column("at").to_numpy()] = masks.column("mask").to_numpy()

    @F.arrow_udf("boolean")
    def marked(bits: pa.Array) -> pa.Array:
        at = bits.to_numpy()
        return pa.array((bitmap[at >> 6] >> (at & 63)) & 1 == 1)

    return rows.filter(marked(_bit(key)))


def _sets_of(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, grams) for the nodes of ``pairs``."""
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = stored(ends.join(nodes.hint("merge"), "node").select(F.col("node").alias("wanted"), F.col("doc_id").alias("wanted_id")), "wanted")
    some = _sieved(texts, "doc_id", wanted.select("wanted_id"))
    by_id = some.join(wanted.hint("merge"), F.expr("doc_id <=> wanted_id")).select("wanted", "text")
    return stored(by_id.mapInArrow(_sets(words), "node binary, grams array<long>"), "gram-sets")


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = batch.column("grams_u"), batch.column("grams_v")
            keep = []
            for i in range(batch.num_rows):
                a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that link."""
    pairs = stored(pairs, "pairs")
    sets = _sets_of(pairs, nodes, texts, rule.words)
    left = sets.select(F.col("node").alias("u"), F.col("grams").alias("grams_u"))
    right = sets.select(F.col("node").alias("v"), F.col("grams").alias("grams_v"))
    return pairs.join(right.hint("merge"), "v").join(left.hint("merge"), "u").mapInArrow(_links(rule.percent), "u binary, v binary")


def _dictionary(summary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams and their counts; at most ``DICTIONARY`` rows reach the driver."""
    counted = summary.filter("gram is not null").groupBy("gram").agg(F.sum("times").alias("times"))
    top = counted.orderBy(F.desc("times"), "gram").limit(DICTIONARY).toArrow()
    grams = top.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], top.column("times").to_numpy()[order]


def _possible(rule: Rule, n: str, m: str, most: str) -> str:
    """SQL: sets of sizes n and m can link if they share ``most`` n-grams at most."""
    return f"({most}) * {100 + rule.percent} >= {rule.percent} * ({n} + {m})"


def _lists(texts: DataFrame, rule: Rule, grams: np.ndarray, times: np.ndarray) -> DataFrame:
    """(gram, node, n, at, reach, most): postings that can still belong to a link.

    An n-gram of a prefix that no other prefix has is dead.  Before an n-gram that
    two prefixes share, a dead one cannot be in the other set (it would be in its
    prefix), so ``most`` = n minus the dead n-grams before bounds the overlap of
    any pair that meets here.  So is an n-gram that only two prefixes have, of sets
    whose sizes are too far apart to link.  Postings go whose bound is too low for every
    partner in their list, and nodes with fewer postings than any partner asks for.
    """
    postings = texts.select("text").mapInArrow(_postings(rule, grams, times), "gram long, node binary, n int, at int, reach int")
    postings = stored(postings, "postings")
    # a node's key begins with its class of size: sets that link are of the same or neighbouring classes
    width = max(math.log(100 / rule.percent), 1e-3) * (1 + 1e-9)
    key = F.floor(F.log("n") / F.lit(width)) * F.lit(1 << 48) + F.shiftrightunsigned(F.xxhash64("node"), 16)
    ends = postings.groupBy("gram").agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count("*").alias("times"))
    apart = F.expr(f"times = 2 and b div {1 << 48} - a div {1 << 48} > 1")
    shared = ends.filter(F.expr("a <> b") & ~apart).select("gram")
    # copies of a set have equal rows, so the group's only row is any of them
    alive = (
        postings.join(shared.hint("merge"), "gram")
        .groupBy("gram", "node")
        .agg(F.first("n").alias("n"), F.first("at").alias("at"), F.first("reach").alias("reach"))
    )
    place = F.row_number().over(Window.partitionBy("node").orderBy("at")) - 1
    alive = stored(alive.withColumn("most", F.col("n") - F.col("at") + place), "lists")
    least = alive.groupBy("gram").agg(F.min("n").alias("least_n"), F.min("reach").alias("least_reach"))
    alive = alive.join(least.hint("merge"), "gram").filter(_possible(rule, "n", "least_n", "most"))
    own = Window.partitionBy("node")
    alive = alive.withColumn("postings", F.count("*").over(own)).withColumn("asked", F.min("least_reach").over(own))
    return stored(alive.filter("postings >= asked").select("gram", "node", "n", "at", "reach", "most"), "live-lists")


def _pairs(matches: DataFrame) -> DataFrame:
    """Pairs (u, v) that meet in as many lists as the smaller of their extensions asks."""
    counted = matches.groupBy("u", "v").agg(F.count("*").alias("matches"), F.first("asked").alias("asked"))
    return counted.filter("matches >= asked").select("u", "v")


def link(documents: DataFrame, rule: Rule | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents`` (doc_id, text).

    Null or wordless texts have the empty set and link with nothing.  Repeated
    rows stay repeated.  Rows without doc_id take part, but cannot name a
    component; their component_id is null when no linked row has an id.  Equal
    ids with different texts are separate documents that share their id.
    Further columns are ignored.
    """
    rule = rule or Rule()
    texts = text_bytes(documents, ("doc_id", "long"))
    summary = stored(texts.mapInArrow(_summaries(rule.words), "doc_id long, n long, node binary, sketch array<long>, gram long, times long"), "sets")
    rows = summary.filter("gram is null").select("doc_id", "n", "node", "sketch")
    lists = _lists(texts, rule, *_dictionary(summary))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    # one hub per list: the set that could overlap most with others
    hubs = lists.groupBy("gram").agg(F.max(F.struct("most", "node", "n", "reach")).alias("hub"))
    spokes = (
        lists.join(hubs.hint("merge"), "gram")
        .filter("node <> hub.node")
        .filter(_possible(rule, "n", "hub.n", "least(most, hub.most)"))
        .select(F.greatest("node", "hub.node").alias("u"), F.least("node", "hub.node").alias("v"), F.expr("least(reach, hub.reach)").alias("asked"))
    )
    first = stored(_verified(_pairs(spokes), nodes, texts, rule), "links")
    joined = components(first)

    # then pairs of different components
    placed = lists.join(joined.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    level = F.greatest(F.lit(1), F.expr(f"at - (n - cast(ceil(n * {rule.percent} / 100.0) as int)) + 1"))
    placed = stored(placed.withColumn("level", level), "placed")
    open_lists = placed.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("n").alias("least_n")).filter("a <> b")
    placed = placed.join(open_lists.select("gram", "least_n").hint("merge"), "gram").filter(_possible(rule, "n", "least_n", "most"))
    # one row per node for its sketch; copies of a set give equal sketches
    of_node = [F.first(c).alias(c) for c in ("n", "reach", "root")]
    held = placed.groupBy("node").agg(*of_node, F.collect_list(F.struct("gram", "level", "most")).alias("lists"))
    sketches = rows.filter("node is not null").groupBy("node").agg(F.first("sketch").alias("sketch"))
    placed = held.join(sketches.hint("merge"), "node").select("node", "n", "reach", "root", "sketch", F.inline("lists"))
    x, y = (placed.select(*[F.col(c).alias(f"{c}_{s}") for c in ("gram", "node", "n", "reach", "root", "level", "most", "sketch")]) for s in "uv")
    apart = " + ".join(f"bit_count(sketch_u[{i}] ^ sketch_v[{i}])" for i in range(SKETCH))
    matches = x.hint("merge").join(
        y,
        F.expr("gram_u = gram_v and node_u > node_v and root_u <> root_v")
        & F.expr("greatest(level_u, level_v) <= least(reach_u, reach_v)")
        & F.expr(_possible(rule, "n_u", "n_v", "least(most_u, most_v)"))
        # linked sets differ in few n-grams, so their sketches in few bits
        & F.expr(f"({apart}) * {100 + rule.percent} <= {100 - rule.percent} * (n_u + n_v)"),
    )
    matches = matches.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"), F.expr("least(reach_u, reach_v)").alias("asked"))
    second = _verified(_pairs(matches), nodes, texts, rule)
    links = stored(first.union(second), "all-links")

    named = components(links).join(nodes.hint("merge"), "node")
    roots = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    member = named.select("node", "root").join(roots.hint("merge"), "root").select("node", "component_id")
    placed = nodes.join(member.hint("merge"), "node", "left").select(F.col("node").alias("of"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.join(placed.hint("merge"), F.expr("node = of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )

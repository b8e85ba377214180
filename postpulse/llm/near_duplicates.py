"""Groups of near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's set of word shingles gives a signature of ``CHUNKS * WIDTH`` values:
the least hash under one multiplier each, cut to ``BITS`` bits.  Two sets of
Jaccard similarity J differ in each value with probability 1 - J (and a 2^-14
part less), independently, so sets that link stay within ``DISTANCE`` differing
values except with the probability :func:`miss_probability` gives.

All pairs within that distance are found by the pigeonhole principle: of four
chunks one holds at most DISTANCE // 4 errors.  Every chunk is therefore indexed
once for each choice of the values that may be wrong, by the values that are
left; equal keys are exactly the pairs with few enough errors in some chunk.

Equal sets are one node from the start.  Nodes are only compared in full if they
share a bucket, lie within the distance, and their sizes and parity sketches
(exact bounds) allow a link.  Each node is compared with a few of its buckets'
hubs first, and linked nodes are merged; then all pairs that are still of
different components are compared.  A group of thousands of copies is not expanded into its
pairs.  Links are confirmed on full sets.

Shingles are compared as 64-bit hashes and sets as 128-bit digests of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.components import components
from postpulse.llm.ngram_join import SKETCH, digest, gram_sets, sketch
from postpulse.llm.tables import slices, stored, text_bytes
from postpulse.llm.words import mixed

WORDS, PERCENT = 5, 85
CHUNKS, WIDTH, BITS = 4, 5, 14
DISTANCE = 11
HUBS = 16
_ENTRY = ("node", "n", "root", "signature", "sketch")
VALUES = CHUNKS * WIDTH
ERRORS = DISTANCE // CHUNKS  # the most errors in a pair's best chunk
LANES = VALUES // 4  # four values to a 64-bit number, 16 bits apart
# Odd numbers; multiplying the (already mixed) shingle hashes by one is a bijection.
MULTIPLIERS = mixed(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
# Per choice of the values that may be wrong in one chunk: the values that are left.
LEFT = [[c * WIDTH + i for i in kept] for c in range(CHUNKS) for kept in combinations(range(WIDTH), WIDTH - ERRORS)]


def miss_probability(similarity: float) -> float:
    """Chance that two sets of this similarity differ in more than ``DISTANCE`` values."""
    p = (1 - similarity) * (1 - 2.0**-BITS)
    return sum(comb(VALUES, k) * p**k * (1 - p) ** (VALUES - k) for k in range(DISTANCE + 1, VALUES + 1))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(set, value): values of ``BITS`` bits; rows of empty sets are zero."""
    result = np.zeros((len(sets), VALUES), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.r_[0, np.cumsum([len(sets[i]) for i in full])[:-1]]
        for j, multiplier in enumerate(MULTIPLIERS):
            result[full, j] = np.minimum.reduceat(flat * multiplier, starts) & np.uint64((1 << BITS) - 1)
    return result


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """(set, choice): which values are left, and what they are, in 64 bits."""
    wide = signature.astype(np.int64)
    keys = np.empty((len(signature), len(LEFT)), np.int64)
    for number, places in enumerate(LEFT):
        key = np.full(len(signature), number, np.int64)
        for place in places:
            key = key << BITS | wide[:, place]
        keys[:, number] = key
    return keys


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = gram_sets(batch.column("text").to_pylist(), WORDS)
        lanes = signatures(sets).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("mark"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) for s in sets], pa.binary()),
                pa.array(list(lanes), pa.list_(pa.int64())),
            ],
            names=["doc_id", "mark", "n", "set", "signature"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        lanes = batch.column("signature").flatten().to_numpy(zero_copy_only=False).reshape(-1, LANES)
        keys = bucket_keys(np.ascontiguousarray(lanes).view(np.uint16))
        nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
        sizes = np.repeat(batch.column("n").to_numpy(), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes), pa.array(sizes)], names=["key", "node", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the fetched texts; the rows of one node are neighbours, and one of them is used."""
    last = None
    for batch in slices(batches):
        nodes = batch.column("node").to_pylist()
        use = [i for i, node in enumerate(nodes) if node != (nodes[i - 1] if i else last)]
        last = nodes[-1] if nodes else last
        sets = gram_sets(batch.column("text").take(pa.array(use, pa.int64())).to_pylist(), WORDS)
        grams = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        sketches = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in use], pa.int64()), grams, sketches], names=["node", "grams", "sketch"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        left, right = batch.column("grams_u"), batch.column("grams_v")
        keep = []
        for i in range(batch.num_rows):
            a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
            shared = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * shared >= PERCENT * (len(a) + len(b) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("u"), F.col("grams").alias("grams_u"))
    right = sets.select(F.col("node").alias("v"), F.col("grams").alias("grams_v"))
    return pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").mapInArrow(_confirmed, "u long, v long")


def _differing(u: str, v: str) -> str:
    """SQL: number of values in which two signatures differ.

    Adding 2^BITS - 1 to a value's XOR sets the bit above it unless the XOR is zero.
    """
    ones = sum(1 << 16 * i for i in range(4))
    lanes = [f"bit_count((({u}[{i}] ^ {v}[{i}]) + {((1 << BITS) - 1) * ones}L) & {(1 << BITS) * ones}L)" for i in range(LANES)]
    return "(" + " + ".join(lanes) + ")"


def _may_link(u: str, v: str) -> str:
    """SQL: two entries of a bucket are of different components and could link, by exact bounds and the distance."""
    # linked sets differ in few shingles, so their sketches in few bits
    apart = " + ".join(f"bit_count({u}.sketch[{i}] ^ {v}.sketch[{i}])" for i in range(SKETCH))
    return (
        f"{u}.root <> {v}.root and 100 * least({u}.n, {v}.n) >= {PERCENT} * greatest({u}.n, {v}.n)"
        f" and ({apart}) * {100 + PERCENT} <= {100 - PERCENT} * ({u}.n + {v}.n)"
        f" and {_differing(f'{u}.signature', f'{v}.signature')} <= {DISTANCE}"
    )


def _open_buckets(entries: DataFrame, joined: DataFrame) -> DataFrame:
    """Entries with their component as ``root``, of the buckets that hold several components; stored."""
    placed = entries.drop("root").join(joined.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    placed = stored(placed.withColumn("root", F.coalesce("root", "node")).drop("of"), "placed")
    several = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    return placed.join(several.hint("merge"), "key")


def _hub_pairs(entries: DataFrame) -> DataFrame:
    """(u, v): every node with up to three of its buckets' hubs that it may link to.

    A bucket has at most ``HUBS`` hubs.  A node takes the nearest, and the first
    and last in an order that all nodes share: these join the hubs' groups.
    """
    slot, order = (F.xxhash64("node", F.lit(x)) for x in (0, 1))
    hubs = entries.groupBy("key", F.pmod(slot, F.lit(HUBS)).alias("slot")).agg(F.max(F.struct(order.alias("order"), *_ENTRY)).alias("v"))
    met = entries.select("key", F.struct(*_ENTRY).alias("u")).join(hubs.select("key", "v").hint("merge"), "key").filter(_may_link("u", "v"))
    distance, hub = F.expr(_differing("u.signature", "v.signature")), F.col("v.node").alias("v")
    chosen = [F.min(F.struct(distance, hub))["v"], F.min(F.struct("v.order", hub))["v"], F.max(F.struct("v.order", hub))["v"]]
    return met.groupBy(F.col("u.node").alias("u")).agg(F.array(*chosen).alias("v")).select("u", F.explode(F.array_distinct("v")).alias("v"))


def link(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents`` (doc_id, text).

    ``kept`` marks the rows whose doc_id names their component.  Null or wordless
    texts have the empty set and link with nothing.  Repeated rows stay repeated
    and are all kept or all not.  Rows without doc_id take part, but cannot name a
    component; their component_id is null when no linked row has an id, and kept
    is null-safe (true only then).  Equal ids with different texts are separate
    documents that share their id.  Further columns are ignored.
    """
    texts = text_bytes(documents, ("doc_id", "long")).withColumn("mark", F.xxhash64("text"))
    rows = stored(texts.mapInArrow(_summaries, "doc_id long, mark long, n long, set binary, signature array<long>"), "sets")
    # a node per distinct set, named by the row that its text is fetched from
    nodes = rows.filter("set is not null").groupBy("set").agg(F.min(F.struct("doc_id", "mark")).alias("row"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    postings = stored(nodes.select("node", "n", "signature").mapInArrow(_keys, "key long, node long, n long"), "postings")
    several = postings.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = stored(postings.join(several.hint("merge"), "key"), "shared")

    compared = shared.select("node").distinct().join(nodes.hint("merge"), "node").select("node", "row.doc_id", "row.mark")
    fetched = texts.join(compared.hint("merge"), (texts["doc_id"].eqNullSafe(compared["doc_id"])) & (texts["mark"] == compared["mark"])).select("node", "text")
    sets = stored(fetched.mapInArrow(_sets, "node long, grams array<long>, sketch array<long>"), "shingle-sets")

    # where adaptive execution split a row's repeats over tasks, its set is there more than once
    sketches = sets.groupBy("node").agg(F.first("sketch").alias("sketch"))
    known = nodes.select("node", "signature").join(sketches.hint("merge"), "node")
    entries = stored(shared.select("key", "node", "n").join(known.hint("merge"), "node").withColumn("root", F.col("node")), "entries")
    first = stored(_links(_hub_pairs(entries), sets), "links")
    entries = _open_buckets(entries, stored(components(first), "joined"))

    # then all pairs of different components
    x, y = (entries.select(F.col("key").alias(f"key_{s}"), F.struct(*_ENTRY).alias(s)) for s in "uv")
    met = x.hint("merge").join(y, F.expr("key_u = key_v and u.node < v.node") & F.expr(_may_link("u", "v")))
    # a pair that was compared before has one component or is known not to link
    pairs = met.select(F.col("u.node").alias("u"), F.col("v.node").alias("v")).distinct()
    links = stored(first.union(_links(pairs, sets)), "all-links")

    named = components(links).join(nodes.select("node", "doc_id").hint("merge"), "node")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    member = named.select("node", "root").join(least.hint("merge"), "root").select("node", "component_id")
    component = nodes.join(member.hint("merge"), "node", "left").select(F.col("set").alias("of"), F.coalesce("component_id", "doc_id").alias("component_id"))
    named = rows.join(component.hint("merge"), F.col("set") == F.col("of"), "left")
    component_id = F.coalesce("component_id", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))

"""Gradient-boosted trees for several classes, over sparse rows.

Every round grows one regression tree per class, all fitted to the same softmax
probabilities: the residual ``y - p`` of a class is its tree's target, splits
maximise the weighted squared difference of the sides' means, and a leaf takes a
Newton step.  The trees of a round grow level by level together.  Rows are put
into blocks, their entries dealt by term to slots; a slot keeps its entries for
many rounds, sorted by term and bin, and the node and margins of every row.  A
level adds up the residuals of a slot's terms, then the slots tell each other
their best splits (barrier tasks), and the slot that holds the term of a split
tells which rows go right, a bit per row.  What reaches the driver is the model.

Weights are replaced by bin numbers (0: term absent) before the first round.
Margins are written down every ``STORED_ROUNDS`` rounds, so a lost task repeats
these rounds only.
"""

from __future__ import annotations

import base64
import json
import tempfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.operators.numbering import number_rows
from postpulse.session import cut_lineage

BINS = 16
TASK_ENTRIES = 300_000  # entries of sparse rows that one task puts into blocks
SLOT_ENTRIES = 8_000_000  # entries of a slot: half a second a level, as waiting for the other slots takes a second
BLOCK_ROWS = 4096  # rows whose entries travel together
MOST_SLOTS = 24  # partitions of terms; each keeps the margins of all rows
HELD_ENTRIES = 100_000  # entries of a slot that are added up at once
HELD_BYTES = 256 << 20  # entries of a slot beyond this lie in a temporary file of the task
STORED_ROUNDS = 40  # rounds after which margins are written down
GAIN_DIGITS = 10  # gains that differ by rounding only count as equal
_MIX = 0x9E3779B97F4A7C15


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i + 1 and 2i + 2); ``term`` -1 marks a leaf.

    Rows whose bin is above ``bin`` go right; on weights, those above ``threshold``.
    """

    term: list[int]
    bin: list[int]
    value: list[float]
    threshold: list[float] = field(default_factory=list)

    @classmethod
    def empty(cls, depth: int) -> Tree:
        nodes = 2 ** (depth + 1) - 1
        return cls([-1] * nodes, [0] * nodes, [0.0] * nodes, [0.0] * nodes)


@dataclass
class Setting:
    rounds: int = 100
    depth: int = 3
    learning_rate: float = 0.1
    min_leaf: int = 1
    subsample: float = 1.0
    seed: int = 0


class _Rows:
    """A batch of sparse rows, its entries sorted by term."""

    def __init__(self, ids: pa.Array, cells: pa.Array):
        counts = np.diff(ids.offsets.to_numpy())
        self.count = len(ids)
        term = ids.flatten().to_numpy(zero_copy_only=False)
        cell = cells.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(self.count), counts)
        order = np.argsort(term, kind="stable")
        self.term, self.cell, self.owner = term[order], cell[order], owner[order]

    def right(self, term: int, above: float) -> np.ndarray:
        """Which rows hold ``term`` with a cell above the bound (0 where it is absent)."""
        a, b = np.searchsorted(self.term, [term, term + 1])
        inside = np.full(self.count, above < 0)
        inside[self.owner[a:b]] = self.cell[a:b] > above
        return inside

    def nodes(self, tree: Tree, weights: bool = False) -> np.ndarray:
        """The node in which every row comes to rest."""
        at = np.zeros(self.count, np.int64)
        bounds = tree.threshold if weights else tree.bin
        for node, term in enumerate(tree.term):
            if term >= 0:
                here = at == node
                if here.any():
                    at[here] = 2 * node + 1 + self.right(term, bounds[node])[here]
        return at

    def add(self, margins: np.ndarray, rounds: Sequence[Sequence[Tree]], rate: float, weights: bool = False) -> np.ndarray:
        for trees in rounds:
            for k, tree in enumerate(trees):
                margins[:, k] += rate * np.asarray(tree.value)[self.nodes(tree, weights)]
        return margins


def softmax(margins: np.ndarray) -> np.ndarray:
    power = np.exp(margins - margins.max(axis=1, keepdims=True))
    return power / power.sum(axis=1, keepdims=True)


def sampled(marks: np.ndarray, number: int, setting: Setting) -> np.ndarray:
    """Rows that a round uses; a row's part in it depends on its mark, the round and the seed only."""
    if setting.subsample >= 1:
        return np.ones(len(marks), bool)
    key = np.uint64((setting.seed * 1_000_003 + number + 1) * _MIX % (1 << 64))
    x = (marks.view(np.uint64) ^ key) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = (x * np.uint64(0x94D049BB133111EB)) >> np.uint64(11)
    return x.astype(float) / 2.0**53 < setting.subsample


_PIECE_SQL = "block long, label binary, mark binary, margins binary, code binary, owner binary"
_BLOCK_SQL = "block long, label binary, mark binary, margins binary, term binary, cell binary, owner binary"
_GROWN_SQL = "block long, label binary, mark binary, margins binary, trees binary"


def _blocks(start: Sequence[float], block_rows: int):
    """Rows put together to blocks of at most ``block_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first in range(0, batch.num_rows, block_rows):
                part = batch.slice(first, block_rows)
                rows = _Rows(part.column("ids"), part.column("bins"))
                kinds = (part.column("label").to_numpy(), np.int32), (part.column("mark").to_numpy(), np.int64), (np.tile(np.array(start), (rows.count, 1)), float)
                entries = ((v, np.int32) for v in (rows.term, rows.cell, rows.owner))
                values = [np.ascontiguousarray(v, kind).tobytes() for v, kind in (*kinds, *entries)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], names=["block", "label", "mark", "margins", "term", "cell", "owner"])
                number += 1

    return run


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _cells(slots: int):
    """Every block's entries dealt by term, in the order of term, bin and row: one row per block and slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows_of(batch):
                term, cell, owner = (np.frombuffer(row[c], np.int32) for c in ("term", "cell", "owner"))
                order = np.lexsort((owner, cell, term))
                term, cell, owner = term[order], cell[order], owner[order]
                code = term // slots * BINS + cell - 1
                for slot in range(slots):
                    mine = term % slots == slot
                    values = [pa.array([v], kind) for v, kind in ((slot, pa.int32()), (row["block"], pa.int64()), (code[mine].tobytes(), pa.binary()), (owner[mine].tobytes(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(values, names=["slot", "block", "code", "owner"])

    return run


def _room(size: int, kind: type) -> np.ndarray:
    """An array in memory, a large one in a file that goes with the task."""
    if size * np.dtype(kind).itemsize <= HELD_BYTES:
        return np.empty(size, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(size,))


class _Slot:
    """The entries of a slot's terms, sorted by term, bin and row, and the rows of all blocks in one order."""

    def __init__(self, batches: Iterator[pa.RecordBatch], terms: int, classes: int):
        self.count = np.zeros(terms * BINS, np.int64)  # entries per term and bin
        blocks, found = {}, []
        with tempfile.SpooledTemporaryFile(HELD_BYTES) as kept:
            for batch in batches:
                for row in _rows_of(batch):
                    if row["label"] is not None:
                        blocks[row["block"]] = row
                        continue
                    codes, counts = np.unique(np.frombuffer(row["code"], np.int32), return_counts=True)
                    self.count[codes] += counts
                    found.append((row["block"], codes, counts, kept.tell(), len(row["owner"])))
                    kept.write(row["owner"])
            self.names = sorted(blocks)
            self.labels = [blocks[b]["label"] for b in self.names]
            self.marks = [blocks[b]["mark"] for b in self.names]
            self.sizes = [len(v) // 4 for v in self.labels]
            first = dict(zip(self.names, np.cumsum([0, *self.sizes])))
            self.rows = sum(self.sizes)
            self.ends = np.cumsum(self.count)
            place = self.ends - self.count
            self.owner = _room(int(self.count.sum()), np.int32)
            for block, codes, counts, at, length in sorted(found, key=lambda f: f[0]):
                kept.seek(at)
                within = np.arange(length // 4) - np.repeat(np.cumsum(counts) - counts, counts)
                self.owner[np.repeat(place[codes], counts) + within] = np.frombuffer(kept.read(length), np.int32) + np.int32(first[block])
                place[codes] += counts
        self.label = np.frombuffer(b"".join(self.labels), np.int32)
        self.mark = np.frombuffer(b"".join(self.marks), np.int64)
        self.margins = np.concatenate([np.empty((0, classes)), *[np.frombuffer(blocks[b]["margins"], float).reshape(-1, classes) for b in self.names]])

    def parts(self, most: int) -> Iterator[tuple[int, int]]:
        """Runs of terms with about ``most`` entries (a more frequent term is alone)."""
        ends = self.ends[BINS - 1 :: BINS]
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield start, stop
            start = stop

    def above(self, term: int, cell: int) -> np.ndarray:
        """Rows that hold ``term`` in a bin above ``cell``."""
        last = self.ends[term * BINS + BINS - 1]
        code = term * BINS + cell
        return self.owner[self.ends[code] - self.count[code] : last]


def _offer(n: np.ndarray, g: np.ndarray, all_n: int, all_g: float, min_leaf: int) -> tuple[float, int, int] | None:
    """Gain, term and bin of the best split of a node; ``n`` and ``g`` are counts and residuals by (bin, term).

    Equal gains go to the lower term, then to the lower bin.  Right of a split at
    bin b is everything above b.
    """
    held = n > 0
    for cell in range(BINS - 1, 0, -1):  # everything at or above a bin
        n[cell - 1] += n[cell]
        g[cell - 1] += g[cell]
    at = np.flatnonzero(held & (n >= min_leaf) & (n <= all_n - max(min_leaf, 1)))
    if not len(at):
        return None
    right, sums = n.ravel()[at], g.ravel()[at]
    left = all_n - right
    gain = np.round(right * left / all_n * (sums / right - (all_g - sums) / left) ** 2, GAIN_DIGITS)
    best = gain.max()
    if best <= 0:
        return None
    cell, term = np.divmod(at[gain == best], n.shape[1])
    first = np.lexsort((cell, term))[0]
    return float(best), int(term[first]), int(cell[first])


def _offers(slot: _Slot, plane: np.ndarray, residual: np.ndarray, width: int, totals: np.ndarray, min_leaf: int, whole: bool, most: int) -> dict[int, tuple[float, int, int]]:
    """Per place with rows the best split among the slot's terms; ``whole``: all rows are in the root."""
    best: dict[int, tuple[float, int, int]] = {}
    classes = len(residual)
    for start, stop in slot.parts(most):
        codes = slice(start * BINS, stop * BINS)
        count, terms = slot.count[codes], stop - start
        owner = np.asarray(slot.owner[(slot.ends[codes.start] - count[0]) : slot.ends[codes.stop - 1]])
        size = BINS * terms
        at = np.repeat((np.arange(terms)[:, None] + np.arange(BINS) * terms).ravel(), count)
        held = count.reshape(terms, BINS).T.astype(float)
        for k in range(classes):
            if whole:
                n, g = held.copy(), np.bincount(at, residual[k][owner], size)
            else:
                of = plane[k][owner] * size + at
                n = np.bincount(of, minlength=(width + 1) * size).astype(float)
                g = np.bincount(of, residual[k][owner], (width + 1) * size)
            n, g = n.reshape(-1, BINS, terms), g.reshape(-1, BINS, terms)
            for node in range(width):
                all_n, all_g = totals[k, node, :2]
                found = all_n and _offer(n[node], g[node], all_n, all_g, min_leaf)
                place = k * width + node
                if found and (place not in best or found[0] > best[place][0]):
                    best[place] = found[0], found[1] + start, found[2]
    return best


def _grown(slots: int, size: int, first: int, last: int, classes: int, setting: Setting, held_entries: int):
    """The trees of some rounds, grown by all slots together, and the margins of the rows after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        together = _told if slots > 1 else lambda offers, right: [(offers, right)]
        slot = _Slot(batches, -(-(size - me) // slots) if size > me else 0, classes)
        margins = np.ascontiguousarray(slot.margins.T)
        trees = [_grow(slot, margins, me, slots, number, setting, together, held_entries) for number in range(first, last)]
        if me:
            return
        parts = np.split(margins.T, np.cumsum(slot.sizes)[:-1])
        for block, label, mark, part in zip(slot.names, slot.labels, slot.marks, parts):
            yield _grown_row(block, label, mark, np.ascontiguousarray(part).tobytes(), None)
        yield _grown_row(-1, None, None, None, json.dumps([[(t.term, t.bin, t.value) for t in r] for r in trees]).encode())

    return run


def _told(offers: dict[int, tuple[float, int, int]], right: np.ndarray) -> list[tuple[dict, np.ndarray]]:
    """What every slot offers, and per class the rows that its offers send right."""
    bits = base64.b64encode(zlib.compress(np.packbits(right).tobytes(), 1)).decode()
    found = []
    for message in BarrierTaskContext.get().allGather(json.dumps([list(offers.items()), bits])):
        told, bits = json.loads(message)
        packed = np.frombuffer(zlib.decompress(base64.b64decode(bits)), np.uint8)
        found.append((dict(told), np.unpackbits(packed, count=right.size).view(bool).reshape(right.shape)))
    return found


def _grown_row(block: int, *values: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], names=["block", "label", "mark", "margins", "trees"])


def _grow(slot: _Slot, margins: np.ndarray, me: int, slots: int, number: int, setting: Setting, together: Callable, held_entries: int) -> list[Tree]:
    """The trees of one round, one pass over the slot's entries per level; adds the round to ``margins``."""
    classes = len(margins)
    trees = [Tree.empty(setting.depth) for _ in range(classes)]
    residual = (slot.label == np.arange(classes)[:, None]) - softmax(margins.T).T
    residual = np.ascontiguousarray(residual)
    live = sampled(slot.mark, number, setting)
    whole = bool(live.all())
    used = slice(None) if whole else live
    at = np.zeros((classes, slot.rows), np.int32)  # every row's node
    nodes = 2 ** (setting.depth + 1) - 1

    def sums(k: int) -> np.ndarray:
        """Rows, residuals and hessians per node of a class."""
        g = residual[k][used]
        h = np.abs(g) * (1 - np.abs(g))
        return np.stack([np.bincount(at[k][used], w, nodes) for w in (None, g, h)], axis=1)

    def newton(g: float, h: float) -> float:
        return (classes - 1) / classes * g / h if h > 1e-150 else 0.0

    totals = np.stack([sums(k) for k in range(classes)])
    for k, tree in enumerate(trees):
        tree.value[0] = newton(*totals[k, 0, 1:].tolist())
    for level in range(setting.depth):
        width, above = 2**level, 2**level - 1
        plane_of = at - above
        plane = np.where((plane_of < 0) | ~live, width, plane_of)  # in no node of this level
        mine = _offers(slot, plane, residual, width, totals[:, above : above + width], setting.min_leaf, level == 0 and whole, held_entries)
        offered = np.zeros((classes, slot.rows), bool)
        for place, (_, term, cell) in mine.items():
            k, node = divmod(place, width)
            rows = slot.above(term, cell)
            offered[k, rows[at[k][rows] == node + above]] = True
        told = together(mine, offered)
        best: dict[int, tuple] = {}
        for other, (offers, _) in enumerate(told):
            for place, (gain, term, cell) in offers.items():
                found = (-gain, term * slots + other, cell)
                best[place] = min(best.get(place, found), found)
        if not best:
            break
        right = np.zeros((classes, slot.rows), bool)
        parted = np.zeros((classes, nodes), bool)
        for place, (_, term, cell) in sorted(best.items()):
            k, node = divmod(place, width)
            trees[k].term[node + above], trees[k].bin[node + above] = term, cell
            parted[k, node + above] = True
            right[k] |= told[term % slots][1][k] & (plane_of[k] == node)
        for k, tree in enumerate(trees):
            at[k] = np.where(parted[k][at[k]], 2 * at[k] + 1 + right[k], at[k])
            totals[k] = sums(k)
            for node in np.flatnonzero(parted[k]):
                for child in (2 * node + 1, 2 * node + 2):
                    tree.value[child] = newton(*totals[k, child, 1:].tolist())
    for k, tree in enumerate(trees):
        margins[k] += setting.learning_rate * np.asarray(tree.value)[at[k]]
    return trees


def _slot_keys(spark: SparkSession, slots: int) -> list[int]:
    """Numbers that Spark deals to ``slots`` different partitions of as many."""
    found: dict[int, int] = {}
    first = 0
    while len(found) < slots:
        more = spark.range(first, first + 64 * slots).select("id", F.pmod(F.hash("id"), F.lit(slots)).alias("to"))
        for row in more.groupBy("to").agg(F.min("id").alias("id")).collect():
            found.setdefault(row["to"], row["id"])
        first += 64 * slots
    return [found[to] for to in sorted(found)]


def bin_edges(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """``term, edges``: upper ends of all bins but the last, from the weights that occur.

    Up to ``bins`` distinct weights get a bin each; more are cut at their quantiles.
    """
    entries = rows.select(F.explode(F.arrays_zip("ids", "weights")).alias("e")).select(F.col("e.ids").alias("term"), F.col("e.weights").alias("w"))
    values = cut_lineage(entries.distinct(), "term-weights")
    cuts = F.percentile_approx("w", [i / bins for i in range(1, bins)], 10_000)
    grouped = values.groupBy("term").agg(F.count("*").alias("many"), F.max("w").alias("top"), cuts.alias("cuts"))
    few = values.join(grouped.filter(F.col("many") <= bins).select("term"), "term").groupBy("term").agg(F.array_sort(F.collect_set("w")).alias("v"))
    few = few.select("term", F.slice("v", F.lit(1), F.size("v") - 1).alias("edges"))
    many = grouped.filter(F.col("many") > bins).select("term", F.array_distinct(F.filter("cuts", lambda c: c < F.col("top"))).alias("edges"))
    return few.unionByName(many)


def binned(rows: DataFrame, edges: DataFrame, carry: Sequence[str] = (), name: str = "term") -> DataFrame:
    """``carry, mark, ids, bins``: weights as bin numbers from 1, ids ascending; ``name`` is the column of ``edges`` that they are from."""
    marked = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("mark", F.xxhash64("ids", "weights", "_row")), "marked")
    entries = marked.select("_row", F.explode(F.arrays_zip("ids", "weights")).alias("e"))
    entries = entries.select("_row", F.col("e.ids").alias("term"), F.col("e.weights").alias("w"))
    number = F.size(F.filter("edges", lambda e: e < F.col("w"))) + 1
    pairs = entries.join(edges, "term").select("_row", F.struct(F.col(name).alias("term"), number.alias("bin")).alias("p"))
    grouped = pairs.groupBy("_row").agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = marked.select(*carry, "mark", "_row").join(grouped, "_row", "left")
    none = F.array().cast("array<struct<term:bigint,bin:int>>")
    joined = joined.withColumn("p", F.coalesce("p", none))
    return joined.select(*carry, "mark", F.transform("p", lambda p: p["term"]).alias("ids"), F.transform("p", lambda p: p["bin"]).alias("bins"))


@dataclass
class Boosted:
    """Starting margins, and per round one tree per class."""

    start: list[float]
    rounds: list[list[Tree]]
    rate: float

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (r, k, node, tree.term[node], tree.bin[node], tree.threshold[node], tree.value[node])
            for r, trees in enumerate(self.rounds)
            for k, tree in enumerate(trees)
            for node in range(len(tree.term))
        ]
        nodes = spark.createDataFrame(rows, "round int, class int, node int, term bigint, bin int, threshold double, value double")
        nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        meta = spark.createDataFrame([(self.start, self.rate)], "start array<double>, rate double")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/boosted")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        meta = spark.read.parquet(f"{path}/boosted").first()
        classes, rounds = len(meta["start"]), []
        for row in spark.read.parquet(f"{path}/trees").orderBy("round", "class", "node").collect():
            if row["round"] == len(rounds):
                rounds.append([Tree([], [], [], []) for _ in range(classes)])
            tree = rounds[row["round"]][row["class"]]
            for values, name in ((tree.term, "term"), (tree.bin, "bin"), (tree.value, "value"), (tree.threshold, "threshold")):
                values.append(row[name])
        return cls(list(meta["start"]), rounds, meta["rate"])


def fit_boosted(rows: DataFrame, classes: int, setting: Setting, slots: int | None = None) -> Boosted:
    """Trees for ``rows(label int, ids, weights)``; labels are 0 .. ``classes`` - 1.

    A leaf that does not split keeps its value; a class whose residuals offer no
    gain gets a single leaf.  ``slots`` is the number of partitions that terms are
    dealt to (by default as many as the entries fill, up to ``MOST_SLOTS``); no more
    than the tasks that can run side by side.
    """
    spark = rows.sparkSession
    edges = bin_edges(rows)
    if setting.min_leaf > 1:
        # the right side of a split holds its term: rarer terms never split
        held = rows.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        edges = edges.join(held.filter(F.col("n") >= setting.min_leaf), "term", "left_semi")
    edges = cut_lineage(number_rows(edges, "term", name="place"), "edges")
    size = edges.count()
    table = binned(rows, edges, ["label"], "place")
    counts = dict(rows.groupBy("label").count().collect())
    shares = np.array([counts.get(k, 0) for k in range(classes)], float)
    # a class without rows starts as if it had a millionth of one
    start = np.log(np.maximum(shares, 1e-6) / max(shares.sum(), 1.0)).tolist()
    table = cut_lineage(table, "boosting")
    # the slots run side by side and tell each other their splits
    entries, count = table.agg(F.sum(F.size("ids")), F.count("*")).first()
    if not count:
        return Boosted(start, [[Tree.empty(setting.depth) for _ in range(classes)] for _ in range(setting.rounds)], setting.learning_rate)
    parts = 1 + max((entries or 0) // TASK_ENTRIES, count // BLOCK_ROWS)
    slots = min(slots or min(1 + (entries or 0) // SLOT_ENTRIES, MOST_SLOTS), _tasks_at_once(spark))
    blocks = cut_lineage(table.repartition(parts).mapInArrow(_blocks(start, BLOCK_ROWS), _BLOCK_SQL), "blocks")
    cells = blocks.select("block", "term", "cell", "owner").mapInArrow(_cells(slots), "slot int, block long, code binary, owner binary")
    cells = cut_lineage(cells, "cells")
    done: list[list[Tree]] = []
    for first in range(0, setting.rounds, STORED_ROUNDS):
        last = min(first + STORED_ROUNDS, setting.rounds)
        every = blocks.select(F.explode(F.array(*[F.lit(i) for i in range(slots)])).alias("slot"), "block", "label", "mark", "margins")
        pieces = _dealt(cells.unionByName(every, allowMissingColumns=True), slots).select(*[c.split()[0] for c in _PIECE_SQL.split(", ")])
        grown = pieces.mapInArrow(_grown(slots, size, first, last, classes, setting, HELD_ENTRIES), _GROWN_SQL, barrier=slots > 1)
        blocks = cut_lineage(grown, "blocks")
        told = json.loads(blocks.filter("trees is not null").first()["trees"])
        done += [[Tree(*t, [0.0] * len(t[0])) for t in trees] for trees in told]
        blocks = blocks.filter("trees is null")
    _set_thresholds(done, edges)
    return Boosted(start, done, setting.learning_rate)


def _tasks_at_once(spark: SparkSession) -> int:
    """How many tasks that wait for each other can run; one where the number of executors may change."""
    context = spark.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    inner = context._jsc.sc()
    return max(1, inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile()))


def _dealt(pieces: DataFrame, slots: int) -> DataFrame:
    """The rows of every ``slot``, numbered from 0, in a partition of their own."""
    if hasattr(pieces, "repartitionById"):
        return pieces.repartitionById(slots, "slot")
    keys = F.array(*[F.lit(k) for k in _slot_keys(pieces.sparkSession, slots)])  # before Spark 4.1
    return pieces.repartition(slots, F.get(keys, F.col("slot")))


def _set_thresholds(rounds: list[list[Tree]], edges: DataFrame) -> None:
    """Places and bins of splits as terms and weights; only those of splits are fetched, a bounded number."""
    used = sorted({t for trees in rounds for tree in trees for t in tree.term if t >= 0})
    if not used:
        return
    wanted = edges.sparkSession.createDataFrame([(t,) for t in used], "place bigint")
    ends = {r["place"]: (r["term"], r["edges"]) for r in edges.join(F.broadcast(wanted), "place").collect()}
    for trees in rounds:
        for tree in trees:
            for node, place in enumerate(tree.term):
                if place >= 0:
                    tree.term[node], edge = ends[place]
                    tree.threshold[node] = edge[tree.bin[node] - 1] if tree.bin[node] else 0.0


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Boosted = model.value
        for batch in batches:
            rows = _Rows(batch.column("ids"), batch.column("weights"))
            margins = rows.add(np.tile(np.array(found.start), (rows.count, 1)), found.rounds, found.rate, weights=True)
            names = [n for n in batch.schema.names if n not in ("ids", "weights")]
            best = pa.array(margins.argmax(axis=1) if rows.count else [], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], best], names=[*names, "class"])

    return run


def predict_boosted(rows: DataFrame, model: Boosted) -> DataFrame:
    """``ids, weights`` replaced by ``class``: the number of the highest margin, the first on ties."""
    kept = [c for c in rows.columns if c not in ("ids", "weights")]
    kinds = "".join(f"`{c}` {dict(rows.dtypes)[c]}, " for c in kept)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.select(*kept, "ids", "weights").mapInArrow(_scored(shared), f"{kinds}class int")

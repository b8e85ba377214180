"""Approximate nearest neighbours by inner product, with an adaptive dimension scan.

Vectors are assigned to lists by a coarse quantiser fitted on a bounded sample.
One more coordinate gives all vectors the same length, so that the largest inner
product is the smallest distance; a random rotation then makes any leading
coordinates a fair sample of the distance.  Inside a probed list the rotated
coordinates are scanned in column blocks.  After each block a hypothesis test
compares the partial distance with the query's bound and abandons the candidates
that are very unlikely to enter the result; the rest get their exact inner
product on the original vectors in double precision.  The bound is the distance
of the query's last wanted neighbour within the sample, whose nearest rows enter
the result as well: the lists need only offer nearer ones.

Lists are cut into blocks of bounded size, so a list that a third of all vectors
fall into is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postpulse.llm.tables import column, slices, stored

# The fit's sample: vectors for the centroids and the scale, and queries for the number of probes.
SAMPLE, SAMPLE_QUERIES = 20_000, 400
BLOCK_ROWS = 4096
QUERY_CHUNK = 256


@dataclass(frozen=True)
class Search:
    """``confidence`` is the test's allowance; probes are chosen for ``recall`` on the sample."""

    nearest: int = 20
    recall: float = 0.95
    confidence: float = 2.1
    list_rows: int = 512
    seed: int = 11


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray
    rotation: np.ndarray
    scale: float
    probes: int
    sample: np.ndarray
    sample_ids: np.ndarray

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors with one more coordinate; vectors beyond the sample's scale stay longer."""
        x = x / self.scale
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def sampled(self, q: np.ndarray, ids: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, sampled row, score): the nearest sampled vectors other than the query's own."""
        score = q @ self.sample.T
        score[ids[:, None] == self.sample_ids[None, :]] = -np.inf
        k = min(nearest, score.shape[1])
        row = np.argpartition(-score, k - 1, axis=1)[:, :k].ravel()
        query = np.repeat(np.arange(len(q)), k)
        use = self.sample_ids[row] != ids[query]
        query, row = query[use], row[use]
        return query, row, products(self.sample[row], q[query])

    def asked(self, q: np.ndarray) -> np.ndarray:
        q = q / np.linalg.norm(q, axis=1)[:, None]
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed in one fixed order, so that equal vectors tie exactly."""
    return (x * q).sum(axis=1)


def vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x: bytes of doubles) of the usable rows.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without id and vectors of another length than most.
    """
    values = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), values.alias("x")).filter(
        "vec_id is not null and x is not null and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity')) and exists(x, v -> v <> 0)"
    )
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = batch.column("x").flatten().to_numpy()
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * (8 * d)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed], names=["vec_id", "x"])

    return rows.filter(F.size("x") == d).mapInArrow(pack, "vec_id long, x binary")


def unpacked(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def _centroids(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[random.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = squared(x, centres).argmin(axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def fit(points: DataFrame, rule: Search) -> Quantiser | None:
    """Centroids, rotation and number of probes from a sample of at most ``SAMPLE`` vectors.

    The sample is drawn by hash.  The number of lists follows the number of
    vectors; every vector is put into a list later.
    """
    total = points.count()
    if not total:
        return None
    order = F.xxhash64(F.lit(rule.seed), "vec_id", "x")
    drawn = points.orderBy(order, "vec_id").limit(SAMPLE).toArrow()
    sample, sample_ids = unpacked(drawn.column("x").to_pylist()), drawn.column("vec_id").to_numpy()
    random = np.random.default_rng(rule.seed)
    d = sample.shape[1] + 1
    rotation, _ = np.linalg.qr(random.normal(size=(d, d)))
    scale = float(np.sqrt((sample * sample).sum(axis=1)).max())
    plain = Quantiser(np.zeros((1, d)), rotation, scale, 1, sample, sample_ids)
    x = plain.lengthened(sample)
    k = int(np.clip(np.sqrt(total * total / rule.list_rows / 64), 1, min(max(1, total // rule.list_rows), len(sample) // 8, 4096))) or 1
    centres = _centroids(x, k, random)
    picked = random.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)
    asked = plain.asked(sample[picked])
    near = np.argpartition(squared(asked, x), min(rule.nearest, len(x) - 1), axis=1)[:, : rule.nearest + 1]
    lists = squared(x, centres).argmin(axis=1)
    place = squared(asked, centres).argsort(axis=1).argsort(axis=1)
    depth = np.sort(np.take_along_axis(place, lists[near], axis=1).ravel())
    probes = int(depth[min(len(depth) - 1, int(np.ceil(rule.recall * len(depth))))]) + 1
    return Quantiser(centres, rotation, scale, min(k, probes), sample, sample_ids)


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, asked: np.ndarray, least: np.ndarray, model: Quantiser, rule: Search):
    """(query, row, score) of the best rows of one block for every query.

    ``least`` are the queries' bounds as inner products.  While many candidates
    are left, a column block is one matrix product over the rows that any query
    still wants; then it is measured pair by pair.  A row longer than the fit's
    scale is never abandoned, as its distance tells nothing.
    """
    points = (model.lengthened(x) @ model.rotation).astype(np.float32)
    wanted = (model.asked(q) @ model.rotation).astype(np.float32)
    norms = np.linalg.norm(q, axis=1)
    bound = np.maximum(2 - 2 * least / (norms * model.scale), 0)
    long = np.linalg.norm(x, axis=1) > model.scale
    d = points.shape[1]
    cuts = list(range(0, d, max(8, -(-d // 8)))) + [d]
    found = []
    for start in range(0, len(q), QUERY_CHUNK):
        own, limit = wanted[start : start + QUERY_CHUNK], bound[start : start + QUERY_CHUNK]
        rows = np.arange(len(x))
        partial = np.zeros((len(own), len(x)), np.float32)
        pairs = None
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            # the full distance leaves no doubt but for rounding
            allowed = limit * (_allowance(high, d, rule.confidence) if high < d else 1.0) + 1e-4
            if pairs is None:
                partial += np.maximum(squared(own[:, low:high], points[rows, low:high]), 0)
                alive = (partial <= allowed[:, None]) | long[rows][None, :]
                if alive.mean() < 0.1:
                    which, at = np.nonzero(alive)
                    pairs = which, rows[at], partial[which, at]
                else:
                    some = alive.any(axis=0)
                    rows, partial = rows[some], np.where(alive[:, some], partial[:, some], np.float32(np.inf))
                    partial[:, long[rows]] = np.where(np.isinf(partial[:, long[rows]]), 0, partial[:, long[rows]])
            else:
                which, row, seen = pairs
                step = points[row, low:high] - own[which, low:high]
                seen = seen + (step * step).sum(axis=1)
                stay = (seen <= allowed[which]) | long[row]
                pairs = which[stay], row[stay], seen[stay]
        if pairs is None:
            which, at = np.nonzero(np.isfinite(partial))
            pairs = which, rows[at], None
        which, row = pairs[0] + start, pairs[1]
        score = products(x[row], q[which])
        keep = (ids[row] != asked[which]) & (score >= least[which])
        which, row, score = which[keep], row[keep], score[keep]
        order = np.lexsort((ids[row], -score, which))
        which, row, score = which[order], row[order], score[order]
        best = np.arange(len(which)) - np.searchsorted(which, which) < rule.nearest
        found.append((which[best], row[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _allowance(done: int, d: int, confidence: float) -> float:
    return done / d * (1 + confidence / np.sqrt(done)) ** 2


def search(table: DataFrame, queries: DataFrame, rule: Search | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``nearest`` rows of ``table`` for every row of ``queries``.

    Both tables have the columns of ``vectors`` and a query must be a row of the
    table; rows with its id are not its neighbours.  Ties go to the smaller
    vec_id.  Repeated queries are answered once, and repeated rows of the table count
    once.
    """
    rule = rule or Search()
    table = stored(table, "points")
    model = fit(table, rule)
    spark = table.sparkSession
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def assign(batches):
        for batch in slices(batches):
            x = unpacked(batch.column("x").to_pylist())
            lists = squared(model.lengthened(x), model.centroids).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(lists, pa.int64())], names=["vec_id", "x", "list"])

    placed = stored(table.mapInArrow(assign, "vec_id long, x binary, list long"), "lists")
    counts = np.zeros(len(model.centroids), np.int64)
    for row in placed.groupBy("list").count().collect():
        counts[row["list"]] = row["count"]
    parts = np.maximum(1, -(-counts // BLOCK_ROWS))
    start = np.concatenate([[0], np.cumsum(parts)])
    blocks = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(counts)), "parts": parts, "start": start[:-1]}))
    placed = placed.join(blocks, "list").withColumn("block", F.expr("start + pmod(xxhash64(vec_id, monotonically_increasing_id()), parts)"))

    def probe(batches):
        for batch in slices(batches, 256):
            q = unpacked(batch.column("x").to_pylist())
            near = squared(model.asked(q), model.centroids).argsort(axis=1)
            enough = np.cumsum(counts[near], axis=1) - counts[near] < rule.nearest + 1
            take = (np.arange(near.shape[1]) < model.probes)[None, :] | enough
            take &= counts[near] > 0
            query = np.repeat(np.arange(len(q)), [int(parts[near[i][take[i]]].sum()) for i in range(len(q))])
            block = np.concatenate([np.arange(start[c], start[c + 1]) for i in range(len(q)) for c in near[i][take[i]]])
            which, _, score = model.sampled(q, batch.column("vec_id").to_numpy(), rule.nearest)
            least = np.full(len(q), np.inf)
            np.minimum.at(least, which, score)
            least[np.bincount(which, minlength=len(q)) < rule.nearest] = -np.inf
            cells = batch.column("x").take(pa.array(query))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(query)), cells, pa.array(least[query]), pa.array(block)], names=["query_id", "q", "least", "block"])

    def sampled(batches):
        for batch in slices(batches, 256):
            ids = batch.column("vec_id").to_numpy()
            which, row, score = model.sampled(unpacked(batch.column("x").to_pylist()), ids, rule.nearest)
            yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(model.sample_ids[row]), pa.array(score)], names=["query_id", "vec_id", "score"])

    once = queries.select(column(queries, "vec_id", "long"), "x").dropDuplicates(["vec_id", "x"])
    asked = once.mapInArrow(probe, "query_id long, q binary, least double, block long")

    def work(points: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, query_ids = points["vec_id"].to_numpy(), wanted["query_id"].to_numpy()
        which, row, score = scan(unpacked(points["x"]), ids, unpacked(wanted["q"]), query_ids, wanted["least"].to_numpy(), model, rule)
        return pd.DataFrame({"query_id": query_ids[which], "vec_id": ids[row], "score": score})

    found = placed.select("block", "vec_id", "x").groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(work, "query_id long, vec_id long, score double")
    found = found.union(once.mapInArrow(sampled, "query_id long, vec_id long, score double")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rule.nearest).select("query_id", "rank", "vec_id", "score")

"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

The documents of a source are permuted by a hash and cut into blocks.  A
source's target becomes a quota: a number of positions in its block sequence,
which is walked again from the start when the target exceeds the source.  The
tree splits the vector of quotas: the root holds all of them, and each node
gives its left child a multivariate-hypergeometric share of the size that the
left child's shards need.  A leaf is an output shard; it owns a disjoint range of
positions of every source, so shards are filled independently and each is a fair
sample of the mix.  Inside a shard the documents are ordered by another hash.

The block table has at most ``MAX_BLOCKS`` rows per source, whatever its size, and
one number per source is held on the driver, as the weights are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postpulse.llm.tables import column, stored

# Blocks per source: a fineness, not a limit on documents (blocks grow beyond it).
MAX_BLOCKS = 4096
BLOCK_DOCUMENTS = 32
# Ranges of a shard's order, a power of two; a task sorts one.
SLICES = 16
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order, null last."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.0
    most_repeats: float = 3.0
    shard_words: int = 50_000_000
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared again.

    A source whose share reaches its limit keeps the limit; what it leaves is
    shared among the others by weight, until no share is above its limit.
    """
    limit = most * sizes.astype(float)
    full = np.zeros(len(sizes), bool)
    result = np.zeros(len(sizes))
    while True:
        left = total - limit[full].sum()
        weight = weights[~full].sum()
        result[full] = limit[full]
        if full.all() or weight <= 0:
            return result
        result[~full] = max(left, 0.0) * weights[~full] / weight
        above = ~full & (result > limit)
        if not above.any():
            return result
        full |= above


def leaf_ranges(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and number of positions of every source in one shard.

    Walks from the root to the leaf.  Each node's draw is seeded by the shards
    it covers, so all leaves below it see the same split.
    """
    low, high = 0, shards
    first, quota = np.zeros(len(quotas), np.int64), quotas.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        random = np.random.default_rng([seed, low, high])
        take = int(round(quota.sum() * (middle - low) / (high - low)))
        left = _hypergeometric(random, quota, take)
        if shard < middle:
            high, quota = middle, left
        else:
            low, first, quota = middle, first + left, quota - left
    return first, quota


def _hypergeometric(random: np.random.Generator, quota: np.ndarray, take: int) -> np.ndarray:
    """A multivariate draw as a chain of univariate ones, whose cost doesn't depend on the quotas."""
    result, rest = np.zeros(len(quota), np.int64), int(quota.sum())
    for i, own in enumerate(quota):
        rest -= int(own)
        drawn = _one_hypergeometric(random, int(own), rest, take)
        result[i] = drawn
        take -= drawn
    return result


def _one_hypergeometric(random: np.random.Generator, good: int, bad: int, take: int) -> int:
    if take == 0 or good == 0:
        return 0
    if bad == 0:
        return take
    # the generator takes populations below 10**9
    if good + bad < 10**9:
        return int(random.hypergeometric(good, bad, take))
    mean = take * good / (good + bad)
    spread = mean * (bad / (good + bad)) * ((good + bad - take) / max(good + bad - 1, 1))
    return int(np.clip(round(random.normal(mean, np.sqrt(max(spread, 0)))), max(0, take - bad), min(good, take)))


def _fill(pieces: pd.DataFrame) -> pd.DataFrame:
    """Documents of a source's last block that come nearest to the words still wanted.

    Largest first, each that fits; at the end one more if that is nearer.
    """
    want = float(pieces["want"].iloc[0])
    rows = pieces.sort_values(["size", "u"], ascending=[False, True])
    taken, left = [], want
    for size in rows["size"]:
        fits = size <= left
        taken.append(fits)
        left -= size if fits else 0
    taken = np.array(taken)
    sizes = rows["size"].to_numpy()
    spare = np.flatnonzero(~taken & (sizes < 2 * left))
    if len(spare):
        taken[spare[-1]] = True
    rows = rows[taken].groupby("u").size()
    return pd.DataFrame({"sid": int(pieces["sid"].iloc[0]), "u": rows.index.to_numpy(np.int64), "takes": rows.to_numpy(np.int64)})


@dataclass
class Plan:
    """``rows`` are the input rows with size, source_size, target, copies, taken and shards (one per copy)."""

    rows: DataFrame
    shards: int


def plan_mix(documents: DataFrame, mix: Mix | None = None, keep: Callable[[DataFrame], list[Column]] | None = None) -> Plan:
    """Decide how often every row of ``documents`` (doc_id, source, text) enters the mix, and in which shards.

    ``keep`` names the columns to return besides (default: all).  Null texts and
    texts without words have size 0 and are not taken.  Null is a source of its
    own, the last.  Repeated rows are separate documents.  Null ids are allowed.
    An empty table gives an empty mix.  Columns of the input that are named like
    a result column are to be left out by ``keep``.
    """
    mix = mix or Mix()
    spark = documents.sparkSession
    others = keep(documents) if keep else [documents[f"`{c}`"] for c in documents.columns]
    source, text = column(documents, "source", "string"), F.col("`text`").cast("string")
    plain = documents.select(
        F.struct(*others).alias("row"),
        source.alias("_source"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(mix.seed), F.col("`doc_id`").cast("long"), text).alias("u"),
    )
    lean = plain.select("_source", "size", "u")
    per_source = lean.groupBy("_source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).toPandas()
    known = sorted((s for s in per_source["_source"] if s is not None and s == s), key=lambda s: s.encode("utf-32-be"))
    named = [*known, *([None] if len(known) < len(per_source) else [])]
    at = {s: i for i, s in enumerate(named)}
    per_source["sid"] = [at[s if isinstance(s, str) else None] for s in per_source["_source"]]
    per_source = per_source.sort_values("sid")
    words, n = per_source["words"].to_numpy(np.int64), per_source["n"].to_numpy(np.int64)
    weights = np.array([mix.weights[i % len(mix.weights)] for i in range(len(named))])
    wanted = targets(words, weights, mix.share * words.sum(), mix.most_repeats)
    blocks = np.clip(-(-n // BLOCK_DOCUMENTS), 1, MAX_BLOCKS)
    sources = spark.createDataFrame(
        [(i, s, int(words[i]), float(wanted[i]), int(blocks[i])) for i, s in enumerate(named)],
        "sid int, name string, source_size long, target double, blocks int",
    )

    def placed(df: DataFrame) -> DataFrame:
        """Source number and block: the hash cuts the source into equal ranges."""
        found = df.join(sources, F.expr("_source <=> name"))
        return found.withColumn("block", F.expr("cast(shiftrightunsigned(u, 34) * blocks / 1073741824L as int)"))

    totals = stored(placed(lean).groupBy("sid", "block", "source_size", "target").agg(F.sum("size").alias("words")), "blocks")
    # positions of a source's block sequence: whole passes, then whole blocks, then part of one
    walk = Window.partitionBy("sid").orderBy("block")
    totals = totals.withColumn("before", F.sum("words").over(walk) - F.col("words")).withColumn("rank", F.row_number().over(walk) - 1)
    totals = totals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    totals = totals.withColumn("want", F.col("target") - F.col("passes") * F.col("source_size") - F.col("before"))
    totals = totals.withColumn("part", F.expr("want > 0.5 and want < words")).withColumn("whole", F.expr("want > 0.5 and want >= words"))
    totals = stored(totals, "block-plan")
    counted = totals.groupBy("sid").agg(F.count("*").alias("blocks"), F.max("passes").alias("passes"), F.sum(F.expr("int(part or whole)")).alias("more")).toPandas()
    quotas, lengths = np.zeros(len(named), np.int64), np.ones(len(named), np.int64)
    for row in counted.itertuples():
        quotas[row.sid], lengths[row.sid] = row.passes * row.blocks + row.more, row.blocks
    shards = max(1, int(-(-wanted.sum() // mix.shard_words)))
    seed = mix.seed

    def leaves(batches):
        for batch in batches:
            out = []
            for shard in batch["id"]:
                first, count = leaf_ranges(quotas, shards, int(shard), seed)
                for sid in np.flatnonzero(count):
                    position = np.arange(first[sid], first[sid] + count[sid])
                    out.append(pd.DataFrame({"sid": np.int32(sid), "rank": position % lengths[sid], "turn": position // lengths[sid], "shard": int(shard)}))
            yield pd.concat(out) if out else pd.DataFrame({"sid": [], "rank": [], "turn": [], "shard": []})

    draws = spark.range(0, shards, 1, min(shards, 64)).mapInPandas(leaves, "sid int, rank long, turn long, shard long")
    shard_lists = draws.groupBy("sid", "rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"]).alias("shards"))
    block_plan = totals.join(shard_lists, ["sid", "rank"], "left").select("sid", "block", "want", "part", "passes", "shards")
    parts = placed(lean).select("sid", "block", "size", "u").join(totals.filter("part").select("sid", "block", "want"), ["sid", "block"])
    picks = parts.groupBy("sid").applyInPandas(_fill, "sid int, u long, takes long")
    rows = placed(plain).join(block_plan, ["sid", "block"]).join(picks, ["sid", "u"], "left")
    same = Window.partitionBy("sid", "u").orderBy("size")
    rows = rows.withColumn("copies", F.size(F.coalesce("shards", F.array().cast("array<long>"))).cast("long"))
    left_out = F.col("part") & (F.row_number().over(same) > F.coalesce("takes", F.lit(0)))
    rows = rows.withColumn("copies", F.col("copies") - F.when(F.col("size") == 0, F.col("copies")).when(left_out, 1).otherwise(0))
    rows = rows.select(
        "row.*",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.slice(F.coalesce("shards", F.array().cast("array<long>")), F.lit(1), F.col("copies").cast("int")).alias("shards"),
        F.col("u").alias("_u"),
    )
    return Plan(rows, shards)


def mixed_rows(plan: Plan, seed: int = 17) -> DataFrame:
    """The mix itself: one row per copy with its shard, in shuffled order inside each shard.

    The order is a hash of shard, copy and document.  A shard is cut into ``SLICES``
    ranges of it, so that no task sorts a whole shard; each range is in order.
    """
    copies = plan.rows.select("*", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed), "shard", "copy", "_u")
    placed = copies.withColumn("_order", order).withColumn("_slice", F.shiftrightunsigned("_order", 64 - SLICES.bit_length() + 1))
    ordered = placed.repartition(plan.shards * SLICES, "shard", "_slice").sortWithinPartitions("shard", "_slice", "_order")
    return ordered.drop("_order", "_slice", "_u", "shards")

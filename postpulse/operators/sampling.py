"""Exact, repeatable sampling, splitting and fold assignment.

Rows are ordered by ``md5(seed | key)``.  A sample is then every row up to a
threshold hash, and folds are ranges between thresholds, so the wide data is
only filtered: no shuffle, no sort, no task that holds a whole class.  The
thresholds come from a few scans of the key columns that count rows per hash
prefix; whatever reaches the driver is bounded by constants below.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_STEP = 3  # hex digits settled per scan: 4096 counts per group and open prefix
SMALL_PREFIX = 64  # a prefix with no more rows than this is settled by reading its hashes
MAX_OPEN_PREFIXES = 512
HASH_DIGITS = 32
MAX_GROUPS = 100


def row_hash(key: Sequence[str], seed: int | str = 0) -> Column:
    """32 hex digits that order rows at random but repeatably."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary"))


def group_counts(df: DataFrame, group: str) -> dict:
    """Rows per group, for a column known to hold few values (classes)."""
    rows = df.groupBy(group).count().limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"{group} holds more than {MAX_GROUPS} values: not a class column")
    return {row[group]: row["count"] for row in rows}


def rank_thresholds(
    df: DataFrame,
    ranks: Mapping,
    key: Sequence[str],
    seed: int | str = 0,
    group: str | None = None,
) -> dict:
    """The hash at each wanted 1-based rank within its group.

    ``ranks`` maps a group value (``None`` without ``group``) to ranks; the
    result maps (group value, rank) to the hash.  Keys must be unique.
    """
    label = F.col(group) if group else F.lit(None).cast("string")
    rows = df.select(label.alias("g"), row_hash(key, seed).alias("h"))
    # open: (group, prefix) -> list of (wanted rank, rank counted from the prefix's first row)
    open_prefixes = {(g, ""): [(r, r) for r in wanted] for g, wanted in ranks.items() if wanted}
    found: dict = {}
    digits = 0
    while open_prefixes:
        if len(open_prefixes) > MAX_OPEN_PREFIXES:
            raise ValueError(f"more than {MAX_OPEN_PREFIXES} thresholds asked for at once")
        if digits >= HASH_DIGITS:
            raise ValueError(f"the key {list(key)} is not unique: equal keys straddle a wanted rank")
        before, digits = digits, min(digits + PREFIX_STEP, HASH_DIGITS)
        counts = (
            _within(rows, open_prefixes, before)
            .groupBy("g", F.substring("h", 1, digits).alias("p"))
            .agg(F.count("*").alias("n"))
            .collect()
        )
        open_prefixes = _descend(open_prefixes, counts, before)
        small = {k: v for k, v in open_prefixes.items() if v[0] <= SMALL_PREFIX}
        if small:
            hashes = _within(rows, {k: None for k in small}, digits).orderBy("g", "h").collect()
            for (g, p), (_, wanted) in small.items():
                ordered = [row["h"] for row in hashes if row["g"] == g and row["h"].startswith(p)]
                for rank, inside in wanted:
                    if ordered.count(ordered[inside - 1]) > 1:
                        raise ValueError(f"the key {list(key)} is not unique")
                    found[(g, rank)] = ordered[inside - 1]
        open_prefixes = {k: v[1] for k, v in open_prefixes.items() if k not in small}
    return found


def _within(rows: DataFrame, prefixes, digits: int) -> DataFrame:
    """Rows whose group and hash prefix are still open."""
    by_group: dict = {}
    for g, p in prefixes:
        by_group.setdefault(g, []).append(p)
    keep = F.lit(False)
    for g, wanted in by_group.items():
        same = F.col("g").eqNullSafe(F.lit(g))
        keep = keep | ((same & F.substring("h", 1, digits).isin(*wanted)) if digits else same)
    return rows.filter(keep)


def _descend(open_prefixes: dict, counts, digits: int) -> dict:
    """For each open prefix, the longer prefixes that hold its wanted ranks."""
    children: dict = {}
    for row in counts:
        children.setdefault((row["g"], row["p"][:digits]), []).append((row["p"], row["n"]))
    result: dict = {}
    for (g, prefix), wanted in open_prefixes.items():
        ordered = sorted(children.get((g, prefix), []))
        total = sum(n for _, n in ordered)
        for rank, inside in wanted:
            if not 1 <= inside <= total:
                raise ValueError(f"rank {rank} asked for, but group {g!r} has {total} rows")
            for child, n in ordered:
                if inside <= n:
                    result.setdefault((g, child), (n, []))[1].append((rank, inside))
                    break
                inside -= n
    return result


def sample_exact(
    df: DataFrame,
    n: int,
    key: Sequence[str] = ("subreddit", "ID"),
    seed: int | str = 0,
    cap: bool = False,
) -> DataFrame:
    """Exactly ``n`` rows without replacement: those with the lowest hashes.

    Raises when there are fewer than ``n`` rows unless ``cap`` is set.
    """
    if n <= 0:
        return df.filter(F.lit(False))
    if cap:
        available = df.count()
        if available <= n:
            return df
    threshold = rank_thresholds(df, {None: [n]}, key, seed)[(None, n)]
    return df.filter(row_hash(key, seed) <= threshold)


def undersample(
    posts: DataFrame,
    majority: str = "neutral",
    reference: str = "positive",
    kept: Sequence[str] = ("positive", "negative"),
    key: Sequence[str] = ("subreddit", "ID"),
    seed: int | str = 0,
    cap: bool = False,
    balanced: bool = True,
) -> DataFrame:
    """Cut ``majority`` to the size of ``reference``; with ``balanced`` also keep the ``kept`` classes.

    The result is one filter over ``posts``.
    """
    counts = group_counts(posts.filter(F.col("sentiment").isin(majority, reference)), "sentiment")
    n, available = counts.get(reference, 0), counts.get(majority, 0)
    if n > available:
        if not cap:
            raise ValueError(f"cannot draw {n} rows from {available} {majority} rows")
        n = available
    is_majority = F.col("sentiment") == majority
    if n == 0:
        drawn = F.lit(False)
    else:
        pool = posts.filter(is_majority)
        threshold = rank_thresholds(pool, {None: [n]}, key, seed)[(None, n)]
        drawn = is_majority & (row_hash(key, seed) <= threshold)
    return posts.filter(drawn | F.col("sentiment").isin(*kept)) if balanced else posts.filter(drawn)


def split_exact(
    df: DataFrame,
    fraction: float = 0.2,
    key: Sequence[str] = ("subreddit", "ID"),
    seed: int | str = 0,
) -> tuple[DataFrame, DataFrame]:
    """(training, validation) with exactly ceil(``fraction`` * rows) validation rows."""
    n = math.ceil(fraction * df.count() - 1e-9)
    if n == 0:
        return df, df.filter(F.lit(False))
    threshold = rank_thresholds(df, {None: [n]}, key, seed)[(None, n)]
    held_out = row_hash(key, seed) <= threshold
    return df.filter(~held_out), df.filter(held_out)


def split_by_hash(
    df: DataFrame,
    fraction: float = 0.2,
    key: Sequence[str] = ("subreddit", "ID"),
    seed: int | str = 0,
) -> tuple[DataFrame, DataFrame]:
    """(training, validation) of about ``fraction``, without looking at the data first.

    A row's side depends on its key alone, so it never changes as data grows.
    """
    limit = f"{int(fraction * 16**8):08x}"
    held_out = F.substring(row_hash(key, seed), 1, 8) < limit
    return df.filter(~held_out), df.filter(held_out)


def stratified_folds(
    df: DataFrame,
    folds: int = 5,
    label: str = "sentiment",
    key: Sequence[str] = ("subreddit", "ID"),
    seed: int | str = 0,
) -> DataFrame:
    """Add ``fold`` (0..folds-1); within each class fold sizes differ by one at most."""
    ranks, bounds = {}, {}
    for value, n in group_counts(df, label).items():
        base, extra = divmod(n, folds)
        ends, end = [], 0
        for i in range(folds - 1):
            end += base + (1 if i < extra else 0)
            ends.append(end)
        ranks[value] = sorted({e for e in ends if 0 < e})
        bounds[value] = ends
    thresholds = rank_thresholds(df, ranks, key, seed, group=label)
    hashed = row_hash(key, seed)
    fold = F.when(F.lit(False), F.lit(0))
    for value, ends in bounds.items():
        above = sum(
            ((hashed > thresholds[(value, e)]).cast("int") for e in ends if e > 0),
            F.lit(sum(1 for e in ends if e == 0)),
        )
        fold = fold.when(F.col(label).eqNullSafe(F.lit(value)), above)
    return df.withColumn("fold", fold)


def class_weights(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """Balanced weights ``n / (classes * n_class)`` as ``label, n, weight`` rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    rows, classes = totals.select("rows").scalar(), totals.select("classes").scalar()
    return counts.withColumn("weight", rows / (classes * F.col("n")))


def add_class_weight(df: DataFrame, label: str = "sentiment", column: str = "weight") -> DataFrame:
    """Attach each row's balanced class weight as a literal chosen by class."""
    counts = group_counts(df, label)
    rows = sum(counts.values())
    weight = F.when(F.lit(False), F.lit(0.0))
    for value, n in counts.items():
        weight = weight.when(F.col(label).eqNullSafe(F.lit(value)), rows / (len(counts) * n))
    return df.withColumn(column, weight)


def class_counts(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """``label, n``."""
    return df.groupBy(label).agg(F.count("*").alias("n"))

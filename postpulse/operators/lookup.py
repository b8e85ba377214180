"""Joining many rows with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Term tables up to this many rows (tens of MB) are broadcast.
MAX_BROADCAST_TERMS = 500_000


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: str,
    how: str = "inner",
    table_rows: int | None = None,
    max_broadcast: int = MAX_BROADCAST_TERMS,
    rarity: str | None = None,
    far_by: Sequence[str] = (),
) -> DataFrame:
    """Join ``facts`` with ``table`` on one key.

    The table is broadcast when its row count is known and small.  Beyond that,
    ``rarity`` names a column of the table that is lower the more often a key
    occurs: the most frequent keys, about ``max_broadcast`` of them, are still
    broadcast, so only facts with other keys are shuffled; ``facts`` is read
    twice.  Without it both sides are shuffled, and adaptive execution splits the
    partitions of frequent keys (the table's single row is then read by each split).
    Facts already partitioned by ``far_by`` stay so: only those shuffled for the
    join are partitioned by it again.
    """
    if table_rows is not None and table_rows <= max_broadcast:
        return facts.join(F.broadcast(table), on, how)
    if rarity is None or table_rows is None or how not in ("inner", "left"):
        return facts.join(table.hint("merge"), on, how)
    share = max_broadcast / table_rows
    bound = table.agg(F.percentile_approx(rarity, share, 100_000)).first()[0]
    # strictly below: many keys may share the bound itself
    frequent = F.col(rarity) < bound
    common, rest = table.filter(frequent), table.filter(~frequent)
    near = facts.join(F.broadcast(common), on)
    far = facts.join(F.broadcast(common.select(on)), on, "left_anti").join(rest.hint("merge"), on, how)
    if far_by:
        far = far.repartition(*far_by)
    return near.unionByName(far)

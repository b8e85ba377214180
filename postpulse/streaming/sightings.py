"""The best sighting of every post over a stream of listings, whatever batch it comes in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from postpulse.operators.ingest import dedupe_first_seen, listing_rank
from postpulse.sources.folders import exists
from postpulse.sources.schemas import LISTING_SCHEMA

SIGHTING_SCHEMA = T.StructType([*LISTING_SCHEMA.fields, T.StructField("listing_rank", T.IntegerType())])
STATE_SCHEMA = T.StructType([*[SIGHTING_SCHEMA[c] for c in ("listing_rank", "position", "created_utc")], T.StructField("digest", T.StringType())])
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
_LAST = float("inf")


def _standing(row: Any) -> tuple:
    """What decides between sightings but for their texts, in the order of the batch rule: absent values come first."""
    created = row["created_utc"]
    newest = _LAST if created is None else -_LAST if created != created else -created
    return (row["listing_rank"], (row["position"] is not None, row["position"] or 0), newest)


def _texts(row: Any) -> tuple:
    """What decides between sightings of the same standing."""
    return tuple((row[c] is not None, row[c] or "") for c in ("title", "selftext", "listing", "time_filter"))


def _digest(row: Any) -> str:
    """Of the texts, their lengths first."""
    texts = [row[c] for c in ("title", "selftext", "listing", "time_filter")]
    whole = "".join([str([None if t is None else len(t) for t in texts]), *[t or "" for t in texts]])
    return hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class BestSighting(StatefulProcessor):
    """State of one (source, id): standing and digest of the best sighting so far, not its texts.

    A row goes out whenever it improves.  One of the same standing and other texts
    goes out too: :func:`read_sightings` has the texts that decide between them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("standing", STATE_SCHEMA)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        best, place = None, None
        for row in rows:
            mine = _standing(row)
            if best is None or mine < place or (mine == place and _texts(row) < _texts(best)):
                best, place = row, mine
        known = self.best.get()  # None if there is none: one call to the state store, not two
        if known is not None:
            before = dict(zip(STATE_SCHEMA.fieldNames(), known, strict=True))
            if _standing(before) < place:
                return
        digest = _digest(best)
        if known is not None and _standing(before) == place and before["digest"] == digest:
            return
        self.best.update((best["listing_rank"], best["position"], best["created_utc"], digest))
        yield Row(**{name: best[name] for name in SIGHTING_SCHEMA.fieldNames()})

    def close(self) -> None:
        pass


def _unbeaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that no row of the same post in their batch is better than, texts left aside: what need not be shuffled goes first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        post = batch.select(["subreddit", "id"]).to_pandas().groupby(["subreddit", "id"], dropna=False).ngroup().to_numpy()
        position, created = batch.column("position"), batch.column("created_utc").to_numpy(zero_copy_only=False).astype(float)
        absent = batch.column("created_utc").is_null().to_numpy(zero_copy_only=False)
        newest = np.where(absent, _LAST, np.where(np.isnan(created), -_LAST, -created))
        standing = [batch.column("listing_rank").to_numpy(zero_copy_only=False), position.is_valid().to_numpy(zero_copy_only=False), position.fill_null(0).to_numpy(), newest]
        order = np.lexsort((*reversed(standing), post))
        first = order[np.r_[True, post[order][1:] != post[order][:-1]]][post]  # posts are numbered in their order
        yield batch.filter(pa.array(np.logical_and.reduce([v == v[first] for v in standing])))


def best_sightings(listings: DataFrame) -> DataFrame:
    """Listing rows with ``listing_rank``: the first best sighting of each (source, id), and every better one after it.

    Needs the state store of :data:`STATE_STORE`.  The state holds one short row per
    post and outlives restarts with the checkpoint.
    """
    ranked = listings.withColumn("listing_rank", listing_rank().cast("int")).select(*SIGHTING_SCHEMA.fieldNames())
    grouped = ranked.mapInArrow(_unbeaten, SIGHTING_SCHEMA).groupBy("subreddit", "id")
    return grouped.transformWithState(BestSighting(), SIGHTING_SCHEMA, "Update", "None")


def store_sightings(listings: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep every improvement below ``path``, a folder per batch; by default drain the feed and stop."""
    spark = listings.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")

    writer = (
        best_sightings(listings)
        .writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    # a query takes the settings that hold when it starts
    setting, store = STATE_STORE
    before = spark.conf.get(setting)
    spark.conf.set(setting, store)
    try:
        return writer.start()
    finally:
        spark.conf.set(setting, before)


def read_sightings(spark: SparkSession, path: str) -> DataFrame:
    """The best stored sighting of every post; the batch it came in does not matter."""
    if not exists(spark, path):
        return spark.createDataFrame([], SIGHTING_SCHEMA)
    rows = spark.read.schema(SIGHTING_SCHEMA).parquet(path)
    return dedupe_first_seen(rows.select(*LISTING_SCHEMA.fieldNames())).select(*LISTING_SCHEMA.fieldNames(), F.col("listing_rank").cast("int"))

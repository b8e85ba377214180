"""The best sighting across batches and restarts."""

from conftest import values
from postpulse.operators.ingest import dedupe_first_seen
from postpulse.sources import LISTING_SCHEMA, write_listings
from postpulse.streaming.ingest import read_listing_stream
from postpulse.streaming.sightings import read_sightings, store_sightings


def test_a_later_batch_with_a_better_listing_wins(spark, frame, tmp_path):
    landed, sink, checkpoint = (str(tmp_path / n) for n in ("landed", "out", "ckpt"))
    batches = [
        [("a", "new", None, 3, "x", "t new", "b", 17.0), ("a", "new", None, 1, "y", "t", "b", 17.0), (None, "hot", None, None, None, "no key", None, None)],
        [("a", "top", "all", 7, "x", "t top", "b", 17.0), ("a", "hot", None, 0, "x", "t hot", "b", 17.0), ("b", "new", None, 0, "x", "other", "b", 1.0)],
        [("a", "rising", None, 0, "x", "worse", "b", 17.0), ("a", "new", None, 1, "y", "newer", "b", 18.0), (None, "new", None, None, None, "later", None, None)],
    ]
    seen = []
    for rows in batches:
        write_listings(frame(rows, LISTING_SCHEMA).coalesce(1), landed)
        # every round is a restart from the checkpoint
        store_sightings(read_listing_stream(spark, landed), sink, checkpoint).awaitTermination()
        seen += rows
        expected = dedupe_first_seen(frame(seen, LISTING_SCHEMA)).select("subreddit", "id", "title")
        assert sorted(values(read_sightings(spark, sink).select("subreddit", "id", "title")), key=str) == sorted(values(expected), key=str)
    titles = set(values(read_sightings(spark, sink), "title"))
    assert titles == {"t top", "newer", "no key", "other"}
    written = spark.read.parquet(sink).filter("title = 'worse'")
    assert written.count() == 0


def test_state_holds_no_texts_and_ties_are_decided_by_the_reader(spark, frame, tmp_path):
    landed, sink, checkpoint = (str(tmp_path / n) for n in ("landed", "out", "ckpt"))
    long = "".join(chr(97 + i * i % 26) for i in range(50)) * 100
    batches = [
        [("a", "new", None, 1, "x", "m", long, 17.0), ("a", "new", None, 1, "y", "m", None, None), ("a", "hot", None, None, "z", "t", "b", float("nan")), ("a", "hot", None, 2, "z", "t", "b", 1.0)],
        [("a", "new", None, 1, "x", "b", long, 17.0), ("a", "new", None, 1, "y", "z", None, None), ("a", "hot", None, None, "z", "s", "b", 5.0)],
        [("a", "new", None, 1, "x", "b", long, 17.0), ("a", "new", None, 1, "x", "b", long, 16.0), ("a", "new", None, 1, "y", None, "n", None)],
    ]
    seen = []
    for rows in batches:
        write_listings(frame(rows, LISTING_SCHEMA).coalesce(1), landed, "parquet")
        store_sightings(read_listing_stream(spark, landed, "parquet"), sink, checkpoint).awaitTermination()
        seen += rows
        expected = dedupe_first_seen(frame(seen, LISTING_SCHEMA)).select("subreddit", "id", "title")
        assert sorted(values(read_sightings(spark, sink).select("subreddit", "id", "title")), key=str) == sorted(values(expected), key=str)
    assert spark.read.parquet(sink).filter("id = 'x'").count() == 2  # seen again, not stored again
    state = spark.read.format("statestore").option("stateVarName", "standing").load(checkpoint)
    assert state.count() == 3 and "selftext" not in state.select("value.*").columns


def test_beaten_rows_are_not_shuffled(frame):
    import pyarrow as pa

    from postpulse.streaming import sightings

    rows = [("a", "top", "all", 3, "x", "t", "b", 1.0, 0), ("a", "hot", None, 0, "x", "t", "b", 1.0, 6), ("a", "top", "all", 3, "x", "s", "b", 1.0, 0), (None, "new", None, None, None, "k", None, None, 8), ("a", "top", "all", 3, "x", "o", "b", 0.5, 0), ("a", "top", "all", 3, "y", "t", "b", 1.0, 0), (None, "new", None, 0, None, "p", None, None, 8)]
    batch = pa.RecordBatch.from_pylist([dict(zip(sightings.SIGHTING_SCHEMA.fieldNames(), r)) for r in rows], pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in sightings.SIGHTING_SCHEMA]))
    kept = pa.Table.from_batches(sightings._unbeaten(iter([batch]))).column("title").to_pylist()
    assert kept == ["t", "s", "k", "t"]

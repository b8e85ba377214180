import datetime

from conftest import values
from pyspark.sql import functions as F

from postpulse.operators.ingest import dedupe_first_seen, limit_per_listing, new_posts, to_posts, union_listings
from postpulse.plans import collect
from postpulse.sources import LISTING_SCHEMA, read_stored, write_listings
from postpulse.streaming import compact_daily_counts, read_daily_counts, store_daily_counts, stream_daily_counts, stream_ingest
from postpulse.streaming.ingest import read_listing_stream

ROWS = [
    ("a", "new", None, 3, "x", "t new", "b", 1700000000.0),
    ("a", "hot", None, 0, "x", "t hot", "b", 1700000000.0),
    ("a", "top", "all", 7, "x", "t top", "b", 1700000000.9),
    ("b", "new", None, 1, "x", "other source", "", 1700000000.0),
    ("a", "rising", None, 2, "y", "t", None, 1700000000.0),
]


def test_first_sighting_wins(frame):
    kept = dedupe_first_seen(frame(ROWS, LISTING_SCHEMA))
    assert sorted(values(kept.select("subreddit", "id", "title"))) == [
        ("a", "x", "t top"),
        ("a", "y", "t"),
        ("b", "x", "other source"),
    ]
    again = dedupe_first_seen(kept.select(*LISTING_SCHEMA.fieldNames()).repartition(7))
    assert sorted(values(again)) == sorted(values(kept))


def test_posts_from_listings(frame):
    items = frame(ROWS, LISTING_SCHEMA)
    bodies = dict(values(to_posts(items).select("title", "content")))
    assert bodies["other source"] is None and bodies["t"] is None and bodies["t top"] == "b"
    exported = {r["title"]: r for r in to_posts(items, keep_missing=False).collect()}
    assert exported["t"]["content"] == "N/A"
    assert exported["t top"]["date"] == "2023-11-14 22:13:20"


def test_limit_keeps_lowest_positions_of_a_hot_listing(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot source").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("subreddit"),
        F.lit("new").alias("listing"),
        F.lit(None).cast("string").alias("time_filter"),
        (5000 - F.col("id")).alias("position"),
        F.col("id").cast("string").alias("id"),
    )
    kept = limit_per_listing(rows, 10)
    expected = {}
    for r in rows.collect():
        expected.setdefault(r["subreddit"], []).append(r["position"])
    got = {}
    for r in kept.collect():
        got.setdefault(r["subreddit"], []).append(r["position"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:10] for k, v in expected.items()}
    assert limit_per_listing(rows, None).count() == 5000


def test_union_matches_by_name(frame):
    left, right = frame([("1", "a")], "id string, title string"), frame([("b", "2")], "title string, id string")
    assert sorted(values(union_listings(left, right))) == [("1", "a"), ("2", "b")]


def test_anti_join_is_per_source(frame):
    schema = "subreddit string, ID string"
    posts, stored = frame([("a", "1"), ("b", "1"), ("a", "2")], schema), frame([("a", "1")], schema)
    assert sorted(values(new_posts(posts, stored))) == [("a", "2"), ("b", "1")]


def test_collect_twice_adds_nothing(spark, frame, tmp_path):
    landed, table = str(tmp_path / "landed"), str(tmp_path / "posts")
    write_listings(frame(ROWS, LISTING_SCHEMA), landed)
    for _ in range(2):
        collect(spark, landed, table)
        assert read_stored(spark, table).count() == 3


def test_stream_ingest_equals_batch(spark, frame, tmp_path):
    landed, table = str(tmp_path / "landed"), str(tmp_path / "posts")
    write_listings(frame(ROWS, LISTING_SCHEMA).coalesce(1), landed)
    run = lambda: stream_ingest(read_listing_stream(spark, landed), table, str(tmp_path / "ckpt")).awaitTermination()
    run()
    write_listings(frame([*ROWS, ("a", "new", None, 0, "z", "late", "b", 1700000001.0)], LISTING_SCHEMA), landed)
    run()
    got = sorted(values(read_stored(spark, table).select("subreddit", "ID", "title")))
    assert got == [("a", "x", "t top"), ("a", "y", "t"), ("a", "z", "late"), ("b", "x", "other source")]


def test_stream_ingest_keeps_old_posts(spark, frame, tmp_path):
    """A listing of all time brings posts that are years older than those stored before."""
    landed, table = str(tmp_path / "landed"), str(tmp_path / "posts")
    for created, post in ((1700000000.0, "young"), (1200000000.0, "old")):
        write_listings(frame([("a", "new", None, 0, post, "t", "b", created)], LISTING_SCHEMA), landed)
        stream_ingest(read_listing_stream(spark, landed), table, str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(values(read_stored(spark, table).select("ID"))) == [("old",), ("young",)]


def test_posts_without_id_are_stored_once(frame):
    schema = "subreddit string, ID string"
    stored = frame([(None, "1"), ("a", None)], schema)
    assert values(new_posts(frame([(None, "1"), ("a", None), ("a", "1")], schema), stored)) == [("a", "1")]


DAY = lambda d, h=0: datetime.datetime(2024, 1, d, h)


def test_stream_counts_emit_closed_days(spark, frame, tmp_path):
    rows = [(DAY(1, 5), -1), (DAY(1, 6), 1), (DAY(2), 0), (DAY(9), 1)]
    frame(rows, "date timestamp, label int").write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("date timestamp, label int").parquet(str(tmp_path / "in"))
    query = (
        stream_daily_counts(feed, watermark="2 days")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.read.schema("day date, neg bigint, neu bigint, pos bigint").parquet(str(tmp_path / "out"))
    assert sorted(values(got)) == [(DAY(1).date(), 1, 0, 1), (DAY(2).date(), 0, 1, 0)]


def test_stored_counts_take_late_rows(spark, frame, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for rows in ([(DAY(1, 5), -1), (DAY(9), 1)], [(DAY(1, 6), 1)]):
        frame(rows, "date timestamp, label int").write.mode("append").parquet(source)
        feed = spark.readStream.schema("date timestamp, label int").parquet(source)
        store_daily_counts(feed, sink, checkpoint).awaitTermination()
    assert sorted(values(read_daily_counts(spark, sink))) == [(DAY(1).date(), 1, 0, 1), (DAY(9).date(), 0, 0, 1)]


def test_compacted_counts_equal_the_batches(spark, frame, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    assert compact_daily_counts(spark, sink) == -1 and values(read_daily_counts(spark, sink)) == []

    def add(rows, source=source, checkpoint=checkpoint):
        frame(rows, "date timestamp, label int").coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema("date timestamp, label int").parquet(source)
        store_daily_counts(feed, sink, checkpoint).awaitTermination()
        return sorted(values(read_daily_counts(spark, sink)))

    add([(DAY(1), -1), (DAY(9), 1)])
    before = add([(DAY(1), 1), (DAY(3), 0)])
    first = compact_daily_counts(spark, sink)
    assert first >= 0 and sorted(values(read_daily_counts(spark, sink))) == before
    after = add([(DAY(3), 0), (DAY(4), 1)])
    assert after == [(DAY(1).date(), 1, 0, 1), (DAY(3).date(), 0, 2, 0), (DAY(4).date(), 0, 0, 1), (DAY(9).date(), 0, 0, 1)]
    assert any(f"upto={first}" in file for file in read_daily_counts(spark, sink).inputFiles())
    assert compact_daily_counts(spark, sink) > first and sorted(values(read_daily_counts(spark, sink))) == after
    # a new checkpoint counts another feed from the start; nothing of the old one is served
    assert add([(DAY(1), 0)], str(tmp_path / "other"), str(tmp_path / "renewed")) == [(DAY(1).date(), 0, 1, 0)]

"""CSV read by splits, against Spark's own reader in one task; row numbers."""

import csv
import random
from contextlib import contextmanager

import pytest

from conftest import values
from postpulse.operators.numbering import number_rows
from postpulse.sources import export_csv, read_posts, read_source_files
from postpulse.sources.posts import _CSV_OPTIONS
from postpulse.sources.records import read_records, scan_csv, split_states, _lines
from postpulse.sources.schemas import POST_FILE_SCHEMA

SCHEMA = "ID string, title string, content string, date string"


@contextmanager
def split_size(spark, size):
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def whole(spark, path):
    return spark.read.schema(POST_FILE_SCHEMA).options(**_CSV_OPTIONS).csv(path)


def body(rnd):
    parts = ['"', "\n", "\r\n", ",", '""', " ", "word", "x" * 30, "\n\n", "é🙂", "'", "ID,title,content,date"]
    return "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25)))


def write(path, rows, end="\n", header=("ID", "title", "content", "date")):
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, lineterminator=end).writerows([header, *rows])


@pytest.mark.parametrize("size, count, end", [(11, 4, "\n"), (11, 4, "\r\n"), (150, 30, "\n"), (2000, 150, "\r\n"), (1 << 20, 150, "\n")])
def test_splits_give_what_one_task_gives(spark, tmp_path, size, count, end):
    rnd = random.Random(size)
    for name in ("a", "b"):
        write(tmp_path / f"{name}.csv", [(f"{name}{i}", body(rnd), body(rnd), f"2020-01-{i % 28 + 1:02d}") for i in range(count)], end)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("ID,title,content,date")
    expected = sorted(values(whole(spark, str(tmp_path))))
    with split_size(spark, size):
        found = scan_csv(spark, str(tmp_path), POST_FILE_SCHEMA, _CSV_OPTIONS)
        got = sorted(values(found))
        if size < 1 << 20:
            states = values(split_states(_lines(spark, str(tmp_path), {})))
            assert len(states) > 10 and {inside for _, _, inside in states} == {True, False}
    assert got == expected and len(got) == 2 * count


def test_one_record_over_many_splits(spark, tmp_path):
    rows = [("1", "t", "\n".join(f'line {i} "q"' for i in range(60)), "d"), ("2", "", "", ""), ("3", "a", "b", "c")]
    write(tmp_path / "long.csv", rows, header=("ID", "ti\ntle" * 20, "content", "date"))
    with split_size(spark, 50):
        assert sorted(values(scan_csv(spark, str(tmp_path / "long.csv"), POST_FILE_SCHEMA, _CSV_OPTIONS))) == sorted(values(whole(spark, str(tmp_path / "long.csv"))))


def test_odd_files(spark, tmp_path):
    """Empty lines, short and long rows, no last line end, quotes inside a plain field, an open quote."""
    text = '\n\nID,title,content,date\n\n1,a\n2,a,b,c,d,e\n\n,,,\n" "\n3,x"y"z,b,c\n4,"never closed\n5,a,b,c'
    (tmp_path / "odd.csv").write_text(text)
    expected = sorted(values(whole(spark, str(tmp_path / "odd.csv"))), key=str)
    for size in (6, 1 << 20):
        with split_size(spark, size):
            got = sorted(values(scan_csv(spark, str(tmp_path / "odd.csv"), POST_FILE_SCHEMA, _CSV_OPTIONS)), key=str)
        assert got == expected


def test_lines_of_one_file_reach_many_tasks(spark, tmp_path):
    rnd = random.Random(1)
    write(tmp_path / "p.csv", [(str(i), "t", body(rnd), "d") for i in range(500)])
    with split_size(spark, 2000):
        records = read_records(spark, str(tmp_path / "p.csv"))
        assert records.rdd.getNumPartitions() > 8 and records.count() == 500


def test_posts_and_sources_are_read_by_splits(spark, frame, tmp_path):
    rnd = random.Random(2)
    rows = [(f"{i:03}", body(rnd) + "t", body(rnd) + "b", "2020-01-01 00:00:00") for i in range(120)]
    export_csv(frame(rows, SCHEMA), str(tmp_path / "webdev-posts.csv"))
    with split_size(spark, 300):
        assert sorted(values(read_posts(spark, str(tmp_path / "webdev-posts.csv")))) == rows
        found = read_source_files(spark, str(tmp_path), ["webdev", "absent"])
        assert sorted(values(found)) == [("webdev", *r) for r in rows]


@pytest.mark.parametrize("rows", [0, 1, 5000])
def test_row_numbers(spark, rows):
    df = spark.range(rows).selectExpr("id", "id % 7 as g").repartition(6)
    got = number_rows(df, "g", "id", name="place", first=1)
    assert got.columns == ["id", "g", "place"]
    expected = sorted((i % 7, i) for i in range(rows))
    assert [(g, i) for i, g, _ in sorted(values(got), key=lambda r: r[2])] == expected
    assert sorted(values(got, "place")) == list(range(1, rows + 1))

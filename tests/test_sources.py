import os

from conftest import values
from postpulse.operators.clean import clean_posts, drop_missing
from postpulse.sources import NA_STRINGS, export_csv, parse_dates, read_posts, read_source_files, source_catalog

SCHEMA = "ID string, title string, content string, date string"


def test_round_trip_keeps_awkward_text(spark, frame, tmp_path):
    rows = [
        ("1", 'say "hi", ok', "a\r\nb\nc", "2020-01-01 00:00:00"),
        ("2", "slash", "ends in \\", "2020-01-02 00:00:00"),
        ("3", "  padded ", " body ", "2020-01-03 00:00:00"),
        ("4", "comma, and 'quote'", '"', "2020-01-04 00:00:00"),
    ]
    export_csv(frame(rows, SCHEMA), str(tmp_path / "out"))
    assert sorted(values(read_posts(spark, str(tmp_path / "out")))) == sorted(rows)


def test_both_line_ends(spark, tmp_path):
    for name, end in (("unix", "\n"), ("dos", "\r\n")):
        path = tmp_path / f"{name}.csv"
        text = end.join(["ID,title,content,date", '1,t,"x\r\ny",2020-01-01 00:00:00', "2,t,z,2020-01-02 00:00:00", ""])
        path.write_bytes(text.encode())
        got = sorted(values(read_posts(spark, str(path))))
        assert got == [("1", "t", "x\r\ny", "2020-01-01 00:00:00"), ("2", "t", "z", "2020-01-02 00:00:00")]


def test_na_texts_are_null_and_near_misses_are_not(spark, frame, tmp_path):
    kept = ["N/A ", "Null", "na", "-", "N/A\nmore"]
    rows = [(str(i), "t", text, "2020-01-01 00:00:00") for i, text in enumerate([*NA_STRINGS, *kept])]
    rows.append(("title", "null", "body", "2020-01-01 00:00:00"))
    export_csv(frame(rows, SCHEMA), str(tmp_path / "out"))
    left = values(drop_missing(read_posts(spark, str(tmp_path / "out"))), "content")
    assert sorted(left) == sorted(kept)


def test_absent_sources_are_skipped(spark, frame, tmp_path):
    row = [("007", "t", "b", "2020-01-01 00:00:00")]
    export_csv(frame(row, SCHEMA), str(tmp_path / "webdev-posts.csv"))
    plain = tmp_path / "compsci-posts.csv"
    plain.write_text("ID,title,content,date\r\n8,t,b,2020-01-01 00:00:00\r\n")
    found = read_source_files(spark, str(tmp_path), ["webdev", "compsci", "jobs"])
    assert sorted(values(found.select("subreddit", "ID"))) == [("compsci", "8"), ("webdev", "007")]
    os.makedirs(tmp_path / "empty")
    assert values(read_source_files(spark, str(tmp_path / "empty"), ["webdev"])) == []


def test_dates_that_do_not_parse_are_null(frame):
    rows = [("1", "t", "b", "2020-08-31 23:59:59"), ("2", "t", "b", "yesterday")]
    assert [d is None for d in values(parse_dates(frame(rows, SCHEMA)).orderBy("ID"), "date")] == [False, True]


def test_cut_comes_before_the_entity(frame):
    entity = "&#x200B;"
    rows = [
        ("1", "t", "x" * 1001),
        ("2", "t", "😀" * 1001),
        ("3", "t", "x" * 995 + entity + "tail"),
        ("4", "t", entity),
        ("5", entity, "a" + entity + "b&#x200b;" + entity),
        ("6", None, "b"),
    ]
    got = {r["ID"]: r for r in clean_posts(frame(rows, "ID string, title string, content string")).collect()}
    assert len(got["1"]["content"]) == 1000 and got["2"]["content"] == "😀" * 1000
    assert got["3"]["content"] == "x" * 995 + "&#x20"
    assert got["4"]["content"] == "" and got["5"]["content"] == "ab&#x200b;" and got["5"]["title"] == entity
    assert "6" not in got
    whole = clean_posts(frame(rows[:1], "ID string, title string, content string"), max_chars=None)
    assert len(values(whole, "content")[0]) == 1001


def test_catalog_roles(spark):
    roles = dict(values(source_catalog(spark).select("subreddit", "role")))
    assert len(roles) == 17 and roles["csMajors"] == "analysis"
    assert sum(r == "training" for r in roles.values()) == 7

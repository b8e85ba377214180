"""Labels that outlive a failure, and the labelled hand-off."""

import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pytest

from conftest import values
from postpulse.operators.labelling import keyword_scorer, label_by_bucket
from postpulse.sources import export_labelled, parse_dates, read_labelled

SCHEMA = "subreddit string, ID string, title string, content string, date string"


def failing(log, broken):
    """Notes every prompt; fails at the post ``broken`` while the log folder holds no ``mended``."""

    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            for prompt in prompts:
                if broken in prompt and not os.path.exists(f"{log}/mended"):
                    raise RuntimeError("the model is away")
                with open(f"{log}/asked", "a") as file:
                    file.write(prompt.split("post-")[1].split(" ")[0] + "\n")
            yield from keyword_scorer()(iter([prompts]))

    return answer


def test_a_restart_asks_for_missing_labels_only(frame, tmp_path):
    rows = [("s", f"{i}", f"post-{i} here", ["great", "bad", "plain"][i % 3], "2020-01-01 00:00:00") for i in range(60)]
    posts = frame(rows, SCHEMA).coalesce(2)
    scorer, path = failing(str(tmp_path), "post-41 "), str(tmp_path / "kept")
    with pytest.raises(Exception, match="the model is away"):
        label_by_bucket(posts, scorer, path, buckets=8)
    done = set(values(label_by_bucket(posts.filter("false"), scorer, path), "ID"))
    assert 0 < len(done) < 60 and "41" not in done
    (tmp_path / "mended").write_text("")
    labelled = label_by_bucket(posts, scorer, path, buckets=8)
    asked = Counter((tmp_path / "asked").read_text().split())
    assert set(asked) == {str(i) for i in range(60)} and all(asked[i] == 1 for i in done)
    assert sum(n - 1 for n in asked.values()) < 20  # the failed bucket's other posts
    assert sorted(values(labelled.select("ID", "sentiment"))) == sorted((str(i), ["positive", "negative", "neutral"][i % 3]) for i in range(60))
    again = label_by_bucket(posts, scorer, path, buckets=5)
    assert again.count() == 60 and Counter((tmp_path / "asked").read_text().split()) == asked


def test_posts_without_key_and_repeated_posts(frame, tmp_path):
    rows = [(None, "1", "t", "great", "d"), (None, "1", "t", "great", "d"), ("s", None, "t", None, "d")]
    posts = frame(rows, SCHEMA)
    for _ in range(2):
        assert label_by_bucket(posts, keyword_scorer(), str(tmp_path / "kept")).count() == 2


def test_labelled_files_come_back_with_nulls(spark, frame, tmp_path):
    rows = [("1", 'a "b"', "x\r\ny", "2020-01-01 10:00:00", "positive"), ("2", "NA", "", "2020-01-02 00:00:00", "neither"), ("3", None, "n/a", "never", "neutral")]
    export_labelled(frame(rows, "ID string, title string, content string, date string, sentiment string"), str(tmp_path / "out"))
    back = read_labelled(spark, str(tmp_path / "out"))
    got = sorted(values(back.selectExpr("ID", "title", "content", "cast(date as string)", "sentiment")))
    assert got == [("1", 'a "b"', "x\r\ny", "2020-01-01 10:00:00", "positive"), ("2", None, None, "2020-01-02 00:00:00", "neither"), ("3", None, None, None, "neutral")]
    assert parse_dates(back).count() == 3


def test_a_scorer_sees_few_prompts_at_once(monkeypatch):
    import pandas as pd

    from postpulse.operators import labelling

    monkeypatch.setattr(labelling, "PROMPTS_AT_ONCE", 3)
    seen = []

    def scorer(batches):
        for prompts in batches:
            seen.append(len(prompts))
            yield prompts + "!"

    batches = [pd.Series(list("abcdefg")), pd.Series([], dtype=object), pd.Series(list("hi"))]
    got = [list(s) for s in labelling._in_slices(scorer)(iter(batches))]
    assert got == [[c + "!" for c in "abcdefg"], [], ["h!", "i!"]] and max(seen) == 3

import random

import duckdb
import pytest
from conftest import values
from pyspark.sql import functions as F

from postpulse.functions.labels import label_numeric, label_prompt, normalise_label
from postpulse.functions.posts import combined_text
from postpulse.functions.text import lower_trim, map_pos, ngrams, normalise_tokens, strip_special, tokenise
from postpulse.operators.labelling import keyword_scorer, label_posts, merge_neither, of_class
from postpulse.operators.lexicon import effective_lemmas, join_lexicon, lemmatise, lemmatise_by_join
from postpulse.plans import oracles

CASES = {
    "I don't like it.": ["n't", "like"],
    "cannot": ["not"],
    "can't": ["ca", "n't"],
    "C++ & C#": ["c", "c"],
    "co-op": ["coop"],
    "café": ["caf"],
    '"quoted" words': ["quoted", "''", "words"],
    "the 4th of": ["th"],
    "and the of": [],
    "": [],
    "gonna wanna": ["gon", "na", "wan", "na"],
    "they'll we've I'd it's": [],
    "ends mid... then--go": ["ends", "mid", "go"],
    "at 3:30, note: this,that": ["note"],
    "no, NOT never": ["no", "not", "never"],
    "wide blank　here": ["wide", "blank"],
    "dogs' toys": ["dogs", "'", "toys"],
}


def test_known_sentences(frame):
    df = frame(list(enumerate(CASES)), "n int, text string").orderBy("n")
    got = values(df.select("n", normalise_tokens("text").alias("t")).orderBy("n"), "t")
    assert dict(zip(CASES, got)) == CASES


def test_fused_patterns_equal_the_published_ones(frame):
    """No accents next to contractions here: the SQL engine's word boundaries are ASCII-only."""
    rng = random.Random(7)
    pieces = ["don't", "can", "not", "cannot", "it's", "'", '"', "''", "`", "(", "[", "-", "--", ".", "..", ",", ":",
              ";", "!", "5", "a", "x", "the", " ", " ", " ", "\n", "'tis", "gimme", "d'ye", "more'n", "rock'n", "we've",
              "“", "’", "wanna", "#", "c++", "e.g.", "n't", "'s", "s'"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    ours = frame(list(enumerate(texts)), "n int, text string").select("n", strip_special("text").alias("t"))
    ours = dict(values(ours))
    con = duckdb.connect()
    con.execute("create table t(n int, text varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    theirs = dict(con.sql(f"select n, {oracles._split(oracles._letters('text'))} from t").fetchall())
    differing = [(texts[n], ours[n], theirs[n]) for n in ours if ours[n] != theirs[n]]
    assert not differing, differing[:10]


def test_null_text_stays_null(frame):
    got = frame([(None,)], "text string").select(tokenise("text"), lower_trim("text")).first()
    assert tuple(got) == (None, None)


@pytest.mark.parametrize("n, expected", [(1, ["a", "b", "c"]), (2, ["a", "b", "c", "a b", "b c"]),
                                         (3, ["a", "b", "c", "a b", "b c", "a b c"])])
def test_ngrams(frame, n, expected):
    df = frame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = values(df.select(ngrams("t", n).alias("g")), "g")
    assert sorted(got) == sorted([expected, ["a"], []])


def test_map_pos(frame):
    rows = [("JJ",), ("NNS",), ("RB",), ("VBD",), ("IN",), (None,)]
    assert values(frame(rows, "tag string").select(map_pos("tag").alias("p")), "p") == ["a", "n", "r", "v", None, None]


LEXICON = [("running", "VBG", "run"), ("dogs", "NNS", "dog"), ("best", "JJS", "good"), ("among", "IN", "amongst"),
           ("dogs", "VBZ", "dogging"), ("same", "NN", "same")]


def test_lemmas_both_ways(frame):
    lexicon = frame(LEXICON, "token string, tag string, lemma string")
    docs = frame([("s", "1", ["dogs", "running", "dogs", "among", "zzz"], 5), ("s", "2", [], 6), ("s", "3", None, 7)],
                 "subreddit string, ID string, tokens array<string>, other int")
    expected = [("s", "1", ["dog", "run", "dog", "among", "zzz"], 5), ("s", "2", [], 6)]
    assert sorted(values(lemmatise(docs, lexicon).filter("tokens is not null"))) == expected
    joined = lemmatise_by_join(docs.filter("ID < 3"), effective_lemmas(lexicon))
    assert sorted(values(joined)) == expected
    assert sorted(values(lemmatise(docs.filter("ID < 3"), lexicon, max_local=1))) == expected
    assert values(lemmatise(docs, lexicon).filter("ID = 3"), "tokens") == [None]


def test_untagged_tokens_are_nouns(frame):
    tags = frame([("run", "VB")], "token string, tag string")
    lemmas = frame([("run", "v", "go"), ("run", "n", "x"), ("mice", "n", "mouse"), ("mice", "v", "y")],
                   "token string, pos string, lemma string")
    assert sorted(values(join_lexicon(tags, lemmas))) == [("mice", "NN", "mouse"), ("run", "VB", "go")]


def test_answers_to_labels(frame):
    answers = {"Positive": "positive", " negative.": "negative", "Neutral, not positive": "neutral",
               "neither": "neither", "positive_x": "neither", "positiveé": "neither", "n/a": "neither", "": "neither"}
    df = frame([*answers.items(), (None, "neither")], "answer string, expected string")
    assert all(values(df.select((normalise_label("answer") == F.col("expected")).alias("same")), "same"))


def test_scorer_labels_posts(frame):
    df = frame([("t", "I love it"), ("t", "worthless"), ("t", "plain"), ("t", None)], "title string, content string")
    got = label_posts(df, keyword_scorer(), partitions=2)
    assert sorted(values(got, "sentiment")) == ["negative", "neutral", "neutral", "positive"]
    prompt = df.limit(1).select(label_prompt(combined_text()).alias("p")).first()["p"]
    assert prompt.endswith('neither if not about career?: "t I love it" - answer in 1 word')


def test_null_parts_of_text(frame):
    df = frame([("t", None)], "title string, content string")
    assert df.select(combined_text()).first()[0] is None
    assert df.select(combined_text(null_as_nan_text=True)).first()[0] == "t nan"


def test_merge_modes(frame):
    rows = [("1", "t", "neither"), ("2", "u", "positive")]
    df = frame(rows, "ID string, title string, sentiment string").withColumn("date", F.current_timestamp())
    assert sorted(values(merge_neither(df).drop("date"))) == [("1", "t", "neutral"), ("2", "u", "positive")]
    over = merge_neither(df, "overwrite_row", keep=["ID"])
    assert set(dict(over.dtypes).values()) == {"string"}
    assert ("1", "neutral", "neutral", "neutral") in values(over)
    with pytest.raises(ValueError):
        merge_neither(df, "other")
    assert values(of_class(df, "positive", "negative"), "ID") == ["2"]


def test_label_numbers(frame):
    df = frame([("positive",), ("neutral",), ("negative",), ("neither",), (None,)], "s string")
    assert values(df.select(label_numeric("s").alias("n")), "n") == [1, 0, -1, None, None]


def test_labels_are_stored_and_scored_once(spark):
    """A scorer whose answers vary: every read of the labelled table sees the same labels."""
    import random
    from collections.abc import Iterator

    import pandas as pd

    from postpulse.plans.train import label

    def vary(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield prompts.map(lambda _: random.choice(["positive", "negative", "neutral"]))

    posts = spark.range(200).selectExpr("'s' as subreddit", "cast(id as string) as ID", "'t' as title", "'c' as content")
    labelled = label(posts, vary)
    first = sorted(labelled.filter("sentiment = 'positive'").select("ID").toPandas()["ID"])
    assert first == sorted(labelled.filter("sentiment = 'positive'").select("ID").toPandas()["ID"])
    assert labelled.count() == 200


def test_lemmas_do_not_depend_on_the_lexicon_size(frame):
    """Equal keys, null and empty arrays and null tokens, looked up in place and by the join."""
    docs = frame(
        [("a", "1", ["cats", "ran", None, "cats"]), ("a", "1", ["dogs"]), (None, None, ["cats"]), ("a", "2", []), ("a", "3", None), ("a", "4", [None])],
        "subreddit string, ID string, tokens array<string>",
    )
    lexicon = frame([("cats", "NNS", "cat"), ("dogs", "NNS", "dog"), ("cat", "NN", "feline")], "token string, tag string, lemma string")
    local, joined = (sorted(values(lemmatise(docs, lexicon, max_local=size)), key=str) for size in (1 << 20, 0))
    assert local == joined and len(local) == 6
    assert ("a", "1", ["cat", "ran", None, "cat"]) in local and ("a", "1", ["dog"]) in local and ("a", "3", None) in local


def test_lemmas_are_swapped_by_slices_of_rows(monkeypatch):
    import pyarrow as pa

    from postpulse.operators import lexicon

    monkeypatch.setattr(lexicon, "ROWS_AT_ONCE", 2)
    kind = pa.list_(pa.struct([("token", pa.string()), ("lemma", pa.string())]))
    lists = pa.array([["as", "b"], None, [], ["cs", None, "as"], ["x"]], pa.list_(pa.string()))
    found = pa.array([[{"token": "as", "lemma": "a"}], None, None, [{"token": "cs", "lemma": "c"}, {"token": "as", "lemma": "a"}], []], kind)
    assert lexicon._swap_own(lists, found).to_pylist() == [["a", "b"], None, [], ["c", None, "a"], ["x"]]
    assert lexicon._swap_own(lists[1:], found[1:]).to_pylist() == [None, [], ["c", None, "a"], ["x"]]
    assert lexicon._swap_own(lists[:0], found[:0]).to_pylist() == []


def test_only_labelled_texts_are_tokenised(spark, tmp_path):
    from postpulse.plans.views import Tables

    spark.createDataFrame([(1, "good words", "s"), (2, "more words", "s")], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = Tables(spark, str(tmp_path)).labelled_docs()
    assert [(r["ID"], r["sentiment"], r["tokens"]) for r in found.collect()] == [("2", "neutral", ["words", "words"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("split(") < plan.index("Join")

import math
import time

import pytest
from conftest import values
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from postpulse.functions.text import ngrams
from postpulse.operators import bayes, features, learning, term_index
from postpulse.operators.bayes import ComplementBayes, fit_bayes, predict_bayes
from postpulse.operators.evaluate import accuracy, confusion, confusion_long, micro_f1
from postpulse.operators.lookup import lookup_join
from postpulse.plans import analyse, train

WORDS = {"negative": ["bad", "fail", "no"], "neutral": ["code", "work", "school"], "positive": ["good", "hire", "win"]}


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for name, words in WORDS.items():
        for i in range(20):
            tokens = [words[i % 3], words[(i + 1) % 3], "common", f"rare{i}", words[i % 3]]
            rows.append(("s", f"{name}{i}", name, tokens))
    rows.append(("s", "empty", "neutral", []))
    return spark.createDataFrame(rows, "subreddit string, ID string, sentiment string, tokens array<string>").cache()


def test_tfidf_by_hand(frame):
    df = frame([("s", "1", ["a", "a", "b"]), ("s", "2", ["b"]), ("s", "3", [])],
               "subreddit string, ID string, tokens array<string>")
    got = {(r["ID"], r["term"]): r["weight"] for r in features.tfidf(df).collect()}
    a, b = 2 * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    norm = math.hypot(a, b)
    assert got == {("1", "a"): pytest.approx(a / norm), ("1", "b"): pytest.approx(b / norm), ("2", "b"): pytest.approx(1)}


def test_document_frequency_bounds(docs):
    tf = features.term_freq(docs)
    terms = lambda *a: set(values(features.doc_freq(tf, docs.count(), *a), "term"))
    assert "common" in terms(1, 1.0) and "common" not in terms(1, 0.9)
    assert "rare1" in terms(1) and "rare1" not in terms(4)
    with pytest.raises(ValueError):
        features.doc_freq(tf, None, 1, 0.5)


@pytest.mark.parametrize("ngram_max, min_df, max_df", [(1, 1, 1.0), (2, 2, 0.9)])
def test_sparse_rows_equal_the_tables(docs, ngram_max, min_df, max_df):
    grams = docs.withColumn("tokens", ngrams("tokens", ngram_max))
    table = {(r["ID"], r["term"]): r["weight"] for r in features.tfidf(grams, min_df=min_df, max_df=max_df).collect()}
    index = term_index.fit_index(docs, ngram_max, min_df, max_df)
    terms = {r["id"]: r["term"] for r in index.table.collect()}
    assert sorted(terms) == list(range(index.size)) and [terms[i] for i in sorted(terms)] == sorted(terms.values())
    rows = term_index.sparse_rows(docs, index, ["ID"])
    got = {(r["ID"], terms[i]): w for r in rows.collect() for i, w in zip(r["ids"], r["weights"])}
    assert rows.count() == docs.count() and got.keys() == table.keys()
    assert all(abs(got[k] - table[k]) < 1e-9 for k in table)
    vectors = term_index.with_vectors(rows, index.size).select("ID", vector_to_array("features").alias("v"))
    assert {(r["ID"], terms[i]): x for r in vectors.collect() for i, x in enumerate(r["v"]) if x} == got


def test_bayes_tables_equal_the_pipeline(spark, docs, tmp_path):
    model = fit_bayes(docs, alpha=0.1, min_df=2, max_df=0.9)
    ours = dict(values(predict_bayes(docs, model).select("ID", "predicted")))
    fitted = learning.fit_pipeline(docs, "cNB", {"alpha": 0.1, "min_df": 2, "max_df": 0.9})
    assert dict(values(learning.predict(docs, fitted).select("ID", "predicted"))) == ours
    twice = docs.withColumn("ID", F.lit("one key"))
    assert learning.predict(twice, fitted).count() == docs.count()
    assert ours["empty"] == "negative"  # no known term: all scores equal, first class
    model.save(str(tmp_path / "m"))
    loaded = ComplementBayes.load(spark, str(tmp_path / "m"))
    assert dict(values(predict_bayes(docs, loaded).select("ID", "predicted"))) == ours
    shuffled = predict_bayes(docs, loaded, max_broadcast=0)
    assert dict(values(shuffled.select("ID", "predicted"))) == ours


def test_large_tables_are_not_broadcast(docs):
    tf = features.term_freq(docs)
    table = tf.select("term").distinct()
    plan = lambda rows: lookup_join(tf, table, "term", "inner", rows)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan(10) and "BroadcastHashJoin" not in plan(10**9)


@pytest.mark.parametrize(
    "kind, setting", [("cNB", {}), ("SVM", {"C": 1.0, "min_df": 2}), ("SVM", {"kernel": "linear"}), ("GBDT", {"n_estimators": 5, "min_df": 2})]
)
def test_models_train_save_and_load(docs, tmp_path, kind, setting):
    fitted = learning.fit_pipeline(docs, kind, setting)
    learning.save_model(fitted, str(tmp_path), kind)
    model = learning.load_model(str(tmp_path), kind)
    guessed = learning.predict(docs, model)
    assert guessed.columns == [*docs.columns, "predicted"] and guessed.count() == docs.count()
    assert guessed.filter("sentiment = predicted").count() > 55
    assert sorted(values(guessed.select("ID", "predicted"))) == sorted(values(learning.predict(docs.drop("sentiment"), fitted).select("ID", "predicted")))


def test_unknown_models_are_refused(docs, tmp_path):
    for call in (lambda: learning.load_model(str(tmp_path), "LSTM"), lambda: learning.fit_pipeline(docs, "LSTM")):
        with pytest.raises(ValueError, match="LSTM"):
            call()
    with pytest.raises(ValueError, match="no term"):
        term_index.fit_index(docs, min_df=1000)


def test_a_vocabulary_of_more_than_a_million_terms(spark):
    """Word pairs that occur once each: numbered without gaps, whatever reaches the driver is a count."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(600)), lambda i: F.concat(F.lit("w"), (F.col("id") * 601 + i).cast("string")))
    many = spark.range(0, 950, 1, 8).select(tokens.alias("tokens"))
    index = term_index.fit_index(many, ngram_max=2)
    assert index.size == 950 * (601 + 600) > 1 << 20
    bounds = index.table.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(bounds) == (0, index.size - 1, index.size)


def test_repeats_are_counted_inside_a_row(frame):
    df = frame([(1, ["b", "a", "b", None, "c", "b"]), (2, []), (3, None), (4, ["x"])], "i int, t array<string>")
    got = {r["i"]: r["c"] and [tuple(e) for e in r["c"]] for r in df.select("i", term_index.counted_terms("t").alias("c")).collect()}
    assert got == {1: [("a", 1), ("b", 3), ("c", 1)], 2: [], 3: None, 4: [("x", 1)]}


def test_drawn_settings_differ():
    grid = learning.PARAM_GRIDS["GBDT"]
    size = math.prod(len(v) for v in grid.values())
    drawn = learning.draw_settings(grid, 100, seed=3)
    assert size == 46_080 and len({tuple(s.items()) for s in drawn}) == 100
    assert len(learning.draw_settings(learning.PARAM_GRIDS["cNB"], 10_000)) == 192


def test_search_picks_the_best_mean(docs):
    grid = {"ngram_max": (1,), "max_df": (1.0,), "min_df": (1, 2), "alpha": (1.0, 0.1)}
    found = learning.random_search(docs, "cNB", n_iter=10, folds=3, grid=grid)
    assert len(found.scores) == 4 and found.best_score == max(s for _, s in found.scores)
    assert "predicted" in learning.predict(docs, found.model).columns


def test_train_and_analyse(spark, tmp_path):
    rows = []
    for i in range(240):
        name = ["negative", "neutral", "neutral", "positive", "neither"][i % 5]
        words = WORDS.get(name, WORDS["neutral"])
        date = f"20{20 + i // 120}-{i // 10 % 12 + 1:02d}-{i % 10 + 1:02d} 00:00:00"
        rows.append(("s", str(i), words[i % 3], f"{words[(i + 1) % 3]} post number {i}", name, date))
    posts = spark.createDataFrame(rows, "subreddit string, ID string, title string, content string, sentiment string, date string")
    posts = posts.withColumn("date", F.to_timestamp("date"))
    for mode in ("relabel", "overwrite_row"):
        reports = train(posts, str(tmp_path), ["cNB"], n_iter=2, folds=2, merge_mode=mode)
        report = reports["cNB"]
        total = report.confusion.select(F.sum(F.col("negative") + F.col("neutral") + F.col("positive"))).first()[0]
        assert total == math.ceil(0.2 * 144) and 0.5 <= report.accuracy <= 1
    outcome = analyse(posts, learning.load_model(str(tmp_path)))
    assert outcome.scored.count() == 240
    assert outcome.histogram.agg(F.sum("n")).first()[0] == 240
    assert {r["series"] for r in outcome.regression.collect()} == {"neg", "pos"}


def test_confusion_has_zero_cells(frame):
    df = frame([("negative", "neutral"), ("neutral", "neutral"), ("neutral", "neutral")], "actual string, predicted string")
    assert sorted(values(confusion(df))) == [("negative", 0, 1, 0), ("neutral", 0, 2, 0), ("positive", 0, 0, 0)]
    assert len(values(confusion_long(df))) == 9
    assert values(accuracy(df)) == [(3, 2, 2 / 3)]
    score = micro_f1(df).first()
    assert (score["tp"], score["fp"], score["fn"]) == (2, 1, 1) and score["micro_f1"] == pytest.approx(2 / 3)


def test_scores_of_ties_take_the_first_class(frame):
    df = frame([(1.0, 1.0, 0.5), (0.0, 2.0, 2.0), (0.0, 0.0, 1.0)], "a double, b double, c double")
    best = bayes._best_class([F.col(c) for c in "abc"], ["x", "y", "z"])
    assert values(df.select(best.alias("best")), "best") == ["x", "y", "z"]


def test_confusion_keeps_unlisted_actual_labels(spark):
    df = spark.createDataFrame([("a", "other", "neutral"), ("b", None, "neutral")], "ID string, actual string, predicted string")
    rows = {r["actual"]: r["neutral"] for r in confusion(df).collect()}
    assert rows == {"negative": 0, "neutral": 0, "positive": 0, "other": 1}


def test_frequent_keys_are_broadcast_beside_rare_ones(spark):
    from postpulse.operators.lookup import lookup_join

    table = spark.createDataFrame([(f"t{i}", float(i // 3)) for i in range(30)], "term string, idf double")
    facts = spark.createDataFrame([(i, f"t{i % 40}") for i in range(200)] + [(200, None)], "i int, term string")
    for how in ("inner", "left"):
        split = lookup_join(facts, table, "term", how, 30, 10, rarity="idf")
        whole = lookup_join(facts, table, "term", how, 30, 10)
        assert sorted(map(str, split.collect())) == sorted(map(str, whole.select(split.columns).collect()))
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_entries_of_broadcast_terms_stay_with_their_document(spark, docs):
    """beyond the broadcast limit every entry was shuffled by document for the norm."""
    tf = features.term_freq(docs)
    vocabulary, rows = features.fit_vocabulary(tf, docs.count(), 1, 1.0)
    split = features.weigh_terms(tf, vocabulary, vocabulary_rows=rows, max_broadcast=rows // 2)
    plan = split._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("Window") : plan.index("Union")]
    assert "Exchange" not in above
    rounded = lambda df: sorted((r["subreddit"], r["ID"], r["term"], round(r["weight"], 9)) for r in df.collect())
    assert rounded(split) == rounded(features.weigh_terms(tf, vocabulary, vocabulary_rows=rows))



def test_a_long_document_is_sorted_and_added_up_once(spark):
    """doing so per term takes minutes for 12,000 terms."""
    terms = [f"t{i * 7919 % 12000}" for i in range(12000)]
    docs = spark.createDataFrame([(1, terms), (2, ["t1", "t1", "t2"]), (3, [])], "ID int, tokens array<string>")
    index = term_index.fit_index(docs)
    start = time.monotonic()
    found = {r["ID"]: r for r in term_index.sparse_rows(docs, index, ["ID"]).collect()}
    assert time.monotonic() - start < 30
    assert found[1]["ids"] == list(range(12000)) and math.isclose(sum(w * w for w in found[1]["weights"]), 1)
    assert [round(w, 6) for w in found[2]["weights"]] == [0.894427, 0.447214] and found[3]["ids"] == []


"""Pages, vectors, revisits and the pipeline."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from postpulse.llm import html_text, neighbours, revisits
from postpulse.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"

PAGE = """<html><head><title>no</title><script>var p="<p>no</p>";</script></head><body>
<header class="site"><a href="/">no</a></header><div class="menu"><ul><li><a href=a>no</a><li><a>no</a><li><a>no</a></ul></div>
<div id="cookie-notice"><p>no, no, no cookies here, please.</p></div>
<div class="layout-with-sidebar"><div class="post-content"><h1>A &amp; B</h1><p>First&nbsp;  paragraph,
 with <b>bold</b> and <a href=x>a link</a>, long enough.<p>Second one, caf&eacute; &#8212; also<br>long enough, really.
<div class="ad-box">no</div><blockquote>Quoted, text.</blockquote><ul><li>one<li>two</ul><form><p>no</p></form></div>
<aside>no</aside><div class="comments"><article class="comment"><p>no, a reader, writes, very, much, with many, commas, here.</p></article></div></div>
<footer>no</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == ["A & B", "First paragraph, with bold and a link, long enough.", "Second one, café — also long enough, really.", "Quoted, text.", "one", "two"]


@pytest.mark.parametrize("html", [None, "", " ", "<", "<!--", "<p", "<script>x", "</p></div>", "<nav>no</nav>"])
def test_pages_without_text(html):
    assert html_text.main_text(html) in ("", "<", "<p")


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 20_000 + "deep text, here") == "deep text, here"
    assert len(html_text.main_text("<article>" + "<p>some words, again</p>" * 5000).split("\n")) == 5000


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (None, None, None, 5), (1, "u", PAGE, 5)], "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert sorted((str(r["page_id"]), r["n_chars"] == len(r["text"])) for r in got) == [("1", True), ("1", True), ("None", True)]
    assert html_text.extract(pages.filter("false")).collect() == []


def test_neighbours_recall_and_edges(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(3000, 24)) * rnd.uniform(0.5, 2, (3000, 1))
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0, None] * 12), (5004, [1.0]), (None, rows[0][1]), rows[7]]
    points = neighbours.vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"))
    rule = neighbours.Search(list_rows=100)
    old, neighbours.SAMPLE = neighbours.SAMPLE, 900
    try:
        got = neighbours.search(points, points.filter("vec_id % 20 = 0"), rule).collect()
    finally:
        neighbours.SAMPLE = old
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 20):
        score = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and [m[2] for m in mine] == [score[m[1]] for m in mine]
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hits += len(set(best) & {m[1] for m in mine})
    assert hits / (150 * 20) >= 0.9 and set(found) == set(range(0, 3000, 20))
    few = neighbours.search(points.filter("vec_id in (20, 21, 22)"), points.filter("vec_id = 20")).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert neighbours.search(points.filter("false"), points.filter("false")).collect() == []


def test_revisits(spark):
    def row(i, url, at, kind, headers):
        return (i, url, at, kind, headers)

    rows = [
        row("a", "http://www.H.org:80/p/?b=2&utm_x=1&a=1#f", 10, "response", {"ETag": '"1"', "X": "y"}),
        row("b", "https://h.org/p?a=1&b=2", 20, "revisit", {"etag": 'W/"1"', "Date": "d", "X": "z"}),
        row("c", "h.org/p?b=2&a=1", 30, "response", {"ETag": '"2"'}),
        row("d", "h.org/p?b=2&a=1", 40, "revisit", {"ETag": '"1"'}),
        row("e", "h.org/p?b=2&a=1", 5, "revisit", None),
        row("f", "h.org/p?b=2&a=1", 50, "revisit", {"Vary": "v"}),
        row("g", None, 50, "revisit", {"ETag": '"1"'}),
        row("h", "h.org/q", None, "revisit", {}),
        row("a", "http://www.H.org:80/p/?b=2&utm_x=1&a=1#f", 10, "response", {"ETag": '"1"', "X": "y"}),
        row("x", "h.org/q", 1, "request", {}),
    ]
    data = spark.createDataFrame(rows, "record_id string, url string, at long, kind string, headers map<string,string>").withColumn("payload", __import__("pyspark").sql.functions.col("record_id"))
    data = data.selectExpr("record_id", "url", "timestamp_seconds(at) as date", "kind", "headers", "payload")
    found = revisits.resolve(data)
    got = {r["record_id"]: (r["status"], r["response_id"], r["headers"]) for r in found.collect()}
    assert got == {
        "b": ("resolved", "a", {"etag": 'W/"1"', "date": "d", "x": "y"}),
        "d": ("mismatch", None, {"etag": '"1"'}),
        "e": ("missing", None, {}),
        "f": ("unvalidated", "c", {"etag": '"2"', "vary": "v"}),
        "g": ("missing", None, {"etag": '"1"'}),
        "h": ("missing", None, {}),
    }
    full = {r["record_id"]: r["payload"] for r in revisits.with_payload(found, data).collect()}
    assert full["b"] == "a" and full["f"] == "c" and full["d"] is None
    assert revisits.resolve(data.filter("false")).collect() == []


def test_one_url_over_many_ranges(spark):
    """A URL whose captures fill every range; each revisit's response may lie ranges away."""
    data = spark.range(4000).selectExpr(
        "cast(id as string) as record_id", "'h.org/' as url", "timestamp_seconds(id) as date", "if(id in (3, 1500, 2750), 'response', 'revisit') as kind", "map('a', 'b') as headers"
    )
    got = {int(r["record_id"]): r["response_id"] for r in revisits.resolve(data).collect()}
    assert len(got) == 3997
    for i, response in got.items():
        assert response == (None if i < 3 else "3" if i < 1500 else "1500" if i < 2750 else "2750")


def test_revisit_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    name = "op10_revisit_resolution"
    theirs = con.execute(ORACLES[name]).df()
    ours = QUERIES[name](spark, DATA).toPandas()
    rows = lambda f: sorted(map(tuple, f[sorted(f)].fillna("").values))
    assert rows(ours) == rows(theirs)


def test_pipeline_stages(spark):
    """Every stage takes effect on its input and keeps the columns of documents."""
    import re

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.stored(stage(spark, tables[-1], DATA), "stage"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    good, once, cut, clean, mix = ({r["doc_id"]: r for r in t.collect()} for t in tables[1:])
    assert all(labels.get(i) != 0 for i in good) and sum(q == 1 and i not in good for i, q in labels.items()) <= 2

    def shingles(text):
        w = text.lower().split()
        return frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])) or frozenset([tuple(w)])

    sets = {i: shingles(r["text"]) for i, r in good.items()}
    for i in good:
        near = [j for j in good if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        if i in once:
            assert not near
    windows = set()
    for i in sorted(cut):
        w = cut[i]["text"].split()
        assert cut[i]["n_chars"] == len(cut[i]["text"])
        windows |= {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
    tokens = lambda t: re.findall(r"\w+", t.lower())
    bench = {tuple(tokens(r["text"])[:13]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    for r in clean.values():
        w = tokens(r["text"])
        assert not any(tuple(w[k : k + 13]) in bench for k in range(len(w) - 12))
    assert set(mix) <= set(clean) and {"shard", "copy"} <= set(tables[-1].columns)


def test_rows_without_id_stay_in_the_pipeline(spark):
    """Whether another row without id exists makes no difference to a linked one."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (6, text), (None, text), (7, "something else here"), (7, "something else here")]
    for more in ([], [(None, "unrelated words")]):
        table = [(i, t, None, None, None) for i, t in rows + more]
        docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
        kept = corpus_pipeline.one_of_each_group(spark, docs, DATA).collect()
        assert sorted(str(r["doc_id"]) for r in kept) == sorted(["5", "7", "None"] + ["None"] * len(more))


def test_pipeline_of_nothing(spark):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name

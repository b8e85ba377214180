"""Near duplicates, token alignment and vector codes against brute force, and their edge rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from test_documents import SCHEMA, docs, groups, none, rows, words  # noqa: F401

from postpulse.llm import near_duplicates, token_alignment, vector_codes
from postpulse.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def key(row):
    return str(tuple(row))


# --- near duplicates -----------------------------------------------------------


def expected_groups(table):
    return sorted(((i, n, c, c == i) for i, n, c in groups(table, 5, 85)), key=str)


def test_near_duplicates_equal_brute_force(docs, rows):  # noqa: F811
    assert sorted(map(tuple, near_duplicates.link(docs).collect()), key=str) == expected_groups(rows)


def test_edits_around_the_threshold(spark):
    """Copies of several bases with 1 to 12 changed words: many pairs lie close to the threshold."""
    rnd, table = random.Random(7), []
    for base in range(6):
        text = words(180, 100 + base, 5000)
        for copy in range(40):
            changed = list(text)
            for at in rnd.sample(range(len(text)), rnd.randrange(1, 13)):
                changed[at] = f"c{base}x{copy}x{at}"
            table.append((len(table), " ".join(changed), None, None, None, None))
    got = near_duplicates.link(spark.createDataFrame(table, SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == expected_groups(table)
    assert len({r["component_id"] for r in got}) > 6


def test_near_duplicates_edge_rows(spark, none):  # noqa: F811
    text = " ".join(words(50, 3))
    table = [(None, text, "x", 1), (7, text, "x", 2), (7, text, "x", 2), (7, "other words than those", "y", 3), (None, None, "x", 1), (None, "Q r s", None, 0), (None, "q R s", None, 0), (3, " \t", "x", 1)]
    frame = spark.createDataFrame(table, "doc_id long, text string, node string, key int")
    got = sorted(map(tuple, near_duplicates.link(frame).collect()), key=str)
    assert got == sorted([(None, 46, 7, False), (7, 46, 7, True), (7, 46, 7, True), (7, 1, 7, True), (None, 0, None, True), (None, 1, None, True), (None, 1, None, True), (3, 0, 3, True)], key=str)
    assert near_duplicates.link(none).collect() == []


def test_pigeonhole_finds_every_pair_within_the_distance():
    rnd = np.random.default_rng(1)
    for _ in range(500):
        a = rnd.integers(0, 1 << near_duplicates.BITS, near_duplicates.VALUES).astype(np.uint16)
        b = a.copy()
        wrong = rnd.choice(near_duplicates.VALUES, near_duplicates.DISTANCE, replace=False)
        b[wrong] ^= np.uint16(1)
        left, right = near_duplicates.bucket_keys(np.stack([a, b]))
        assert set(left) & set(right)


def test_signature_distance_follows_the_similarity(spark):
    rnd, apart = np.random.default_rng(2), []
    for _ in range(400):
        grams = rnd.integers(0, 1 << 63, 460, dtype=np.uint64) * np.uint64(2)
        a, b = near_duplicates.signatures([np.unique(grams[:430]), np.unique(grams[30:])])  # 400 of 460 shared
        apart.append(int((a != b).sum()))
    assert abs(np.mean(apart) / near_duplicates.VALUES - 60 / 460) < 0.02
    assert max(apart) <= near_duplicates.DISTANCE
    assert near_duplicates.miss_probability(0.85) < 1e-5 < near_duplicates.miss_probability(0.6)
    lanes = [np.ascontiguousarray(s).view(np.int64).tolist() for s in (a, b)]
    frame = spark.createDataFrame([tuple(lanes)], "u array<long>, v array<long>")
    assert frame.selectExpr(near_duplicates._differing("u", "v")).first()[0] == apart[-1]


# --- token alignment -------------------------------------------------------------

TEXTS = [
    "The cat sat on the mat, the cat ran.",
    "Ünïcode, naïve café — 東京 🙂🙂 and 12345.",
    "<|endoftext|> is text here, <s> and </s> too; <0x41> as well.",
    " leading and  double  blanks\n\tand\r\nlines ",
    "a▁b",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 8,
    "",
    None,
    "x",
    "The cat sat on the mat, the cat ran.",
    "\u0000 nul and ﬁ ligature",
]


@pytest.fixture(scope="module")
def tokenizers():
    files = [open(f"{token_alignment.TOKENIZERS}/{name}", "rb").read() for name in (token_alignment.A_FILE, token_alignment.B_FILE)]
    return token_alignment.Pair(*files)


def brute_alignment(table, pair):
    """Nested loops over groups, and a dictionary of documents per pair."""
    per_doc, holders = [], defaultdict(set)
    for number, (_, text) in enumerate(table):
        links, spelled, a, b = Counter(), [], [], []
        if text:
            a = pair.a.encode(" " + text, add_special_tokens=False).ids
            b = pair.b.encode(text)
            whole = (" " + text).encode()
            if b"".join(pair.a_bytes[i] for i in a) != whole or b"".join(pair.b_bytes[i] for i in b) != whole:
                a, b = [], []
        x = y = end_x = end_y = 0
        while x < len(a):
            first_x, first_y = x, y
            while True:
                if end_x <= end_y:
                    end_x, x = end_x + len(pair.a_bytes[a[x]]), x + 1
                else:
                    end_y, y = end_y + len(pair.b_bytes[b[y]]), y + 1
                if end_x == end_y:
                    break
            left, right = a[first_x:x], b[first_y:y]
            spelled.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            links.update((i, j) for i in left for j in right)
        for link in links:
            holders[link].add(number)
        per_doc.append((len(a), len(b), links, ";".join(spelled)))
    highest = Counter()
    for (i, _), found in holders.items():
        highest[i] = max(highest[i], len(found))
    result = []
    for (doc_id, _), (n_a, n_b, links, spelled) in zip(table, per_doc):
        best = sum(n for p, n in links.items() if len(holders[p]) == highest[p[0]])
        total = sum(n * len(holders[p]) for p, n in links.items())
        digest = hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""
        result.append((doc_id, n_a, n_b, spelled.count("|") if spelled else 0, sum(links.values()), best, total, digest))
    return sorted(result, key=str)


def test_alignment_equals_brute_force(spark, tokenizers):
    rnd = random.Random(5)
    more = [" ".join(rnd.choice(TEXTS[0].split() + ["unhappily", "東京", "re-do"]) for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    table = [(i if i != 2 else None, t) for i, t in enumerate(TEXTS + more)] + [(5, TEXTS[5])]
    frame = spark.createDataFrame([(*r, "p") for r in table], "doc_id long, text string, pair string").repartition(3)
    got = sorted(map(tuple, token_alignment.align(frame).collect()), key=str)
    assert got == brute_alignment(table, tokenizers)
    zeros = [r for r in got if r[0] in (6, 7)]
    assert all(r[1:] == (0, 0, 0, 0, 0, 0, "") for r in zeros) and len(zeros) == 2


def test_small_blocks_hold_the_same_links(tokenizers, monkeypatch):
    """The index of a task, with limits that close blocks after a few documents."""
    import pyarrow as pa

    monkeypatch.setattr(token_alignment, "BLOCK_LINKS", 30)
    monkeypatch.setattr(token_alignment, "BATCH_DOCS", 3)
    monkeypatch.setattr(token_alignment.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 4})())
    monkeypatch.setattr(token_alignment, "Pair", lambda *_: tokenizers)
    table = list(enumerate(TEXTS * 3))
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in table], "text": [t.encode() if t is not None else None for _, t in table]}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.binary())]))
    files = type("Files", (), {"value": (b"", b"")})()
    found = [r for b in token_alignment._index(files)(iter([batch])) for r in b.to_pylist()]
    docs_of = {(r["block"], r["place"]): r["doc_id"] for r in found if r["place"] is not None}
    assert sorted(docs_of.values()) == [i for i, _ in table] and len({b for b, _ in docs_of}) > 5
    linked = Counter()
    for r in found:
        if r["pair"] is None:
            continue
        for place in token_alignment.unpack(r["docs"]):
            linked[docs_of[r["block"], int(place)]] += 1
        for k, plane in enumerate(r["planes"]):
            for place in token_alignment.unpack(plane):
                linked[docs_of[r["block"], int(place)]] += 1 << k
    assert all(linked[r["doc_id"]] == r["n_links"] for r in found if r["place"] is not None)


def test_alignment_of_no_rows(none):  # noqa: F811
    assert token_alignment.align(none).collect() == []


@pytest.mark.parametrize("limit", [0, 1 << 16])
def test_alignment_of_ids(monkeypatch, limit):
    monkeypatch.setattr(token_alignment, "GROUP_LINKS", limit)
    a_sizes, b_sizes = np.array([0, 1, 2, 1]), np.array([0, 2, 1, 2])
    found = token_alignment.Aligned.of([([1, 2, 3, 1, 1], [1, 3, 1]), ([2], [2, 2])], a_sizes, b_sizes)
    pair = type("Spelled", (), {"stride": 4, "spelled": [f"{i}{end}" for end in ",|;" for i in range(4)]})
    assert found.spellings(pair) == ["1,2,3|1,3;1,1|1", "2|2,2"]
    assert found.groups.tolist() == [2, 1] and found.link_counts().tolist() == [8, 2]
    links = {(d, p >> 32, p & 0xFFFFFFFF): n for d, p, n in zip(*(c.tolist() for c in found.links()))}
    assert links == {(0, 1, 1): 3, (0, 1, 3): 1, (0, 2, 1): 1, (0, 2, 3): 1, (0, 3, 1): 1, (0, 3, 3): 1, (1, 2, 2): 2}


@given(st.text(alphabet=" \n\tab,.'é東🙂\u00a0\u200b\u0085\x1c12", max_size=40), st.integers(0, 5))
def test_segments_give_the_tokens_of_the_text(tokenizers, text, repeat):
    text = text * repeat
    whole = tokenizers.whole(text)
    assert tokenizers.by_segment and ("".join(token_alignment.SEGMENT.findall(" " + text)) == " " + text)
    assert tokenizers.encode([text])[0] == (whole if text and tokenizers.spells(whole, text) else None)


@given(st.sets(st.integers(0, 999), min_size=1))
def test_packed_bitmaps(places):
    ordered = np.array(sorted(places))
    assert token_alignment.unpack(token_alignment.pack(ordered, 1000)).tolist() == ordered.tolist()
    assert len(token_alignment.pack(ordered, 1000)) <= 1 + min(2 * len(ordered), 125)


# --- vector codes ------------------------------------------------------------------


def brute_codes(table):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:256]
    width = len(first[0][2])
    kept = [r for r in kept if len(r[2]) == width]
    cut = [p * width // 4 for p in range(5)]
    books = [[r[2][cut[p] : cut[p + 1]] for r in first if len(r[2]) == width] for p in range(4)]

    def assign(p, v):
        part = v[cut[p] : cut[p + 1]]
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), n) for n, e in enumerate(books[p]))

    for _ in range(4):
        moved = []
        for p in range(4):
            members = defaultdict(list)
            for _, _, v in kept:
                members[assign(p, v)[1]].append(v[cut[p] : cut[p + 1]])
            moved.append([[sum(c) // len(c) for c in zip(*members[n])] if n in members else e for n, e in enumerate(books[p])])
        books = moved
    out, by_label = [], Counter()
    for i, label, v in kept:
        found = [assign(p, v) for p in range(4)]
        by_label[label] += sum(d for d, _ in found)
        out.append((i, label, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    text = ",".join(str(x) for part in books for e in part for x in e)
    return sorted(((i, code, error, by_label[label]) for i, label, code, error in out), key=str), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("count,width", [(400, 8), (30, 12), (300, 6)])
def test_codes_equal_brute_force(spark, count, width):
    rnd = np.random.default_rng(count)
    # coarse values make many equal distances
    table = [(int(i), int(i % 3) if i % 5 else None, [float(x) for x in rnd.integers(-3, 4, width) / 64]) for i in rnd.permutation(count)]
    table += [table[0], (None, 1, table[3][2]), (9000, 1, None), (9001, 1, [float("nan")] * width), (9002, None, [float("inf")] * width), (9003, 2, [None] * width), (9004, 2, [1.0])]
    frame = spark.createDataFrame([(*r, "z") for r in table], "vec_id long, label int, embedding array<double>, code string").repartition(5)
    codes, books = vector_codes.compress(frame)
    expected, digest = brute_codes(table)
    got = vector_codes.with_label_errors(codes).select("vec_id", "code", "error", "label_error").collect()
    assert sorted(map(tuple, got), key=str) == expected and books.digest() == digest


def test_codes_of_few_empty_and_huge_vectors(spark):
    kind = "vec_id long, label string, embedding array<double>"
    empty, books = vector_codes.compress(spark.createDataFrame([], kind))
    assert vector_codes.with_label_errors(empty).collect() == [] and books.digest() == hashlib.sha256(b"").hexdigest()
    one, _ = vector_codes.compress(spark.createDataFrame([(1, "a", [1e300, -1e300, 0.0, 1.0])], kind))
    assert [tuple(r) for r in vector_codes.with_label_errors(one).select("code", "error", "label_error").collect()] == [("00000000", 0, 0)]
    bare, _ = vector_codes.compress(spark.createDataFrame([(1, "a", []), (2, "b", [])], kind))
    assert {r["code"] for r in bare.collect()} == {"00000000"}


@given(st.integers(1, 130), st.integers(1, 5), st.integers(0, 1000))
def test_mask_search_is_exact(entries, width, seed):
    rnd = np.random.default_rng(seed)
    masks = vector_codes.Masks.of(rnd.integers(-9, 10, (entries, width)))
    points = rnd.integers(-40, 41, (60, width))
    away = ((points[:, None, :] - masks.entries[None]) ** 2).sum(axis=2)
    entry, least = masks.nearest(points)
    assert entry.tolist() == away.argmin(axis=1).tolist() and least.tolist() == away.min(axis=1).tolist()


@pytest.mark.parametrize("name", ["op11_minhash_near_dedup", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    engine = duckdb.connect()
    for table in ("documents", "embeddings"):
        engine.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), engine.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert sorted(map(key, ours[columns].astype(str).values)) == sorted(map(key, theirs[columns].astype(str).values))


def test_alignment_query_on_the_documents(spark, tokenizers):
    table = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op12_token_alignment"](spark, DATA).collect()), key=str)
    assert got == brute_alignment(table, tokenizers)

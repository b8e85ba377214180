"""Operators on documents against brute force, and their edge rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from postpulse.llm import decontaminate, language, licences, mixing, ngram_join, quality, substring_dedup
from postpulse.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed, vocabulary=400):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Near copies, exact copies, repeated rows, shared passages, nulls, blanks, one long text."""
    base, passage = words(120, 1), words(40, 2)
    near = [base[:k] + [f"x{k}"] + base[k + 1 :] for k in (10, 60)]
    far = base[:30] + words(60, 3)
    texts = [base, near[0], near[1], far, words(15, 4) + passage + words(9, 5), passage, passage + passage, words(30_000, 6), ["A", "b"], ["a", "B"], ["one"]]
    out = [(i, " ".join(t), "en", f"s{i % 3}", None, i % 2) for i, t in enumerate(texts, 10)]
    out += [out[0], (40, out[0][1].replace(" ", "\n", 3), None, None, 1, None), (41, None, "en", "s1", 0, 1), (42, "", "en", None, 0, 0), (43, " \t \n", "de", "s2", 0, None), (None, out[4][1], "en", "s0", 5, 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def grams(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(rows, n, percent):
    sets = [grams(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if sets[i] and ids else r[0]))
    return sorted(out, key=str)


def test_ngram_join_equals_brute_force(docs, rows):
    found = ngram_join.link(docs, ngram_join.Rule(3, 90)).collect()
    assert sorted([tuple(r) for r in found], key=str) == groups(rows, 3, 90)


def test_ngram_join_links_chains_and_rejects_a_dense_group(spark):
    """Copies with one change link through their base; copies with many changes link with nothing."""
    base = words(150, 9, 10_000)
    rnd, out = random.Random(3), [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for k in rnd.sample(range(150), 1 if i % 2 else 5):
            copy[k] = f"new{i}-{k}"
        out.append((i, " ".join(copy)))
    found = ngram_join.link(spark.createDataFrame(out, "doc_id long, text string"), ngram_join.Rule(3, 90)).collect()
    assert sorted([tuple(r) for r in found], key=str) == groups(out, 3, 90)


def test_ngram_join_makes_whole_sets_only_for_nodes_of_candidate_pairs(spark, monkeypatch):
    """Texts and their first halves share many n-grams, but their sizes are too far apart to link."""
    out, kept, stored = [], [], ngram_join.stored
    for i in range(20):
        base = [f"w{i}-{k}" for k in range(100)]
        out += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:50]))]
    out.append((100, " ".join([*base[:-1], "other"])))

    def counted(df, name):
        table = stored(df, name)
        if name == "gram-sets":
            kept.append(table.count())
        return table

    monkeypatch.setattr(ngram_join, "stored", counted)
    found = ngram_join.link(spark.createDataFrame(out, "doc_id long, text string"), ngram_join.Rule(3, 90)).collect()
    assert sorted([tuple(r) for r in found], key=str) == groups(out, 3, 90)
    assert sum(kept) == 2


def test_ngram_join_of_nothing(none):
    assert ngram_join.link(none).collect() == []


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(1)
    for size in (3, 50, 900):
        a = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[5:], rnd.integers(0, 1 << 63, size // 9, dtype=np.uint64)]))
        bits = np.unpackbits((ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b))


def removed(rows, n=13):
    first = {}
    texts = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for i, w in texts:
        for k in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[k : k + n])] = min(i, first.get(tuple(w[k : k + n]), i))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_passages_equal_brute_force(docs, rows, none, monkeypatch):
    found = substring_dedup.remove_passages(docs)
    got = found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted([tuple(r) for r in got], key=str) == removed(rows)
    for r in found.filter("n_removed > 0").collect():
        assert all(f["source"] < r["doc_id"] for f in r["factors"])
    assert substring_dedup.remove_passages(none).collect() == []


def test_passages_of_equal_ids_and_common_phrases(spark):
    """Texts that share an id lose their own repeats only; a phrase that all documents share costs nothing."""
    passage, other = words(30, 21), words(25, 22)
    table = [(1, passage + words(20, 23)), (2, other), (5, words(9, 24) + passage), (5, other), (5, passage), (5, ["short"]), (7, other[:14])]
    phrase = "one phrase of all documents".split()
    table += [(100 + i, words(8, 1000 + i, 9999) + phrase + words(8, 5000 + i, 9999)) for i in range(500)]
    table = [(i, " ".join(t), None, None, None, None) for i, t in table]
    got = substring_dedup.remove_passages(spark.createDataFrame(table, SCHEMA).repartition(6)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    lost = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in got if r["n_removed"]}
    assert lost == {(5, 39): 30, (5, 25): 25, (5, 30): 30, (7, 14): 14}


def test_windows_are_compared_in_full():
    import pyarrow as pa

    rows = [(0, 5, d, 0, [d << 32 | 9, (d % 2) << 62 | 1 << 40]) for d in range(4)]
    batch = pa.RecordBatch.from_pylist([dict(zip(substring_dedup._ROWS.names, r, strict=True)) for r in rows], schema=substring_dedup._ROWS)
    found = [r for b in substring_dedup._settle(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["at"], r["windows"][:3]) for r in found) == [(2, 1, [1, 0, 1]), (3, 1, [1, 1, 1])]


def test_anchors_of_one_document_go_no_further():
    import pyarrow as pa

    rows = [(1, 4), (2, 4), (2, 4), (2, 6), (3, 1), (3, 1), (4, 1), (4, 2), (4, 3), (5, 9)]
    for size in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_pylist([dict(anchor=a, doc_id=d) for a, d in rows[i : i + size]]) for i in range(0, len(rows), size)]
        found = [tuple(r.values()) for b in substring_dedup._repeated(iter(batches)) for r in b.to_pylist()]
        assert found == [(2, 4), (2, 6), (4, 1), (4, 2), (4, 3)]


def test_factors_follow_one_place_and_cover_boundaries():
    spans = [(0, 3, 7, 10), (3, 2, 7, 13), (5, 1, 8, 0), (20, 1, 7, 40)]
    assert substring_dedup.factorise(spans) == [(0, 5, 7, 10), (5, 1, 8, 0), (20, 1, 7, 40)]
    assert substring_dedup.covered(substring_dedup.factorise(spans), 13) == [(0, 18), (20, 33)]
    assert substring_dedup.cut(b" a  b\nc d", [(1, 3)]) == b" a  d"


def test_cover_of_small_groups_in_settling(monkeypatch):
    """One anchor's rows in several groups find the same first places as in one."""
    import pyarrow as pa

    rows = [(0, 5, d, 0, [1, 2, d % 3]) for d in range(9)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(substring_dedup._ROWS.names, r, strict=True))], schema=substring_dedup._ROWS) for r in rows]
    first, again = {}, 0
    for _, _, d, _, windows in rows:
        again += sum(first.setdefault(w, d) < d for w in windows)
    for size in (1, 2, 5, 100):
        monkeypatch.setattr(substring_dedup, "GROUP_ROWS", size)
        parts = [b.to_pylist() for b in substring_dedup._settle(iter(batches))]
        assert sum(r["windows"][0] for part in parts for r in part) == again


def test_mix_meets_targets(spark, docs, none):
    plan = mixing.plan_mix(docs, mixing.Mix(shard_words=9000), keep=lambda d: [d["doc_id"], d["source"]])
    got = plan.rows.toPandas()
    assert len(got) == 17 and plan.shards > 1
    total = got["size"].sum()
    targets = got.groupby("source", dropna=False)["target"].first()
    assert targets.sum() == pytest.approx(min(total, targets.sum())) and (got["taken"] <= 3 * got["size"]).all()
    assert (got["taken"] == got["copies"] * got["size"]).all() and (got["shards"].map(len) == got["copies"]).all()
    again = mixing.plan_mix(docs.repartition(2), mixing.Mix(shard_words=9000), keep=lambda d: [d["doc_id"], d["source"]]).rows.toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.mixed_rows(plan).count() == got["copies"].sum()
    assert mixing.plan_mix(none).rows.collect() == []


def test_targets_share_the_excess():
    sizes, weights = np.array([10, 1000, 500]), np.array([5.0, 2.0, 1.0])
    assert mixing.targets(sizes, weights, 1510.0, 3.0) == pytest.approx([30, 1480 * 2 / 3, 1480 / 3])


def test_leaves_partition_the_quotas():
    quotas = np.array([1000, 3, 0, 77])
    ranges = [mixing.leaf_ranges(quotas, 7, i, 5) for i in range(7)]
    for s in range(4):
        seen = sorted(p for first, n in ranges for p in range(first[s], first[s] + n[s]))
        assert seen == list(range(quotas[s]))
    sizes = [n.sum() for _, n in ranges]
    assert max(sizes) - min(sizes) <= 3


def test_decontamination_tolerates_substitutions(spark, none):
    item = words(30, 20, 10_000)
    bench = spark.createDataFrame([("q", " ".join(item)), ("short", "seven plain words that stand for something"), ("none", None), ("q", " ".join(item))], "item_id string, text string")
    pad = words(50, 21, 10_000)
    changed = list(item)
    changed[7], changed[19] = "other", "thing"
    texts = [pad + item + pad, [w.upper() + "," for w in changed] + pad, pad + item[:9] + pad, "x Seven plain words; that stand for something!".split(), pad, []]
    data = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(9, None)], "doc_id long, text string")
    got = sorted(map(tuple, decontaminate.contaminated(data, bench).collect()))
    assert got == [(0, "q", 50, 0, 30, 30), (1, "q", 0, 0, 30, 28), (3, "short", 1, 0, 7, 7)]
    assert sorted(r["doc_id"] for r in decontaminate.remove_contaminated(data, bench).collect()) == [2, 4, 5, 9]
    assert decontaminate.contaminated(none, bench).collect() == []
    assert decontaminate.contaminated(data, bench.filter("false")).collect() == []


def test_masks_find_most_damaged_windows():
    """Share of 20-token stretches with three substitutions that some mask still hits."""
    rnd, seeds, hits = random.Random(5), decontaminate.Seeds(), 0
    for _ in range(300):
        bad = set(rnd.sample(range(20), 3))
        hits += any(all(m != "1" or at + i not in bad for i, m in enumerate(mask)) for mask in seeds.masks for at in range(20 - seeds.span + 1))
    assert hits / 300 > 0.95


def test_licences(spark, docs, none):
    text = " ".join(words(90, 30)) + "\nReleased under the MIT license!\n" + " ".join(words(90, 31)) + " This work is licensed under the GNU General Public License, version 3. " + " ".join(words(9, 32))
    data = spark.createDataFrame([(1, text), (2, "the MIT License."), (3, None), (4, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["license"], r["at"], r["words"]) for r in licences.scan(data).collect())
    assert got == [(1, "GPL-3.0", 185, 12), (1, "MIT", 90, 5), (4, "CC-BY-NC-4.0", 0, 7)]
    assert licences.scan(docs).count() == 0 and licences.scan(none).collect() == []


def test_every_template_is_found_at_any_offset():
    templates = licences.Templates()
    for (name, text), offset in zip(licences.TEMPLATES * 3, range(3, 1000, 7), strict=False):
        around = " ".join(words(offset, offset))
        assert name in {m[1] for m in licences.matches(templates, [f"{around} {text} {around}".encode(), None])}


def test_language(spark, none):
    de, en = "der die das und ist nicht mit schön", "the and that with this from have which"
    data = spark.createDataFrame([(1, de * 3, "de"), (2, en * 3, "en"), (3, "Und DAS ist schön", None), (4, None, "en"), (5, "123 !?", "de"), (6, en, None)], "doc_id long, text string, lang string")
    profiles = language.learn(data)
    got = {r["doc_id"]: (r["lang_pred"], 0 <= r["score"] <= 1) for r in language.identify(data, profiles).collect()}
    assert got == {1: ("de", True), 2: ("en", True), 3: ("de", True), 4: ("und", True), 5: ("und", True), 6: ("en", True)}
    assert language.identify(data, language.learn(none)).filter("lang_pred <> 'und'").count() == 0


def test_profile_ranks_by_brute_force():
    from collections import Counter

    text = "Ab, abc aé!"
    padded = ["_ab_", "_abc_", "_aé_"]
    count = Counter(g for w in padded for n in (1, 2, 3) for g in (w[i : i + n] for i in range(len(w) - n + 1)) if g.strip("_"))
    assert Counter(language.grams(text).tolist()) == Counter({sum(ord(c if c != "_" else "\x01") << (21 * (len(g) - 1 - i)) for i, c in enumerate(g)): n for g, n in count.items()})


def test_quality(spark, docs, none):
    rnd = random.Random(8)
    good = [" ".join(words(rnd.randrange(5, 90), i)) + "." for i in range(60)]
    bad = [" | ".join(w.upper() + "!!" for w in words(rnd.randrange(5, 90), i)) for i in range(60)]
    rows = [(i, t, int(i < 60)) for i, t in enumerate(good + bad)]
    data = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(quality.vectors(data), data.filter("doc_id % 5 <> 0").union(data.limit(3)))
    got = quality.score(quality.vectors(data), model).collect()
    assert all(r["predicted"] == int(r["doc_id"] < 60) for r in got)
    kept = quality.keep_good(data, model)
    assert kept.columns == data.columns and kept.count() == 60
    assert quality.score(quality.vectors(docs), model).filter("score between 0 and 1").count() == 17
    only = quality.fit(quality.vectors(data), data.filter("label = 1"))
    assert quality.score(quality.vectors(data), only).filter("score < 0.99").count() == 0
    assert quality.score(quality.vectors(none), quality.fit(quality.vectors(none), none)).collect() == []


def test_registered_queries_have_the_contract_columns(spark):
    data = "/root/testdata/sf0.001"
    asked = {
        "op3": "doc_id held_out lang_pred score", "op4": "doc_id held_out score predicted", "op5": "doc_id size source_size target taken",
        "op9": "doc_id n_words n_removed kept_sha256", "op2": "page_id url text n_chars", "op7": "query_id rank vec_id score",
    }
    for name, run in QUERIES.items():
        if columns := asked.get(name.split("_")[0]):
            assert set(columns.split()) <= set(run(spark, data).columns), name
    assert set(ORACLES) <= set(QUERIES) and len({n.split("_")[0] for n in QUERIES}) == 10

"""The operators applied to whole tables, with the result columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm import (
    decontaminate,
    html_text,
    language,
    licences,
    mixing,
    near_duplicates,
    neighbours,
    ngram_join,
    quality,
    revisits,
    substring_dedup,
    token_alignment,
    vector_codes,
)
from postpulse.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def fold(parts: int):
    """Remainder of the CRC of the doc_id's decimal text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query
def op4_quality_discriminant(spark: SparkSession, directory: str) -> DataFrame:
    measured = quality.vectors(table(spark, directory, "documents"))
    labels = table(spark, directory, "labels").filter(fold(5) != 0).withColumn("label", F.col("quality"))
    scored = quality.score(measured, quality.fit(measured, labels))
    return scored.select("doc_id", (F.coalesce(fold(5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")


@query
def op5_mix_sources(spark: SparkSession, directory: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, directory, "documents"), keep=lambda d: [d["doc_id"]])
    return plan.rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


@query
def op6_ngram_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.link(table(spark, directory, "documents"), ngram_join.Rule(words=3, percent=90))


@query
def op8_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query
def op9_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    found = substring_dedup.remove_passages(table(spark, directory, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("factors").alias("n_factors"))


@query
def op3_language_profiles(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    found = language.identify(documents, language.learn(documents.filter(fold(3) != 1)))
    return found.select("doc_id", (F.coalesce(fold(3), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")


@query
def op7_nearest_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    points = neighbours.vectors(table(spark, directory, "embeddings"))
    return neighbours.search(points, points.filter("vec_id % 20 = 0"))


@query
def op1_licence_scan(spark: SparkSession, directory: str) -> DataFrame:
    found = licences.scan(table(spark, directory, "documents"))
    return found.withColumn("containment", F.round("containment", 6))


@query
def op2_html_main_text(spark: SparkSession, directory: str) -> DataFrame:
    return html_text.extract(table(spark, directory, "pages"))


@query
def op11_minhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return near_duplicates.link(table(spark, directory, "documents"))


@query
def op12_token_alignment(spark: SparkSession, directory: str) -> DataFrame:
    return token_alignment.align(table(spark, directory, "documents"))


@query
def op13_vector_codes(spark: SparkSession, directory: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, directory, "embeddings"))
    found = vector_codes.with_label_errors(codes)
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def captures(spark: SparkSession, directory: str) -> DataFrame:
    """Every page as a full response and as a later capture by another spelling of its URL.

    The tables hold no revisits, so these follow from the page number: most
    repeat the page's validators, every fifth has another entity tag, every
    seventh only a date, and every eleventh came before its response.
    """
    pages = table(spark, directory, "pages")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    start = F.expr("timestamp_seconds(1700000000 + page_id * 60)")
    modified = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    full = pages.select(
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("record_id"),
        "url",
        start.alias("date"),
        F.lit(revisits.RESPONSE).alias("kind"),
        F.create_map(
            *[F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60")]
        ).alias("headers"),
    )
    again = F.when(F.col("page_id") % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    own = F.create_map(F.lit("Last-Modified"), modified, F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.col("page_id").cast("string")), F.lit("Content-Type"), F.lit("none"))
    later = pages.select(
        F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("record_id"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"),
        (start + F.when(F.col("page_id") % 11 == 0, F.expr("interval -30 seconds")).otherwise(F.expr("interval 2 days"))).alias("date"),
        F.lit(revisits.REVISIT).alias("kind"),
        F.when(F.col("page_id") % 7 == 0, own).otherwise(F.map_concat(own, F.create_map(F.lit("etag"), again))).alias("headers"),
    )
    return full.union(later)


@query
def op10_revisit_resolution(spark: SparkSession, directory: str) -> DataFrame:
    found = revisits.resolve(captures(spark, directory))
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "url", "status", "response_id", F.array_join(entries, "\n").alias("headers"))


ORACLES["op10_revisit_resolution"] = r"""
with parts as (
    select page_id, html, regexp_replace(url, '#.*$', '') as plain from pages
), split as (
    select page_id, html, regexp_replace(trim(plain), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from parts
), pieces as (
    select page_id, html,
        regexp_replace(regexp_replace(regexp_replace(
            lower(regexp_extract(regexp_replace(rest, '\?.*$', ''), '^([^/]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '') as host,
        regexp_replace(regexp_extract(regexp_replace(rest, '\?.*$', ''), '^[^/]*(.*)$', 1), '/+$', '') as path,
        list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
            lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))) as params
    from split
), named as (
    select page_id, html, host || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as url from pieces
), full_ as (
    select 'r' || page_id as id, url, 1700000000 + page_id * 60 as at, page_id % 28 as day, md5(html) as tag from named
), again as (
    select 'v' || page_id as record_id, page_id, url, page_id % 28 as day, md5(html) as tag,
        1700000000 + page_id * 60 + case when page_id % 11 = 0 then -30 else 172800 end as at
    from named
), joined as (
    select a.record_id, a.page_id, a.url, a.day, a.tag,
        arg_max(struct_pack(id := f.id, day := f.day, tag := f.tag), (f.at, f.id)) as f
    from again a left join full_ f on f.url = a.url and (f.at < a.at or (f.at = a.at and f.id < a.record_id))
    group by all
), judged as (
    select *, case
        when f.id is null then 'missing'
        when page_id % 7 = 0 then case when f.day = day then 'resolved' else 'mismatch' end
        when page_id % 5 = 0 then 'mismatch'
        when f.tag = tag then 'resolved' else 'mismatch' end as status
    from joined
)
select record_id, url, status, case when status = 'resolved' then f.id end as response_id,
    'cache-control: max-age=' || page_id || chr(10)
    || case when status = 'resolved' then 'content-type: text/html' else 'content-type: none' end
    || case when page_id % 7 <> 0 then chr(10) || 'etag: ' || case when page_id % 5 = 0 then '"changed"' else 'W/"' || tag || '"' end
        when status = 'resolved' then chr(10) || 'etag: "' || f.tag || '"' else '' end
    || chr(10) || 'last-modified: day ' || day as headers
from judged
"""

ORACLES["op11_minhash_near_dedup"] = r"""
with recursive texts as materialized (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
    from documents
), grams as materialized (
    select doc_id, list_distinct(case
        when words is null or len(words) = 0 then []
        when len(words) < 5 then [array_to_string(words, ' ')]
        else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as shingles
    from texts
), flat as materialized (
    select doc_id, unnest(shingles) as shingle, len(shingles) as n from grams
), shared as (
    select a.doc_id as u, b.doc_id as v, any_value(a.n) as n, any_value(b.n) as m, count(*) as both_
    from flat a join flat b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), links as materialized (
    select u, v from shared where 100 * both_ >= 85 * (n + m - both_)
), edges as materialized (
    select u, v from links union all select v, u from links
), reach(node, root) as (
    select u, u from edges
    union
    select e.v, r.root from reach r join edges e on e.u = r.node where r.root < e.v
), least as (
    select node, min(root) as root from reach group by node
)
select doc_id, len(shingles) as n_shingles, coalesce(root, doc_id) as component_id, coalesce(root, doc_id) = doc_id as kept
from grams left join least on node = doc_id
"""


def _vector_code_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds written out one after another, every distance in full."""
    steps = [
        """kept as materialized (
    select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), places as (
    select unnest(range(1, (select max(len(v)) + 1 from kept))) as i
), flat as materialized (
    select vec_id, (i - 1) * 4 // len(v) as part, (i - 1) % (len(v) // 4) as position, v[i] as x from kept, places
), first_ids as (
    select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < 256
), book0 as materialized (
    select part, entry, position, x from flat join first_ids using (vec_id)
)"""
    ]
    for step in range(rounds + 1):
        steps.append(
            f"""near{step} as materialized (
    select vec_id, part, min(away * 256 + entry) as best from (
        select f.vec_id, f.part, b.entry, sum((f.x - b.x) * (f.x - b.x)) as away
        from flat f join book{step} b using (part, position) group by all)
    group by all
)"""
        )
        if step < rounds:
            steps.append(
                f"""mean{step} as (
    select part, best % 256 as entry, position, cast(floor(cast(sum(x) as double) / count(*)) as bigint) as x
    from flat join near{step} using (vec_id, part) group by all
), book{step + 1} as materialized (
    select b.part, b.entry, b.position, coalesce(m.x, b.x) as x
    from book{step} b left join mean{step} m on m.part = b.part and m.entry = b.entry and m.position = b.position
)"""
            )
    return f"""with {", ".join(steps)}, coded as materialized (
    select vec_id, string_agg(printf('%02x', cast(best % 256 as integer)), '' order by part) as code, cast(sum(best // 256) as bigint) as error
    from near{rounds} group by vec_id
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
    (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, position)) from book{rounds}) as codebooks_sha256
from coded join kept using (vec_id)
"""


ORACLES["op13_vector_codes"] = _vector_code_sql()

"""The registered queries restated in plain SQL, for an independent engine.

Written apart from the DataFrame code on purpose: where Spark uses hash
thresholds, the SQL ranks rows; where Spark sums over occurrences, the SQL
normalises first.
"""

from __future__ import annotations

import random

from postpulse.functions.labels import PROMPT_HEAD, PROMPT_TAIL
from postpulse.functions.text import STOPWORDS, WIDE_BLANKS

ORACLES: dict[str, str] = {}

# The published Treebank word-splitting patterns one by one, in
# their order; marks that are never part of a kept token become a blank.
TREEBANK_PATTERNS = (
    (r"[«“‘„`]+", " "),
    (r"""([ (\[{<])(?:"|'')""", r"\1 "),
    (r"'([abce-lo-ru-z0-9_])\b", r"' \1"),
    (r"[:,]([^0-9])", r" \1"),
    (r"\.\.+", " "),
    (r"[;@#$%&?!*]", " "),
    (r"[\[\](){}<>]", " "),
    (r"--", " "),
    (r"[»”’]", " "),
    (r"""(?:''|")""", " '' "),
    (r"\.(\s)", r"\1"),
    (r"([^'\s])('s|'m|'d|')\s", r"\1 \2 "),
    (r"([^'\s])('ll|'re|'ve|n't)\s", r"\1 \2 "),
    (r"\b(can)(not)\b", r"\1 \2"),
    (r"\b(gon|wan)(na)\b", r"\1 \2"),
    (r"\b(got)(ta)\b", r"\1 \2"),
    (r"\b(gim|lem)(me)\b", r"\1 \2"),
    (r"\b(d)('ye)\b", r"\1 \2"),
    (r"\b(more)('n)\b", r"\1 \2"),
    (r"(\s't)(is|was)\b", r"\1 \2"),
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(text: str) -> str:
    """The word-splitting patterns as nested SQL replacements."""
    blanks = "".join(f"chr({ord(c)}) || " for c in WIDE_BLANKS)[: -len(" || ")]
    spaced = f"translate(' ' || lower({text}) || ' ', {blanks}, repeat(chr(10), {len(WIDE_BLANKS)}))"
    for pattern, replacement in TREEBANK_PATTERNS:
        spaced = f"regexp_replace({spaced}, {_text(pattern)}, {_text(replacement)}, 'g')"
    return spaced


def _letters(text: str) -> str:
    return f"regexp_replace({_words(text)}, {_text(chr(91) + '^a-z' + chr(39) + chr(92) + 's]+')}, '', 'g')"


def _split(spaced: str) -> str:
    return f"list_filter(string_split_regex({spaced}, '\\s+'), lambda w: w <> '')"


_STOP = "[" + ", ".join(_text(w) for w in STOPWORDS) + "]"

POSTS = """posts AS (
  SELECT source AS subreddit, CAST(doc_id AS VARCHAR) AS ID, split_part(text, chr(10), 1) AS title,
         text AS content, lang, TIMESTAMP '2019-01-01' + to_days(CAST(doc_id % 2000 AS INTEGER)) AS date
  FROM documents)"""
SENTIMENTS = """sentiments AS (
  SELECT CAST(doc_id AS VARCHAR) AS ID,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 0 THEN 'positive' ELSE 'neutral' END AS sentiment
  FROM labels)"""
LABELLED = """labelled AS (
  SELECT p.*, coalesce(s.sentiment, 'neither') AS sentiment FROM posts p LEFT JOIN sentiments s USING (ID))"""
MERGED = """merged AS (
  SELECT * REPLACE (CASE WHEN sentiment = 'neither' THEN 'neutral' ELSE sentiment END AS sentiment) FROM labelled)"""
LISTINGS = """entries AS (
  SELECT *, 10000000 - n_chars AS by_length FROM documents),
seen AS (
  SELECT 'top' AS listing, 'all' AS time_filter, by_length AS position, * FROM entries WHERE lang = 'en' AND n_chars >= 1000
  UNION ALL SELECT 'top', 'year', by_length, * FROM entries WHERE lang = 'en'
  UNION ALL SELECT 'top', 'month', by_length, * FROM entries WHERE n_chars >= 1000
  UNION ALL SELECT 'controversial', 'all', doc_id, * FROM entries WHERE lang = 'de'
  UNION ALL SELECT 'controversial', 'year', doc_id, * FROM entries WHERE lang IN ('de', 'fr')
  UNION ALL SELECT 'controversial', 'month', by_length, * FROM entries WHERE lang = 'fr'
  UNION ALL SELECT 'hot', NULL, by_length, * FROM entries WHERE n_chars < 1000
  UNION ALL SELECT 'rising', NULL, doc_id, * FROM entries WHERE lang = 'es'
  UNION ALL SELECT 'new', NULL, doc_id, * FROM entries),
listings AS (
  SELECT source AS subreddit, listing, time_filter, position, CAST(doc_id AS VARCHAR) AS id,
         split_part(text, chr(10), 1) AS title, CASE WHEN lang = 'fr' THEN '' ELSE text END AS selftext,
         1546300800 + (doc_id % 2000) * 86400 + CAST(0.75 AS DOUBLE) AS created_utc
  FROM seen)"""
FIRST_SEEN = """ranked AS (
  SELECT *, CASE listing || '/' || coalesce(time_filter, '')
      WHEN 'top/all' THEN 0 WHEN 'top/year' THEN 1 WHEN 'top/month' THEN 2
      WHEN 'controversial/all' THEN 3 WHEN 'controversial/year' THEN 4 WHEN 'controversial/month' THEN 5
      WHEN 'hot/' THEN 6 WHEN 'rising/' THEN 7 WHEN 'new/' THEN 8 END AS listing_rank
  FROM listings),
first_seen AS (
  SELECT * FROM ranked
  QUALIFY row_number() OVER (PARTITION BY subreddit, id ORDER BY listing_rank, position) = 1)"""
NO_BODY = """raw AS (
  SELECT p.lang, p.ID, CASE WHEN p.lang = 'de' THEN NULL ELSE title END AS title,
         CASE WHEN s.sentiment IS NULL THEN NULL ELSE content END AS content,
         strftime(date, '%Y-%m-%d %H:%M:%S') AS date
  FROM posts p LEFT JOIN sentiments s USING (ID))"""
MARKED = """marked AS (
  SELECT * REPLACE (replace(content, chr(10), '&#x200B;' || chr(10)) || '&#x200B;' AS content) FROM posts)"""
TEXTS = """texts AS (
  SELECT subreddit, ID, date, title || ' ' ||
         replace(replace(replace(content, ' and ', ' don''t '), ' of ', ' it''s '), ' to ', ' cannot ') AS text
  FROM posts)"""
DOCS = f"""docs AS MATERIALIZED (
  SELECT subreddit, ID, date, list_filter({_split(_letters("text"))}, lambda w: NOT list_contains({_STOP}, w)) AS tokens
  FROM texts)"""
SCORED = """scored AS (
  SELECT o_orderkey AS ID, o_orderpriority AS subreddit, o_orderdate AS date,
         CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 0 WHEN 'P' THEN 1 END AS label
  FROM orders)"""
MONTHS = """months AS (
  SELECT {by} last_day(date) AS month, nullif(count(*) FILTER (WHERE label = -1), 0) AS neg,
         nullif(count(*) FILTER (WHERE label = 0), 0) AS neu, nullif(count(*) FILTER (WHERE label = 1), 0) AS pos
  FROM {scored} GROUP BY ALL),
complete AS (SELECT * FROM months WHERE neg IS NOT NULL AND neu IS NOT NULL AND pos IS NOT NULL),
shares AS (
  SELECT {by} month, neg / (neg + neu + pos) AS neg, neu / (neg + neu + pos) AS neu, pos / (neg + neu + pos) AS pos,
         neg + neu + pos AS total, CAST(epoch(CAST(month AS TIMESTAMP)) AS BIGINT) AS epoch_s
  FROM complete)"""
# Student t by the finite sums; the oracle data never reach tiny p-values
REGRESSION = """points AS (
  SELECT {by} 'neg' AS series, CAST(epoch_s AS DOUBLE) AS x, neg AS y FROM shares
  UNION ALL SELECT {by} 'pos', CAST(epoch_s AS DOUBLE), pos FROM shares),
fits AS (
  SELECT {by} series, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
         corr(y, x) AS r, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy
  FROM points GROUP BY ALL),
tested AS (
  SELECT *, n - 2 AS df, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(n - 2)) AS theta FROM fits),
summed AS (
  SELECT *, CASE WHEN df % 2 = 0
    THEN sin(theta) * (1 + coalesce(list_sum(list_transform(range(2, df, 2), lambda k:
           list_product(list_transform(range(2, k + 1, 2), lambda j: (j - 1) / j)) * pow(cos(theta), k))), 0))
    ELSE 2 / pi() * (theta + CASE WHEN df = 1 THEN 0 ELSE sin(theta) * (cos(theta)
           + coalesce(list_sum(list_transform(range(3, df, 2), lambda k: cos(theta)
           * list_product(list_transform(range(3, k + 1, 2), lambda j: (j - 1) / j)) * pow(cos(theta), k - 1))), 0)) END)
    END AS inside
  FROM tested)"""
REGRESSION_ROWS = """SELECT {by} series, n, round(slope * 31557600, 6) AS slope_per_year,
       round(intercept, 6) AS intercept, round(r, 6) AS r, round(1 - inside, 6) AS pvalue,
       round(sqrt((1 - r * r) * syy / sxx / df) * 31557600, 6) AS stderr_per_year
FROM summed"""
TF = """tf AS MATERIALIZED (
  SELECT subreddit, ID, term, count(*) AS tf
  FROM (SELECT subreddit, ID, unnest(tokens) AS term FROM docs) GROUP BY ALL)"""
# training side: the four fifths of labelled documents with the highest hashes
CNB = """joined AS MATERIALIZED (
  SELECT d.*, s.sentiment, md5('0|' || d.subreddit || '|' || d.ID) AS h FROM docs d JOIN sentiments s USING (ID)),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY h) <= ceil(0.2 * count(*) OVER ()) AS held_out FROM joined),
tf AS MATERIALIZED (
  SELECT ID, sentiment, term, count(*) AS tf
  FROM (SELECT ID, sentiment, unnest(tokens) AS term FROM placed WHERE NOT held_out) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM placed WHERE NOT held_out),
vocabulary AS MATERIALIZED (
  SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n WHERE df >= 2 AND df <= 0.9 * n),
weighed AS MATERIALIZED (
  SELECT sentiment, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY ID)) AS weight
  FROM tf JOIN vocabulary USING (term)),
sums AS (
  SELECT term, sum(weight) AS every, coalesce(sum(weight) FILTER (WHERE sentiment = 'negative'), 0) AS neg,
         coalesce(sum(weight) FILTER (WHERE sentiment = 'neutral'), 0) AS neu,
         coalesce(sum(weight) FILTER (WHERE sentiment = 'positive'), 0) AS pos
  FROM weighed GROUP BY term),
totals AS (
  SELECT sum(every - neg + 1) AS neg, sum(every - neu + 1) AS neu, sum(every - pos + 1) AS pos FROM sums),
model AS MATERIALIZED (
  SELECT term, df, idf, -ln((every - s.neg + 1) / t.neg) AS w_negative,
         -ln((every - s.neu + 1) / t.neu) AS w_neutral, -ln((every - s.pos + 1) / t.pos) AS w_positive
  FROM sums s JOIN vocabulary USING (term), totals t)"""
GUESSED = """scores AS (
  SELECT ID, sum(idf * w_negative) AS neg, sum(idf * w_neutral) AS neu, sum(idf * w_positive) AS pos
  FROM (SELECT ID, unnest(tokens) AS term FROM docs) JOIN model USING (term) GROUP BY ID),
guessed AS (
  SELECT d.subreddit, d.ID, d.date,
         CASE WHEN s.ID IS NULL OR neg >= greatest(neu, pos) THEN 'negative'
              WHEN neu >= pos THEN 'neutral' ELSE 'positive' END AS predicted
  FROM docs d LEFT JOIN scores s USING (ID))"""
VALIDATED = """validated AS (
  SELECT g.subreddit, g.ID, p.sentiment AS actual, g.predicted
  FROM guessed g JOIN placed p USING (ID) WHERE p.held_out)"""
LEXICON = """words AS MATERIALIZED (SELECT DISTINCT unnest(tokens) AS token FROM docs),
lexicon AS MATERIALIZED (
  SELECT token, CASE WHEN suffix(token, 'ing') THEN 'VBG' WHEN suffix(token, 'est') THEN 'JJS'
                     WHEN suffix(token, 'ly') THEN 'RB' WHEN suffix(token, 'th') THEN 'IN'
                     WHEN suffix(token, 's') THEN 'NNS' ELSE 'NN' END AS tag,
         regexp_replace(token, '(.)(ing|est|ly|th|s)$', '\\1') AS lemma
  FROM words)"""
CHAT = """chat AS (
  SELECT 'chat-' || role AS subreddit, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS ID,
         split_part(text, chr(10), 1) AS title, text AS content, CAST(NULL AS TIMESTAMP) AS date
  FROM conversations)"""
EVENTS = """scored AS (
  SELECT ts AS date, CASE WHEN event_type = 'error' THEN -1 WHEN event_type IN ('view', 'click') THEN 0
                          WHEN event_type IN ('purchase', 'signup') THEN 1 END AS label
  FROM events)"""

_POST = (
    "subreddit, ID, title, md5(content) AS content_md5, strftime(date, '%Y-%m-%d %H:%M:%S') AS date"
)
_LISTING_POST = (
    "subreddit, id AS ID, title, md5(nullif(selftext, '')) AS content_md5, "
    "strftime(make_timestamp(CAST(floor(created_utc) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS date"
)
_TOKENS = "array_to_string({0}, ' ') AS tokens, len({0}) AS n_tokens"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _add(name: str, sql: str) -> None:
    ORACLES[name] = sql


_add(
    "scan_listings",
    _with(LISTINGS)
    + "SELECT subreddit, listing, time_filter, position, id, title, md5(selftext) AS selftext_md5, created_utc FROM listings",
)
_add("read_posts_na", _with(POSTS, SENTIMENTS, NO_BODY) + "SELECT ID, title, md5(content) AS content_md5, date FROM raw")
_add(
    "read_whole_posts",
    _with(POSTS)
    + """, quoted AS (
  SELECT ID, '"' || title AS title, nullif(replace(content, chr(10), chr(13) || chr(10) || '"'), '') AS content, date FROM posts)
SELECT ID, title, length(content) AS n_chars, md5(content) AS content_md5, strftime(date, '%Y-%m-%d %H:%M:%S') AS date
FROM quoted""",
)
_add(
    "read_source_files",
    _with(POSTS, SENTIMENTS, NO_BODY)
    + "SELECT lang AS subreddit, ID, title, md5(content) AS content_md5, date FROM raw "
    "WHERE title IS NOT NULL AND content IS NOT NULL",
)
_add("append_idempotent", _with(LISTINGS, FIRST_SEEN) + f"SELECT {_LISTING_POST} FROM first_seen")
_add("stream_ingest_posts", ORACLES["append_idempotent"])
_CLEANED = "replace(left(content, 1000), '&#x200B;', '')"
_add(
    "export_round_trip",
    _with(POSTS, MARKED)
    + f"SELECT ID, nullif(title, '') AS title, md5(nullif({_CLEANED}, '')) AS content_md5, "
    "strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM marked",
)
_add("project_posts", _with(LISTINGS) + f"SELECT {_LISTING_POST} FROM listings")
_add(
    "epoch_to_utc",
    _with(LISTINGS)
    + "SELECT id, listing, time_filter, strftime(make_timestamp(CAST(floor(created_utc) AS BIGINT) * 1000000), "
    "'%Y-%m-%d %H:%M:%S') AS date FROM listings",
)
_add(
    "default_body",
    _with(LISTINGS)
    + "SELECT id, listing, time_filter, md5(CASE WHEN selftext IS NULL OR selftext = '' THEN 'N/A' ELSE selftext END) "
    "AS body_md5 FROM listings",
)
_add(
    "drop_missing",
    _with(POSTS, SENTIMENTS, NO_BODY)
    + "SELECT ID, title, md5(content) AS content_md5 FROM raw WHERE title IS NOT NULL AND content IS NOT NULL",
)
_add(
    "truncate_body",
    _with(POSTS)
    + "SELECT ID, length(left(content, 1000)) AS n_chars, md5(left(content, 1000)) AS body_md5 FROM posts",
)
_add(
    "strip_entity",
    _with(POSTS, MARKED)
    + "SELECT ID, length(replace(content, '&#x200B;', '')) AS n_chars, "
    "md5(replace(content, '&#x200B;', '')) AS body_md5 FROM marked",
)
_add(
    "clean_posts",
    _with(POSTS, MARKED)
    + f"SELECT subreddit, ID, title, md5({_CLEANED}) AS content_md5, strftime(date, '%Y-%m-%d %H:%M:%S') AS date "
    "FROM marked WHERE title IS NOT NULL AND content IS NOT NULL",
)
_add("route_analysis", _with(POSTS) + f"SELECT {_POST} FROM posts WHERE subreddit = 'src0'")
_add("route_training", _with(POSTS) + f"SELECT {_POST} FROM posts WHERE subreddit <> 'src0'")
_add(
    "combined_text",
    _with(POSTS)
    + "SELECT ID, length(title || ' ' || content) AS n_chars, md5(title || ' ' || content) AS text_md5 FROM posts",
)
_PROMPT = f"{_text(PROMPT_HEAD)} || title || ' ' || content || {_text(PROMPT_TAIL)}"
_add(
    "label_prompt",
    _with(POSTS) + f"SELECT ID, length({_PROMPT}) AS n_chars, md5({_PROMPT}) AS prompt_md5 FROM posts",
)
_add(
    "normalise_label",
    """WITH answers AS (
  SELECT event_id, concat_ws(' ', CASE event_type WHEN 'purchase' THEN 'Positive! Not negative.'
           WHEN 'error' THEN 'I''d say NEGATIVE, perhaps neutral' WHEN 'view' THEN 'neutral_ish or positives'
           WHEN 'click' THEN ' Neutral' || chr(10) END, event_type, props) AS answer
  FROM events)
SELECT event_id, coalesce(nullif(regexp_extract(lower(answer), '\\b(negative|neutral|positive)\\b', 1), ''), 'neither')
       AS sentiment FROM answers""",
)
_add(
    "label_posts",
    _with(POSTS)
    + """, hits AS (
  SELECT subreddit, ID, regexp_extract(lower(title || ' ' || content),
         '\\b(bad|fail|good|great|happy|hate|love|terrible|thanks|worthless)\\b', 1) AS hit FROM posts)
SELECT subreddit, ID, CASE WHEN hit IN ('great', 'good', 'happy', 'love', 'thanks') THEN 'positive'
       WHEN hit = '' THEN 'neutral' ELSE 'negative' END AS sentiment FROM hits""",
)
_add(
    "labelled_round_trip",
    ORACLES["label_posts"].replace(
        "SELECT subreddit, ID, CASE WHEN hit",
        "SELECT ID, nullif(p.title, '') AS title, md5(nullif(p.content, '')) AS content_md5, "
        "strftime(p.date, '%Y-%m-%d %H:%M:%S') AS date, CASE WHEN hit",
    )
    + " JOIN posts p USING (subreddit, ID)",
)
_add("merge_neither", _with(POSTS, SENTIMENTS, LABELLED, MERGED) + "SELECT subreddit, ID, sentiment FROM merged")
_add(
    "merge_neither_compat",
    _with(POSTS, SENTIMENTS, LABELLED)
    + """SELECT CASE WHEN sentiment = 'neither' THEN 'neutral' ELSE subreddit END AS subreddit,
       CASE WHEN sentiment = 'neither' THEN 'neutral' ELSE ID END AS ID,
       CASE WHEN sentiment = 'neither' THEN 'neutral' ELSE title END AS title,
       md5(CASE WHEN sentiment = 'neither' THEN 'neutral' ELSE content END) AS content_md5,
       CASE WHEN sentiment = 'neither' THEN 'neutral' ELSE strftime(date, '%Y-%m-%d %H:%M:%S') END AS date,
       CASE WHEN sentiment = 'neither' THEN 'neutral' ELSE sentiment END AS sentiment
FROM labelled""",
)
_add(
    "class_filter",
    _with(POSTS, SENTIMENTS, LABELLED)
    + "SELECT subreddit, ID, sentiment FROM labelled WHERE sentiment IN ('positive', 'negative')",
)
_add(
    "label_numeric",
    _with(POSTS, SENTIMENTS, LABELLED)
    + "SELECT ID, CAST(CASE sentiment WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 WHEN 'positive' THEN 1 END AS DOUBLE) "
    "AS label FROM labelled",
)
_add(
    "dedupe_first_seen",
    _with(LISTINGS, FIRST_SEEN)
    + "SELECT subreddit, id, listing, time_filter, listing_rank, position, md5(selftext) AS selftext_md5 FROM first_seen",
)
_add("stream_sightings", ORACLES["dedupe_first_seen"])
_add(
    "limit_per_listing",
    _with(LISTINGS)
    + "SELECT subreddit, listing, time_filter, position, id FROM listings "
    "QUALIFY row_number() OVER (PARTITION BY subreddit, listing, time_filter ORDER BY position, id) <= 10",
)
_add(
    "new_posts_anti",
    _with(POSTS) + f"SELECT {_POST} FROM posts WHERE ID NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
)
_add(
    "union_sources",
    _with(POSTS, CHAT) + f"SELECT {_POST} FROM posts UNION ALL SELECT {_POST} FROM chat",
)
_TRIMMED = "regexp_replace(lower(chr(10) || ' ' || text || ' ' || chr(9)), '^\\s+|\\s+$', '', 'g')"
_add(
    "lower_trim",
    _with(POSTS, TEXTS) + f"SELECT ID, length({_TRIMMED}) AS n_chars, md5({_TRIMMED}) AS text_md5 FROM texts",
)
for _name, _expression in (
    ("tokenise", _split(_words("text"))),
    ("strip_special", _split(_letters("text"))),
    ("remove_stopwords", f"list_filter({_split(_letters('text'))}, lambda w: NOT list_contains({_STOP}, w))"),
):
    _add(
        _name,
        _with(POSTS, TEXTS, f"cut AS (SELECT subreddit, ID, {_expression} AS t FROM texts)")
        + f"SELECT subreddit, ID, {_TOKENS.format('t')} FROM cut",
    )
_add("normalise_tokens", _with(POSTS, TEXTS, DOCS) + f"SELECT subreddit, ID, {_TOKENS.format('tokens')} FROM docs")
_add(
    "map_pos",
    _with(POSTS, TEXTS, DOCS, LEXICON)
    + "SELECT token, tag, CASE left(tag, 1) WHEN 'J' THEN 'a' WHEN 'N' THEN 'n' WHEN 'R' THEN 'r' WHEN 'V' THEN 'v' END "
    "AS pos FROM lexicon",
)
_add(
    "lemmatise_lookup",
    _with(POSTS, TEXTS, DOCS, LEXICON)
    + """, placed AS (
  SELECT subreddit, ID, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM docs),
swapped AS (
  SELECT subreddit, ID, pos, CASE WHEN tag = 'IN' THEN token ELSE lemma END AS word FROM placed JOIN lexicon USING (token)),
rebuilt AS (SELECT subreddit, ID, list(word ORDER BY pos) AS words FROM swapped GROUP BY ALL)
SELECT d.subreddit, d.ID, coalesce(array_to_string(words, ' '), '') AS tokens, coalesce(len(words), 0) AS n_tokens
FROM docs d LEFT JOIN rebuilt USING (subreddit, ID)""",
)
_add("lemmatise_join", ORACLES["lemmatise_lookup"])
_add(
    "ngrams",
    _with(
        POSTS,
        TEXTS,
        DOCS,
        """grams AS (
  SELECT subreddit, ID, list_concat(tokens, list_transform(range(1, len(tokens)),
         lambda i: tokens[i] || ' ' || tokens[i + 1])) AS t FROM docs)""",
    )
    + f"SELECT subreddit, ID, {_TOKENS.format('t')} FROM grams",
)
_add("term_freq", _with(POSTS, TEXTS, DOCS, TF) + "SELECT subreddit, ID, term, tf FROM tf")
_add(
    "doc_freq_pruned",
    _with(POSTS, TEXTS, DOCS, TF)
    + "SELECT term, count(*) AS df FROM tf GROUP BY term "
    "HAVING count(*) >= 3 AND count(*) <= 0.7 * (SELECT count(*) FROM docs)",
)
_add(
    "tfidf",
    _with(
        POSTS,
        TEXTS,
        DOCS,
        TF,
        """vocabulary AS (
  SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), (SELECT count(*) AS n FROM docs)
  WHERE df >= 2 AND df <= 0.9 * n)""",
    )
    + """SELECT subreddit, ID, term, tf,
       round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY subreddit, ID)), 6) AS weight
FROM tf JOIN vocabulary USING (term)""",
)
_add(
    "label_distribution",
    _with(POSTS, SENTIMENTS, LABELLED) + "SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment",
)
_HASH = "md5('0|' || subreddit || '|' || ID)"
_DRAWN = f"""drawn AS (
  SELECT subreddit, ID, sentiment FROM merged WHERE sentiment = 'neutral'
  QUALIFY row_number() OVER (ORDER BY {_HASH}) <= (SELECT count(*) FROM merged WHERE sentiment = 'positive'))"""
_add("undersample", _with(POSTS, SENTIMENTS, LABELLED, MERGED, _DRAWN) + "SELECT * FROM drawn")
_add(
    "balanced_set",
    _with(POSTS, SENTIMENTS, LABELLED, MERGED, _DRAWN)
    + "SELECT * FROM drawn UNION ALL SELECT subreddit, ID, sentiment FROM merged "
    "WHERE sentiment IN ('positive', 'negative')",
)
_add(
    "split_80_20",
    _with(POSTS)
    + f"SELECT subreddit, ID, CASE WHEN row_number() OVER (ORDER BY {_HASH}) <= ceil(0.2 * count(*) OVER ()) "
    "THEN 'valid' ELSE 'train' END AS side FROM posts",
)
_add(
    "split_by_hash",
    _with(POSTS)
    + f"SELECT subreddit, ID, CASE WHEN left({_HASH}, 8) < '33333333' THEN 'valid' ELSE 'train' END AS side FROM posts",
)
_add(
    "stratified_folds",
    _with(POSTS, SENTIMENTS, LABELLED)
    + f"SELECT subreddit, ID, sentiment, ntile(5) OVER (PARTITION BY sentiment ORDER BY {_HASH}) - 1 AS fold FROM labelled",
)
_add(
    "class_weights",
    _with(POSTS, SENTIMENTS, LABELLED)
    + """SELECT sentiment, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
FROM (SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment)""",
)
_MODEL = (POSTS, TEXTS, DOCS, SENTIMENTS, CNB)
_add(
    "cnb_weights",
    _with(*_MODEL)
    + "SELECT term, df, round(idf, 6) AS idf, round(w_negative, 6) AS w_negative, round(w_neutral, 6) AS w_neutral, "
    "round(w_positive, 6) AS w_positive FROM model",
)
_VALID = (*_MODEL, GUESSED, VALIDATED)
_add("cnb_predict", _with(*_VALID) + "SELECT subreddit, ID, actual, predicted FROM validated")
_add("model_round_trip", ORACLES["cnb_predict"])
# 100 different settings out of 2 x 6 x 4 x 4, by their number, with the library's seed
_DRAWN = ", ".join(
    f"({draw}, {(1, 2)[i % 2]}, {(0.2, 0.4, 0.7, 0.8, 0.9, 1.0)[i // 2 % 6]}::DOUBLE, "
    f"{(1, 3, 5, 10)[i // 12 % 4]}, {(1.0, 0.1, 0.01, 0.001)[i // 48]}::DOUBLE)"
    for draw, i in enumerate(random.Random(0).sample(range(192), 100))
)
_add(
    "param_search",
    _with(POSTS, TEXTS, DOCS, SENTIMENTS, CNB.split(",\ntf AS")[0])
    + f""", draws(draw, ngram_max, max_df, min_df, alpha) AS (VALUES {_DRAWN}),
combos AS MATERIALIZED (
  SELECT row_number() OVER () AS s, * FROM (SELECT DISTINCT ngram_max, max_df, min_df FROM draws)),
train AS MATERIALIZED (
  SELECT ID, sentiment, tokens, ntile(5) OVER (PARTITION BY sentiment ORDER BY h) - 1 AS fold FROM placed WHERE NOT held_out),
folds AS MATERIALIZED (
  SELECT f.fold AS f, (SELECT count(*) FROM train WHERE fold <> f.fold) AS n FROM (SELECT DISTINCT fold FROM train) f),
spelled AS MATERIALIZED (
  SELECT ID, unnest(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS word
  FROM train),
terms AS MATERIALIZED (
  SELECT word, contains(word, ' ') AS pair, row_number() OVER () AS term FROM (SELECT DISTINCT word FROM spelled)),
people AS MATERIALIZED (SELECT ID, fold, sentiment, row_number() OVER () AS doc FROM train),
grams AS MATERIALIZED (
  SELECT doc, fold, sentiment, term, pair, count(*) AS tf
  FROM spelled JOIN terms USING (word) JOIN people USING (ID) GROUP BY ALL),
listed AS MATERIALIZED (
  SELECT f, s, term, df, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT f, n, term, any_value(pair) AS pair, count(*) AS df FROM grams JOIN folds ON fold <> f GROUP BY f, n, term)
  JOIN combos ON df >= min_df AND df <= max_df * n AND (ngram_max = 2 OR NOT pair)),
lengths AS MATERIALIZED (
  SELECT f, s, doc, sentiment, sqrt(sum(tf * idf * tf * idf)) AS length, sum(tf * idf) AS total
  FROM grams JOIN listed USING (term) WHERE fold <> f GROUP BY f, s, doc, sentiment),
-- a term that one document holds has no part in another one's score, only in the totals
met AS (SELECT term FROM grams GROUP BY term HAVING count(*) > 1),
sums AS MATERIALIZED (
  SELECT f, s, term, any_value(idf) AS idf, sum(tf * idf / length) AS every,
         sum(CASE WHEN g.sentiment = 'negative' THEN tf * idf / length ELSE 0 END) AS neg,
         sum(CASE WHEN g.sentiment = 'neutral' THEN tf * idf / length ELSE 0 END) AS neu,
         sum(CASE WHEN g.sentiment = 'positive' THEN tf * idf / length ELSE 0 END) AS pos
  FROM grams g JOIN met USING (term) JOIN listed USING (term) JOIN lengths USING (f, s, doc) WHERE fold <> f GROUP BY f, s, term),
sizes AS (SELECT f, s, count(*) AS v FROM listed GROUP BY f, s),
wholes AS (
  SELECT f, s, sum(total / length) FILTER (WHERE sentiment <> 'negative') AS neg,
         sum(total / length) FILTER (WHERE sentiment <> 'neutral') AS neu,
         sum(total / length) FILTER (WHERE sentiment <> 'positive') AS pos FROM lengths GROUP BY f, s),
models AS MATERIALIZED (
  SELECT f, draw, s, alpha, neg + alpha * v AS neg, neu + alpha * v AS neu, pos + alpha * v AS pos
  FROM wholes JOIN sizes USING (f, s) JOIN combos USING (s) JOIN draws USING (ngram_max, max_df, min_df)),
scores AS (
  SELECT draw, doc, sum(tf * idf * -ln((every - u.neg + alpha) / m.neg)) AS neg,
         sum(tf * idf * -ln((every - u.neu + alpha) / m.neu)) AS neu, sum(tf * idf * -ln((every - u.pos + alpha) / m.pos)) AS pos
  FROM grams JOIN sums u USING (term) JOIN models m USING (f, s) WHERE fold = f GROUP BY draw, doc),
judged AS (
  SELECT draw, fold, sentiment = CASE WHEN neg IS NULL OR neg >= greatest(neu, pos) THEN 'negative'
         WHEN neu >= pos THEN 'neutral' ELSE 'positive' END AS hit
  FROM people CROSS JOIN draws LEFT JOIN scores USING (draw, doc)),
by_fold AS (SELECT draw, fold, avg(hit::INT) AS accuracy FROM judged GROUP BY draw, fold)
SELECT draw, ngram_max, max_df, min_df, alpha, round(avg(accuracy), 6) AS mean_accuracy
FROM by_fold JOIN draws USING (draw) GROUP BY ALL""",
)
_SPINE = "(SELECT unnest(['negative', 'neutral', 'positive']) AS {0})"
_add(
    "confusion_matrix",
    _with(*_VALID)
    + f"""SELECT s.actual, count(*) FILTER (WHERE predicted = 'negative') AS negative,
       count(*) FILTER (WHERE predicted = 'neutral') AS neutral, count(*) FILTER (WHERE predicted = 'positive') AS positive
FROM {_SPINE.format('actual')} s LEFT JOIN validated v USING (actual) GROUP BY s.actual""",
)
_add(
    "confusion_long",
    _with(*_VALID)
    + f"""SELECT a.actual, p.predicted, count(v.ID) AS n
FROM {_SPINE.format('actual')} a CROSS JOIN {_SPINE.format('predicted')} p
LEFT JOIN validated v ON v.actual = a.actual AND v.predicted = p.predicted GROUP BY ALL""",
)
_add(
    "accuracy",
    _with(*_VALID)
    + "SELECT count(*) AS n, count(*) FILTER (WHERE actual = predicted) AS correct, "
    "round(count(*) FILTER (WHERE actual = predicted) / count(*), 6) AS accuracy FROM validated",
)
_add(
    "micro_f1",
    _with(*_VALID)
    + """, pooled AS (
  SELECT sum((actual = c AND predicted = c)::INT)::BIGINT AS tp, sum((actual <> c AND predicted = c)::INT)::BIGINT AS fp,
         sum((actual = c AND predicted <> c)::INT)::BIGINT AS fn
  FROM validated, (SELECT unnest(['negative', 'neutral', 'positive']) AS c))
SELECT tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1 FROM pooled""",
)
_NUMERIC = "CASE predicted WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END AS label"
_add(
    "score_posts",
    _with(*_MODEL, GUESSED)
    + f"SELECT subreddit, ID, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, {_NUMERIC} FROM guessed",
)
_GLOBAL = MONTHS.format(by="", scored="scored")
_add(
    "monthly_counts",
    _with(SCORED, _GLOBAL)
    + "SELECT month, CAST(neg AS DOUBLE) AS neg, CAST(neu AS DOUBLE) AS neu, CAST(pos AS DOUBLE) AS pos FROM months",
)
_add("monthly_complete", _with(SCORED, _GLOBAL) + "SELECT * FROM complete")
_add(
    "monthly_proportions",
    _with(SCORED, _GLOBAL)
    + "SELECT month, round(neg, 6) AS neg, round(neu, 6) AS neu, round(pos, 6) AS pos, total, epoch_s FROM shares",
)
_add(
    "trend_regression",
    _with(SCORED, _GLOBAL, REGRESSION.format(by="")) + REGRESSION_ROWS.format(by=""),
)
_BY = "subreddit,"
_add(
    "trend_by_source",
    _with(SCORED, MONTHS.format(by=_BY, scored="scored"), REGRESSION.format(by=_BY)) + REGRESSION_ROWS.format(by=_BY),
)
_add(
    "scored_trend",
    _with(
        *_MODEL,
        GUESSED,
        f"labelled_docs AS (SELECT date, {_NUMERIC} FROM guessed)",
        MONTHS.format(by="", scored="labelled_docs"),
        REGRESSION.format(by=""),
    )
    + REGRESSION_ROWS.format(by=""),
)
_add(
    "date_histogram",
    _with(SCORED)
    + """, micros AS (SELECT epoch_us(date) AS us FROM scored WHERE date IS NOT NULL),
ends AS (SELECT min(us) AS lo, max(us) AS hi FROM micros),
counts AS (
  SELECT least(128, CAST(floor((us - lo) * CAST(128 AS DOUBLE) / (hi - lo)) AS INTEGER) + 1) AS bin, count(*) AS n
  FROM micros, ends GROUP BY ALL)
SELECT CAST(b.bin AS INTEGER) AS bin,
       round((lo + (b.bin - 1) * (hi - lo) / CAST(128 AS DOUBLE)) / 1000000, 6) AS bin_start_s, coalesce(n, 0) AS n
FROM range(1, 129) b(bin) LEFT JOIN counts c ON c.bin = b.bin, ends""",
)
_add(
    "sort_by_date",
    _with(SCORED) + "SELECT ID, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, label FROM scored ORDER BY date",
)
_add(
    "number_by_date",
    _with(SCORED)
    + "SELECT row_number() OVER (ORDER BY date NULLS LAST, ID) - 1 AS row_number, ID, "
    "strftime(date, '%Y-%m-%d %H:%M:%S') AS date, label FROM scored",
)
_DAILY = """SELECT CAST(date AS DATE) AS day, count(*) FILTER (WHERE label = -1) AS neg,
       count(*) FILTER (WHERE label = 0) AS neu, count(*) FILTER (WHERE label = 1) AS pos
FROM scored GROUP BY 1"""
_add("daily_counts", _with(EVENTS) + _DAILY)
_add("stream_counts", _with(EVENTS) + _DAILY)

"""Resolving not-modified revisit records of web archives.

A capture answered with "not modified" has no payload.  It stands for the latest
earlier full response of the same canonical URL, if the validators agree, with
the header fields that a not-modified answer may update taken from it.

The as-of join sorts the captures by range of (URL, time, record), so a URL with
a third of all captures is spread over many tasks.  Each task carries the last
response forward through its range; the few revisits at the start of a range
whose response lies in an earlier one receive what the ranges before hand over
(one row per range).  Payloads are not sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.llm.tables import stored

# Fields that a not-modified answer may update, and query parameters that only track visits.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[^=]*|fbclid|gclid|ref)(=|$)"

RESPONSE, REVISIT = "response", "revisit"
# Rows of one range; a fineness, not a limit.
RANGE_ROWS = 100_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, scheme, user, default port, fragment, tracking and final slash; parameters sorted."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    plain = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_replace(plain, r"\?.*$", "")
    host = F.lower(F.regexp_extract(place, r"^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(.*)$", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def lower_names(headers: Column) -> Column:
    """Field names in lower case; of fields that differ in case only, the first in name order."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.filter(entries, lambda e: F.lower(e["key"]) == n)[0]["value"]))


def weak(etag: Column) -> Column:
    """Entity tags are compared weakly."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


_STATE = ("record_id", "etag", "last_modified")


def _carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last response before every revisit of a sorted range, and what the range hands over."""
    part = TaskContext.get().partitionId()
    url, state, rows = None, None, 0
    first_url = None
    for frame in frames:
        if not len(frame):
            continue
        rows += len(frame)
        urls = frame["url"].to_numpy(object)
        first_url = urls[0] if first_url is None else first_url
        full = (frame["kind"] == RESPONSE).to_numpy()
        index = np.arange(len(frame))
        change = np.concatenate([[urls[0] != url], urls[1:] != urls[:-1]])
        begin = np.maximum.accumulate(np.where(change, index, 0))
        last = np.maximum.accumulate(np.where(full, index, -1))
        # a capture sees responses before it only
        before = np.concatenate([[-1], last[:-1]])
        known = before >= begin
        carried = ~known & (begin == 0) & (not change[0]) & (state is not None)
        out = frame[~full][["record_id", "url", "etag", "last_modified", "updates"]].copy()
        pick = before[~full]
        for name in _STATE:
            column = frame[name].to_numpy(object)
            values = np.where(known[~full], column[np.maximum(pick, 0)], None)
            if state is not None:
                values = np.where(carried[~full], state[name], values)
            out[f"response_{name}"] = values
        # without a response so far the first URL of the range may have one in an earlier range
        out["range"] = np.where(out["response_record_id"].isna() & (out["url"] == first_url), part, -1)
        out["tail"] = False
        yield out
        if urls[-1] != url:
            state = None
        url = urls[-1]
        if last[-1] >= begin[-1]:
            state = {name: frame[name].iloc[last[-1]] for name in _STATE}
    if rows:
        tail = {"record_id": None, "url": url, "etag": first_url, "last_modified": None, "updates": None, "range": part, "tail": True}
        tail |= {f"response_{n}": state[n] if state else None for n in _STATE}
        yield pd.DataFrame([tail])


def resolve(captures: DataFrame) -> DataFrame:
    """(record_id, url, status, response_id, headers) of every revisit in ``captures``.

    ``captures`` has record_id (string), url, date (timestamp), kind (``response``
    or ``revisit``) and headers (map of strings).  ``url`` of the result is
    canonical.  Earlier means by (date, record_id).  ``status`` is

    * ``resolved``: entity tags agree weakly, or, if one is missing, the
      Last-Modified dates agree;
    * ``unvalidated``: there is nothing to compare;
    * ``mismatch``: the validators differ, the payload has changed in between;
    * ``missing``: no earlier full response, or no URL or date to look by.

    The first two have ``response_id`` and ``headers``: those of the response with
    the permitted fields of the revisit over them; otherwise ``headers`` are the
    revisit's own.  Repeated revisits stay repeated, repeated responses count
    once.  Responses without id, URL or date resolve nothing.  Null headers are empty.
    Other kinds and other columns are ignored.
    """
    spark = captures.sparkSession
    none = F.create_map().cast("map<string,string>")
    rows = captures.select(
        F.col("`record_id`").cast("string").alias("record_id"),
        canonical_url(F.col("`url`")).alias("url"),
        F.col("`date`").cast("timestamp").alias("date"),
        F.col("`kind`").alias("kind"),
        F.coalesce(lower_names(F.col("`headers`").cast("map<string,string>")), none).alias("headers"),
    ).filter(F.col("kind").isin(RESPONSE, REVISIT))
    permitted = F.array(*[F.lit(p) for p in PERMITTED])
    keys = rows.filter(f"url is not null and date is not null and (record_id is not null or kind = '{REVISIT}')").select(
        "record_id",
        "url",
        "date",
        "kind",
        F.col("headers")["etag"].alias("etag"),
        F.col("headers")["last-modified"].alias("last_modified"),
        F.when(F.col("kind") == REVISIT, F.to_json("headers")).alias("updates"),
    )
    ranges = max(1, -(-keys.count() // RANGE_ROWS), spark.sparkContext.defaultParallelism)
    # at equal dates and ids a response comes first
    order = ["url", "date", "record_id", "kind"]
    ranged = keys.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("date")
    schema = "record_id string, url string, etag string, last_modified string, updates string, response_record_id string, response_etag string, response_last_modified string, range int, tail boolean"
    found = stored(ranged.mapInPandas(_carry, schema), "as-of")

    # one row per range: what the ranges before it know about its first URL
    tails = found.filter("tail").orderBy("range").collect()
    handed, url, state = [], None, (None,) * 3
    for t in tails:
        first = t["etag"]
        if first == url and state[0] is not None:
            handed.append((t["range"], *state))
        if t["url"] != url:
            state = (None,) * 3
        url = t["url"]
        if t["response_record_id"] is not None:
            state = (t["response_record_id"], t["response_etag"], t["response_last_modified"])
    late = spark.createDataFrame(handed, "range int, late_id string, late_etag string, late_modified string")
    seen = found.filter("not tail").join(late, "range", "left")
    pick = lambda own, other: F.coalesce(own, F.when(F.col("response_record_id").isNull(), F.col(other)))
    seen = seen.select(
        "record_id",
        "url",
        "etag",
        "last_modified",
        F.coalesce("response_record_id", "late_id").alias("candidate"),
        pick("response_etag", "late_etag").alias("other_etag"),
        pick("response_last_modified", "late_modified").alias("other_modified"),
        F.coalesce(F.from_json("updates", "map<string,string>"), none).alias("own"),
    )
    tags = F.col("etag").isNotNull() & F.col("other_etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("other_modified").isNotNull()
    status = (
        F.when(F.col("candidate").isNull(), "missing")
        .when(tags, F.when(weak(F.col("etag")) == weak(F.col("other_etag")), "resolved").otherwise("mismatch"))
        .when(dates, F.when(F.col("last_modified") == F.col("other_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    seen = seen.withColumn("status", status)
    seen = seen.withColumn("response_id", F.when(F.col("status").isin("resolved", "unvalidated"), F.col("candidate")))
    # of repeated responses the one with the greatest headers in text order
    responses = rows.filter(f"kind = '{RESPONSE}' and record_id is not null").groupBy(F.col("record_id").alias("of"))
    responses = responses.agg(F.max(F.to_json("headers")).alias("theirs"))
    joined = seen.join(responses.hint("merge"), F.expr("response_id = of"), "left")
    theirs = F.from_json("theirs", "map<string,string>")
    updates = F.map_filter("own", lambda k, _: F.array_contains(permitted, k))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(updates), k)), updates)
    resolved = joined.select("record_id", "url", "status", "response_id", F.when(F.col("response_id").isNotNull(), merged).otherwise(F.col("own")).alias("headers"))
    unplaced = rows.filter(f"kind = '{REVISIT}' and (url is null or date is null)")
    return resolved.union(unplaced.select("record_id", "url", F.lit("missing"), F.lit(None).cast("string"), "headers"))


def with_payload(resolved: DataFrame, captures: DataFrame) -> DataFrame:
    """Resolved revisits with the payload of their response (column ``payload`` of ``captures``)."""
    full = captures.filter((F.col("kind") == RESPONSE) & F.col("record_id").isNotNull()).groupBy(F.col("record_id").cast("string").alias("of"))
    full = full.agg(F.max("payload").alias("payload"))
    return resolved.join(full.hint("merge"), F.expr("response_id = of"), "left").drop("of")

"""Scalar expressions over post columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BODY_SENTINEL = "N/A"
ZERO_WIDTH_ENTITY = "&#x200B;"
MAX_BODY_CHARS = 1000


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def epoch_to_utc(seconds: Column | str) -> Column:
    """Epoch seconds to ``yyyy-MM-dd HH:mm:ss`` text; fractions are cut off.

    Needs a UTC session time zone, which :func:`postpulse.build_session` sets.
    """
    return F.date_format(F.timestamp_seconds(F.floor(_col(seconds))), "yyyy-MM-dd HH:mm:ss")


def default_body(body: Column | str) -> Column:
    """The ``N/A`` text where a post has no body."""
    body = _col(body)
    return F.when(body.isNull() | (body == ""), F.lit(BODY_SENTINEL)).otherwise(body)


def truncate_body(body: Column | str, max_chars: int = MAX_BODY_CHARS) -> Column:
    """The first ``max_chars`` code points."""
    return F.substring(_col(body), 1, max_chars)


def strip_entity(body: Column | str) -> Column:
    """Remove every literal zero-width-space entity (upper-case ``B`` only)."""
    return F.replace(_col(body), F.lit(ZERO_WIDTH_ENTITY), F.lit(""))


def combined_text(
    title: Column | str = "title",
    content: Column | str = "content",
    null_as_nan_text: bool = False,
) -> Column:
    """Title and body with one blank between.

    A missing part makes the whole text missing.  ``null_as_nan_text`` renders
    it as ``nan`` instead, as text formatting of a missing value would.
    """
    title, content = _col(title), _col(content)
    if null_as_nan_text:
        title, content = F.coalesce(title, F.lit("nan")), F.coalesce(content, F.lit("nan"))
    return F.concat(title, F.lit(" "), content)


def month_of(timestamp: Column | str) -> Column:
    """The last day of the calendar month, as a date."""
    return F.last_day(F.to_date(_col(timestamp)))


def month_epoch(month: Column | str) -> Column:
    """Epoch seconds of a month-end date at midnight UTC."""
    return F.unix_date(_col(month)).cast("bigint") * F.lit(86_400)

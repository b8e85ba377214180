from postpulse.sources.catalog import (
    ANALYSIS_SOURCE,
    CLEANING_SOURCES,
    COLLECTED_SOURCES,
    source_catalog,
)
from postpulse.sources.listings import read_listings, write_listings
from postpulse.sources.posts import (
    NA_STRINGS,
    append_posts,
    export_csv,
    export_labelled,
    na_to_null,
    parse_dates,
    read_labelled,
    read_posts,
    read_source_files,
    read_stored,
)
from postpulse.sources.schemas import LISTING_SCHEMA, POST_FILE_SCHEMA

__all__ = [
    "ANALYSIS_SOURCE",
    "CLEANING_SOURCES",
    "COLLECTED_SOURCES",
    "LISTING_SCHEMA",
    "NA_STRINGS",
    "POST_FILE_SCHEMA",
    "append_posts",
    "export_csv",
    "export_labelled",
    "na_to_null",
    "parse_dates",
    "read_labelled",
    "read_listings",
    "read_posts",
    "read_source_files",
    "read_stored",
    "source_catalog",
    "write_listings",
]

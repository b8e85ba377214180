"""Post tables: CSV at the edges, Parquet partitioned by source in between."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postpulse.sources.records import scan_csv
from postpulse.sources.schemas import LABELLED_FILE_SCHEMA, POST_FILE_SCHEMA, STORED_POST_SCHEMA

# The texts a CSV field may hold that count as "no value".
# Compared exactly, without trimming and without folding case.
NA_STRINGS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Bodies may span lines and hold doubled quotes.  Lines end in \n or \r\n;
# splitting on \n alone keeps bodies intact and leaves a \r on the last column.
_CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "emptyValue": "",
    "maxCharsPerColumn": "-1",
    "enforceSchema": "true",
}
_CSV_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def na_to_null(column: Column | str) -> Column:
    """Null where the text is one of :data:`NA_STRINGS`."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(~column.isin(*NA_STRINGS), column)


def read_posts(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = POST_FILE_SCHEMA,
) -> DataFrame:
    """Scan post CSV files; every column is text, NA texts become null.

    A quoted body may hold line ends; files are read by splits all the same.
    """
    return _without_na(scan_csv(spark, path, schema, _CSV_OPTIONS), schema)


def _without_na(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """NA texts as null, and no carriage return behind the last column."""
    *others, last = schema.fieldNames()
    clean = {name: na_to_null(name) for name in others}
    clean[last] = na_to_null(F.regexp_replace(F.col(last), r"\r$", ""))
    return raw.withColumns(clean)


def read_source_files(
    spark: SparkSession,
    directory: str,
    sources: Iterable[str],
    schema: T.StructType = POST_FILE_SCHEMA,
) -> DataFrame:
    """Scan ``{source}-posts.csv`` for many sources at once, skipping absent ones.

    One glob serves all sources, so the plan holds a single scan however many
    there are, and a source without a file simply does not match.
    """
    names = ",".join(sources)
    pattern = f"{directory.rstrip('/')}/{{{names}}}-posts.csv"
    source = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)-posts\.csv", 1)
    try:
        raw = scan_csv(spark, pattern, schema, _CSV_OPTIONS, {"subreddit": source})
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], T.StructType([T.StructField("subreddit", T.StringType()), *schema.fields]))
    return _without_na(raw, schema)


def parse_dates(posts: DataFrame, column: str = "date") -> DataFrame:
    """Text dates to timestamps (UTC session); unreadable dates become null."""
    return posts.withColumn(column, F.try_to_timestamp(F.col(column), F.lit(DATE_FORMAT)))


def append_posts(posts: DataFrame, path: str) -> None:
    """Append to the stored table, one directory per source.

    The rebalance hint lets adaptive execution split a source that holds much
    of the data over many tasks and merge small sources into few files.
    """
    (
        posts.select(*STORED_POST_SCHEMA.fieldNames())
        .hint("rebalance", "subreddit")
        .write.mode("append")
        .partitionBy("subreddit")
        .parquet(path)
    )


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; a table that does not exist yet is an empty one."""
    try:
        return spark.read.schema(STORED_POST_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED_POST_SCHEMA)


def export_csv(frame: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Overwrite ``path`` with CSV that :func:`read_posts` reads back unchanged.

    Null and empty text are both written as an empty field, so an emptied body
    comes back as null in the next stage.
    """
    timestamps = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.TimestampType)]
    for name in timestamps:
        frame = frame.withColumn(name, F.date_format(F.col(name), DATE_FORMAT))
    (
        frame.write.mode("overwrite")
        .options(**_CSV_WRITE_OPTIONS)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def export_labelled(posts: DataFrame, path: str) -> None:
    """The hand-off between labelling and training: overwrite ``path`` with labelled post CSV."""
    export_csv(posts.select(*LABELLED_FILE_SCHEMA.fieldNames()), path)


def read_labelled(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Labelled post files with NA texts as null and dates parsed."""
    return parse_dates(read_posts(spark, path, LABELLED_FILE_SCHEMA))

"""Lemmas by table: ``lexicon(token, tag, lemma)`` supplied by the caller."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.functions.text import map_pos
from postpulse.session import cut_lineage

DEFAULT_TAG = "NN"  # a token nobody tagged is taken for a noun
MAX_LOCAL_BYTES, ENTRY_BYTES = 16 << 20, 32  # a lexicon that travels with the tasks; what an entry takes beside its text
ROWS_AT_ONCE = 1000  # rows whose tokens are looked up at once; bounds a task's memory


def join_lexicon(tags: DataFrame, lemmas: DataFrame) -> DataFrame:
    """One lexicon from ``tags(token, tag)`` and ``lemmas(token, pos, lemma)``.

    Lemmas are looked up by token and word class; untagged tokens are nouns.
    """
    tagged = lemmas.join(tags, "token", "left")
    tag = F.coalesce("tag", F.lit(DEFAULT_TAG))
    return tagged.filter(map_pos(tag) == F.col("pos")).select("token", tag.alias("tag"), "lemma")


def effective_lemmas(lexicon: DataFrame) -> DataFrame:
    """``token, lemma`` for entries that change a token, one per token (first tag wins)."""
    changing = lexicon.filter(map_pos("tag").isNotNull() & (F.col("lemma") != F.col("token")))
    first = F.min(F.struct("tag", "lemma"))
    return changing.groupBy("token").agg(first["lemma"].alias("lemma"))


def lemmatise(docs: DataFrame, lexicon: DataFrame, tokens: str = "tokens", max_local: int = MAX_LOCAL_BYTES) -> DataFrame:
    """Replace every token by its lemma; tokens outside the lexicon, null tokens and null arrays stay as they are.

    A lexicon of at most ``max_local`` bytes travels with the tasks and token
    arrays are mapped in Arrow batches, without any shuffle.  A larger one is
    joined with the distinct tokens of each row; the result is the same.
    """
    lemmas = cut_lineage(effective_lemmas(lexicon), "lemmas")
    size = lemmas.agg(F.sum(F.octet_length("token") + F.octet_length("lemma") + ENTRY_BYTES)).first()[0] or 0
    if size <= max_local:
        return docs.withColumn(tokens, _local_lookup(lemmas.toArrow())(F.col(tokens)))
    return lemmatise_by_join(docs, lemmas, tokens)


def _local_lookup(table: pa.Table):
    keys = table["token"].combine_chunks().cast(pa.string())
    values = table["lemma"].combine_chunks().cast(pa.string())

    @F.arrow_udf("array<string>")
    def swap(lists: pa.Array) -> pa.Array:
        parts = [_swapped(lists.slice(start, ROWS_AT_ONCE), keys, values) for start in range(0, len(lists), ROWS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return swap


def _swapped(lists: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
    words = lists.flatten().cast(pa.string())
    swapped = pc.coalesce(values.take(pc.index_in(words, value_set=keys)), words)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, swapped, mask=pc.is_null(lists))


def _swap_own(lists: pa.Array, found: pa.Array) -> pa.Array:
    """Tokens by the (token, lemma) pairs found for their rows, some rows at a time.

    A token has one lemma, and a row has it among its pairs if any row does.
    """
    parts = []
    for start in range(0, len(lists), ROWS_AT_ONCE):
        pairs = found.slice(start, ROWS_AT_ONCE).flatten()
        keys, values = (part.cast(pa.string()) for part in pairs.flatten())
        parts.append(_swapped(lists.slice(start, ROWS_AT_ONCE), keys, values))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def lemmatise_by_join(docs: DataFrame, lemmas: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The same result for lexicons of any size.

    Rows are numbered, so equal keys do not matter.  Every row sends its distinct
    tokens to the lexicon once and gets back those that change.
    """
    rows = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()), "to-lemmatise")
    words = rows.select("_row", F.explode(F.array_distinct(tokens)).alias("token"))
    pair = F.struct("token", "lemma")
    found = words.join(lemmas.hint("merge"), "token").groupBy("_row").agg(F.collect_list(pair).alias("_found"))
    joined = rows.join(found, "_row", "left").withColumn(tokens, F.arrow_udf(_swap_own, "array<string>")(F.col(tokens), F.col("_found")))
    return joined.select(*docs.columns)

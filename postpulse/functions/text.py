"""Text normalisation as column expressions: no Python runs per row.

The same :func:`normalise_tokens` expression serves training and scoring.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published English stop-word list, in its natural order.
ENGLISH_STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
    yourselves he him his himself she she's her hers herself it it's its itself they them their
    theirs themselves what which who whom this that that'll these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at
    by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both
    each few more most other some such no nor not only own same so than too very s t can will just
    don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
    doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't
    needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)
# Negations that must stay, and clitics the tokeniser splits off.
KEPT_NEGATIONS = ("not", "no")
CLITICS = ("'re", "'s", "'d", "'ll", "'ve", "'m")
STOPWORDS = tuple(w for w in ENGLISH_STOPWORDS if w not in KEPT_NEGATIONS) + CLITICS

# Blanks beyond the ASCII ones, which also separate words.
WIDE_BLANKS = (
    "\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The published Treebank word rules on lower-cased text with a blank at each
# end, arranged for few and fast passes: rules that replace a mark by a blank
# share one pattern, and so do rules that only insert a blank.  Each pattern
# starts with a cheap test that fails on most characters.  Hot character
# classes list their members one by one, because Java tests such a class with a
# single table lookup and a class of ranges with a chain of calls.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_PLAIN = _LETTERS + "0123456789' " + "".join(chr(c) for c in range(0xC0, 0x100))
_ASCII_BLANKS = r"\n\t\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0"
_SEPARATOR = (
    rf"(?:[{_ASCII_BLANKS};@#$%&?!*\[\](){{}}<>«»`]|[“”‘’„\u2000-\u200a\u1680\u2028\u2029\u202f\u205f\u3000])"
)
_NEGATION = "n't(?:'[smd]?)? "
_END = rf"(?:\b|{_NEGATION})"  # where a contracted word ends, before or after its negation is split off
_LONE_LETTER = "[abce-lo-ru-z0-9_]"
WORD_PATTERNS = (
    # an opening quotation mark goes, any other becomes a token of its own
    (r"""["'](?:(?<=")|(?<=')')(?<=[ (\[{<«“‘„`](?:"|''))""", " "),
    (r"""["'](?:(?<=")|(?<=')')""", " '' "),
    # an apostrophe before a lone letter stands alone, unless it is a clitic
    (rf"'(?={_LONE_LETTER}\b)", "' "),
    # marks, runs of dots or dashes, a dot that ends a word, a comma or colon not before a digit
    (
        rf"(?=[^{_PLAIN}])(?:\.(?:\.+|(?= |{_SEPARATOR}|--|[:,][^0-9]))|[:,](?=[^0-9])|--|{_SEPARATOR})",
        " ",
    ),
    # a blank before a clitic, and inside contracted words
    (
        rf"(?=['ntmiw])(?:(?='(?:[smd]|(?:ll|re|ve)(?:'[smd]?)?)? )(?<=[^' ])|(?={_NEGATION})(?<=[^' ])"
        rf"|(?=not{_END})(?<=\bcan)|(?=na{_END})(?<=\b(?:gon|wan))|(?=ta{_END})(?<=\bgot)"
        rf"|(?=me{_END})(?<=\b(?:gim|lem))|(?='ye{_END})(?<=\bd)|(?='n{_END})(?<=\bmore)"
        rf"|(?=(?:is|was){_END})(?<= 't))",
        " ",
    ),
)
# Fixed value: what the normaliser deletes inside a token.
SPECIAL_CHARACTERS = rf"[^{_LETTERS}' ]+"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lower_trim(text: Column | str) -> Column:
    """Lower-case without blanks at either end."""
    return F.regexp_replace(F.lower(_col(text)), r"^\s+|\s+$", "")


def _spaced_words(text: Column) -> Column:
    spaced = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    for pattern, replacement in WORD_PATTERNS:
        spaced = F.regexp_replace(spaced, pattern, replacement)
    return spaced


def _split_words(spaced: Column) -> Column:
    return F.filter(F.split(spaced, " "), lambda word: word != "")


def tokenise(text: Column | str) -> Column:
    """Lower-cased words with contractions split (``don't`` to ``do``, ``n't``)."""
    return _split_words(_spaced_words(_col(text)))


def strip_special(text: Column | str) -> Column:
    """Words reduced to letters and apostrophes; words left empty are dropped.

    Deleting marks before splitting equals deleting them inside every word,
    and costs one pass over the text instead of one per word.
    """
    return _split_words(F.regexp_replace(_spaced_words(_col(text)), SPECIAL_CHARACTERS, ""))


def remove_stopwords(tokens: Column | str, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Tokens outside the list, order and repeats kept (a hash-set test per token)."""
    stopwords = tuple(stopwords)
    return F.filter(_col(tokens), lambda word: ~word.isin(*stopwords))


def normalise_tokens(text: Column | str, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Lower, split, strip marks and drop stop words: the whole chain in one expression."""
    dropped = ("", *stopwords)
    spaced = F.regexp_replace(_spaced_words(_col(text)), SPECIAL_CHARACTERS, "")
    return F.filter(F.split(spaced, " "), lambda word: ~word.isin(*dropped))


def map_pos(tag: Column | str) -> Column:
    """Part-of-speech tag to the lemma table's word class, by its first letter."""
    first = F.substring(_col(tag), 1, 1)
    return (
        F.when(first == "J", "a").when(first == "N", "n").when(first == "R", "r").when(first == "V", "v")
    )


def ngrams(tokens: Column | str, max_n: int = 1) -> Column:
    """All n-grams of 1..``max_n`` tokens, shorter ones first."""
    tokens = _col(tokens)
    grams = [tokens]
    for n in range(2, max_n + 1):
        joined = tokens
        for offset in range(1, n):
            width = F.greatest(F.size(tokens) - F.lit(offset), F.lit(0))
            rest = F.slice(tokens, F.lit(offset + 1), width)
            joined = F.zip_with(joined, rest, lambda left, right: F.concat(left, F.lit(" "), right))
        grams.append(F.filter(joined, lambda gram: gram.isNotNull()))
    return F.concat(*grams) if len(grams) > 1 else tokens

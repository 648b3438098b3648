"""Token functions: plain column expressions, one regular expression a line, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From the first to the last ASCII letter of a run between the five white-space characters.
TOKEN = r"[a-z](?:[^ \t\n\r\f]*[a-z])?"
LINE_WORDS = 100


def tokens(text: Column) -> Column:
    """Lower-cased tokens, stripped at both ends to a-z; what has no letter is none. Null: no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def prefix(word: Column, size: int = 2) -> Column:
    """The first `size` letters; a shorter word counts as itself."""
    return F.substring(word, 1, size)


def line_words(text: Column, most: int | None = LINE_WORDS) -> Column:
    """Distinct words among a line's first `most` tokens, or among all, in order of first occurrence."""
    return F.array_distinct(tokens(text) if most is None else F.slice(tokens(text), 1, most))


def bigrams(words: Column) -> Column:
    """Neighbouring pairs (left, right) of a list of words."""
    pair = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.filter(pair, lambda p: p["right"].isNotNull())


def snippet(text: Column, most: int = 80) -> Column:
    """Texts of over `most` characters are cut there and get three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def feature(word: Column, buckets: int = 1000) -> Column:
    """A word's feature number, from its length and first character; it needs no vocabulary."""
    return ((F.length(word) * 31 + F.ascii(word)) % buckets).cast("int")

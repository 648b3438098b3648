"""Counts of tokens, prefixes and of the lines that hold a word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_WORDS, line_words, prefix, tokens


def word_count(lines: DataFrame) -> DataFrame:
    """(word, cnt) over all tokens of (line); combined before the shuffle."""
    return lines.select(F.explode(tokens(F.col("line"))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def prefix_count(lines: DataFrame, size: int = 2) -> DataFrame:
    """(prefix, cnt) over the first letters of all tokens."""
    firsts = F.transform(tokens(F.col("line")), lambda w: prefix(w, size))
    return lines.select(F.explode(firsts).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("cnt"))


def line_frequency(lines: DataFrame, least: int = 10, most: int = LINE_WORDS) -> DataFrame:
    """(word, cnt): lines that hold the word among their first `most` tokens, from `least` lines on."""
    return lines.select(F.explode(line_words(F.col("line"), most)).alias("word")).groupBy("word").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def line_total(lines: DataFrame) -> DataFrame:
    """(cnt): lines with at least one token."""
    return lines.where(F.size(tokens(F.col("line"))) > 0).agg(F.count("*").alias("cnt"))

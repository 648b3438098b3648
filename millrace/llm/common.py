"""What the operators share: partitions, words, and rows packed into one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept

__all__ = ["SPACED", "kept", "n_spaced", "packed", "partitions", "text_or_empty", "unpacked"]

#: A run of characters between ASCII white space: a word by size.
SPACED = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_spaced(column: str = "text") -> Column:
    """Words of a text, by white space; 0 for null."""
    return F.regexp_count(text_or_empty(column), F.lit(SPACED)).cast("long")


def packed(docs: DataFrame) -> DataFrame:
    """docs as one column `d`, a struct of all its columns: further columns of any name can't clash with an operator's own."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("d"))


def unpacked(columns: list[str], changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns of a packed table again, some of them changed."""
    return [(changed or {}).get(c, F.col("d").getField(c)).alias(c) for c in columns]

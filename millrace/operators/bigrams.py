"""Relative frequencies of neighbouring words; bigrams don't cross lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import tallied
from ..functions.words import coded, lowered, slices, words

#: Bytes of input for each partition of the shuffle of bigrams, so that a task's share doesn't grow with the input.
PARTITION = 16 << 20
#: Where Spark doesn't know a table's size it takes for it the largest number there is.
UNKNOWN = 1 << 50


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right, cnt) of lower-cased lines, some at a time."""
    for part in (p for b in batches for p in slices(b)):
        flat, sizes = words(part.column(0))
        codes, distinct = coded(flat)
        line = np.repeat(np.arange(len(sizes)), sizes)
        same = line[1:] == line[:-1]
        keys, n = tallied(codes[:-1][same] * max(1, len(distinct)) + codes[1:][same])
        sides = (distinct.take(pa.array(x)).cast(pa.string()) for x in np.divmod(keys, max(1, len(distinct))))
        yield pa.RecordBatch.from_arrays([*sides, pa.array(n)], ["left", "right", "cnt"])


def counts(lines: DataFrame) -> DataFrame:
    """(left, right, cnt). Counts of some lines are made where these are read; they are dealt out before tables of them are kept, into
    partitions by the size of the input, so no task keeps a table of all bigrams that it reads."""
    spark = lines.sparkSession
    size = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size > UNKNOWN else size
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // PARTITION, 20_000))
    found = lines.select(lowered(F.col("line")).alias("line")).mapInArrow(_neighbours, "left string, right string, cnt long")
    return found.repartition(n, "left", "right").groupBy("left", "right").agg(F.sum("cnt").alias("cnt"))


def relative_frequencies(lines: DataFrame) -> DataFrame:
    """(left, right, value): the share of right among what follows left.

    The marginals are summed from the pair counts, partially before their own shuffle, and joined; so a word that starts
    very many bigrams doesn't gather in a task, as it would in a window by left.
    """
    c = counts(lines)
    total = c.groupBy("left").agg(F.sum("cnt").alias("total"))
    return c.join(total, "left").select("left", "right", (F.col("cnt") / F.col("total")).alias("value"))


def pairs(lines: DataFrame) -> DataFrame:
    """(left, right, value): relative frequencies, and for right `*` the number of bigrams that left starts."""
    c = counts(lines)
    total = c.groupBy("left").agg(F.sum("cnt").alias("total"))
    marginal = total.select("left", F.lit("*").alias("right"), F.col("total").cast("double").alias("value"))
    return c.join(total, "left").select("left", "right", (F.col("cnt") / F.col("total")).alias("value")).union(marginal)


def stripes(lines: DataFrame) -> DataFrame:
    """(left, stripe): a map from right to its relative frequency."""
    return relative_frequencies(lines).groupBy("left").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("right", "value")))).alias("stripe"))

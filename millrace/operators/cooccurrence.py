"""Pointwise mutual information of words that share lines.

A pair that is on `least` lines consists of words that are on `least` lines each, so the rarer words go first. The others are
numbered, the most frequent first. A task counts the pairs of a block of its lines by word: the words that follow one in its
lines are counted in an array, or sorted where they are few, so no pair ever is a row by itself. What is shuffled are the
counts of a block, as sorted and compressed numbers, dealt by the first word into as many buckets as keep each one small;
a bucket's counts are summed by one task. Words come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import ranges, tallied
from ..functions.text import LINE_WORDS, line_words
from ..functions.words import coded, lowered, slices, words
from ..session import kept


LINES = "*"
#: Bytes of frequent words up to which they are broadcast; more are joined by a shuffle, whose skew AQE splits.
BROADCAST_BYTES = 32 << 20
#: Words of a block of lines; pairs made at once; counts a task holds before it gives them out, or sums them.
BLOCK, PAIRS, HELD = 6_000_000, 2_000_000, 6_000_000
#: Pairs that a bucket has, by an estimate. Bits of a block's count and of a pair's number in its bucket, side by side.
BUCKET, COUNT_BITS, KEY_BITS = 32_000_000, 28, 36


def paired(ids: np.ndarray, ends: np.ndarray, vocabulary: int, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, count) of all pairs a < b of a line, in order of key = place[a] * vocabulary + b, some at a time.

    ids: the lines' numbers one line after the other, distinct and sorted within each; ends: for each, where its line ends.
    A key occurs once, but for one whose word fills several parts.
    """
    first = place[ids]
    order = np.argsort(first, kind="stable")
    size = ends[order] - order - 1
    order, size = order[size > 0], size[size > 0]
    first = first[order]
    start = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(size)))
    bounds = np.append(start, len(first))
    mass = total[bounds[1:]] - total[bounds[:-1]]
    frequent = mass * 8 >= vocabulary
    w = 0
    while w < len(start):
        if frequent[w]:
            counts, i = np.zeros(vocabulary, np.int64), bounds[w]
            while i < bounds[w + 1]:
                j = min(bounds[w + 1], max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, side="right")) - 1))
                counts += np.bincount(ids[ranges(order[i:j] + 1, size[i:j])], minlength=vocabulary)
                i = j
            found = np.flatnonzero(counts)
            yield first[bounds[w]] * vocabulary + found, counts[found]
            w += 1
            continue
        v = w + 1
        while v < len(start) and not frequent[v] and total[bounds[v + 1]] - total[bounds[w]] <= PAIRS:
            v += 1
        i, j = bounds[w], bounds[v]
        yield tallied(np.repeat(first[i:j], size[i:j]) * vocabulary + ids[ranges(order[i:j] + 1, size[i:j])])
        w = v


def squeezed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts in few bytes: steps and counts by the places of their bytes, compressed."""
    steps = np.diff(keys, prepend=0)
    rows = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]) for x, width in ((steps, 5), (counts, 4))]
    return pa.Codec("zstd", 1).compress(b"".join(r.tobytes() for r in rows), asbytes=True)


def unsqueezed(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw, out = np.frombuffer(pa.Codec("zstd").decompress(data, 9 * n, asbytes=True), np.uint8).reshape(9, n), []
    for at, width in ((0, 5), (5, 4)):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = raw[at : at + width].T
        out.append(wide.view("<u8")[:, 0].astype(np.int64))
    return np.cumsum(out[0]), out[1]


def first_words(sizes: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of lines of these sizes, whether each is among the first `most` of its line, and its line."""
    line = np.repeat(np.arange(len(sizes)), sizes)
    return (np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < most) if most is not None else np.ones(len(line), bool), line


def _frequencies(most: int | None):
    """(word, n) of lower-cased lines: how many hold the word, and under LINES how many hold any; some lines at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, sizes = words(part.column(0))
                codes, distinct = coded(tokens)
                good, line = first_words(sizes, most)
                keys, _ = tallied(line[good] * max(1, len(distinct)) + codes[good])
                n = np.bincount(keys % max(1, len(distinct)), minlength=len(distinct))
                found = np.flatnonzero(n)
                names = pa.concat_arrays([distinct.take(pa.array(found)).cast(pa.string()), pa.array([LINES])])
                yield pa.RecordBatch.from_arrays([names, pa.array(np.append(n[found], np.count_nonzero(sizes)))], ["word", "n"])

    return run


def _count(vocabulary: int, buckets: int, most: int | None, told=None):
    """(bucket, n, data) of lower-cased lines, whose words' numbers are their places in `told`, or of lists of such numbers."""
    own = -(-vocabulary // buckets)  # words of a bucket: those of the same remainder, so frequent ones are dealt out

    def numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers, sorted and distinct within each line, and how many of them a line has."""
        if told:
            tokens, sizes = words(column)
            codes, distinct = coded(tokens)
            good, line = first_words(sizes, most)
            ids = pc.fill_null(pc.index_in(distinct.cast(pa.string()), value_set=told.value), -1).to_numpy().astype(np.int64)[codes]
            good &= ids >= 0
        else:
            ids = column.flatten().to_numpy()
            good, line = first_words(pc.list_value_length(column).to_numpy(), None)
        keys, _ = tallied(line[good] * vocabulary + ids[good])
        return keys % vocabulary, np.bincount(keys // vocabulary, minlength=len(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(vocabulary)
        place = numbers % buckets * own + numbers // buckets

        def given(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            bucket = keys // (own * vocabulary)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            parts = [(bucket[i], j - i, squeezed(keys[i:j] - bucket[i] * own * vocabulary, counts[i:j])) for i, j in zip(cut, np.append(cut[1:], len(keys)))]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())], ["bucket", "n", "data"])

        def block(ids: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            flat, size = np.concatenate(ids), np.concatenate(sizes)
            held, n = [], 0
            for k, c in paired(flat, np.repeat(np.cumsum(size), size), vocabulary, place):
                held.append((k, c))
                n += len(k)
                if n >= HELD:
                    yield given(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
            if n:
                yield given(*map(np.concatenate, zip(*held)))

        ids, sizes, n = [], [], 0
        for part in (s for b in batches for s in (slices(b) if told else [b])):
            flat, size = numbered(part.column(0))
            ids.append(flat)
            sizes.append(size)
            n += len(flat)
            if n >= BLOCK:
                yield from block(ids, sizes)
                ids, sizes, n = [], [], 0
        if n:
            yield from block(ids, sizes)

    return run


def _sum(vocabulary: int, buckets: int, least: int):
    """(a, b, cnt) from `least` on, of rows (bucket, n, data) that lie by bucket."""
    own, low = -(-vocabulary // buckets), (1 << COUNT_BITS) - 1

    def summed(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        both = np.sort(np.concatenate(held))
        keys = both >> COUNT_BITS
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.add.reduceat(both & low, first)

    def packed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A number for each; of a count beyond the bits for it, several."""
        times = np.maximum(1, -(-counts // low))
        last = counts - (times - 1) * low
        out = np.repeat(keys << COUNT_BITS | low, times)
        out[np.cumsum(times) - 1] = keys << COUNT_BITS | last
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bucket: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys, counts = summed(held)
            keys, counts = keys[counts >= least], counts[counts >= least]
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array((k // vocabulary) * buckets + bucket), pa.array(k % vocabulary), pa.array(counts[i : i + 100_000])], ["a", "b", "cnt"])

        bucket, held, n, most = None, [], 0, HELD
        for batch in batches:
            for k, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if k != bucket:
                    if held:
                        yield from done(bucket, held)
                    bucket, held, n, most = k, [], 0, HELD
                held.append(packed(*unsqueezed(data.as_buffer(), size)))
                n += size
                if n >= most:
                    held = [packed(*summed(held))]
                    n = len(held[0])
                    most = n + HELD
        if held:
            yield from done(bucket, held)

    return run


def pair_counts(lines: DataFrame, least: int = 10, most: int | None = None) -> DataFrame:
    """(x, y, cnt, px, py, total) for x < y on `least` lines or more together; px and py count their own lines, total all.
    Of a line its first `most` tokens count, or all."""
    spark = lines.sparkSession
    low = lines.select(lowered(F.col("line")).alias("line"))
    # lines are counted in the same pass, under a mark that no word is; a second pass makes the pairs, and no copy of the text is kept
    known = low.mapInArrow(_frequencies(most), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("word") == LINES))
    known = kept(known)
    total, vocabulary, size, occurrences = known.agg(F.coalesce(F.sum(F.when(F.col("word") == LINES, F.col("n"))), F.lit(0)), F.count(F.when(F.col("word") != LINES, 1)), F.coalesce(F.sum(F.octet_length("word") + 48), F.lit(0)), F.coalesce(F.sum(F.when(F.col("word") != LINES, F.col("n"))), F.lit(0))).head()
    told = size <= BROADCAST_BYTES
    known = kept(known.where(F.col("word") != LINES).orderBy(F.desc("n"), "word").withColumn("at", F.monotonically_increasing_id()))
    # from 0 on without gaps: a partition's first number, and the place in the partition
    before, offset = {}, 0
    for part, n in sorted((r["part"], r["count"]) for r in known.groupBy(F.shiftright("at", 33).alias("part")).count().collect()):
        before[part], offset = offset, offset + n
    firsts = F.create_map(*(F.lit(x).cast("long") for p in (before or {0: 0}).items() for x in p))
    known = known.select("word", "n", (firsts[F.shiftright("at", 33)] + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"))
    vocabulary = max(1, vocabulary)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = occurrences * occurrences / max(1, total)  # twice the number, were all lines of the same length
    buckets = min(vocabulary, max(4 * shuffled, vocabulary * vocabulary >> KEY_BITS - 1, int(pairs / BUCKET)))
    if told:
        found = known.orderBy("id").select("word").toArrow().column("word").combine_chunks()
        counted = low.mapInArrow(_count(vocabulary, buckets, most, spark.sparkContext.broadcast(found)), "bucket int, n int, data binary")
    else:
        numbered = lines.select(line_words(F.col("line"), most).alias("w"), F.monotonically_increasing_id().alias("line")).select("line", F.explode("w").alias("word")).join(known.select("word", "id"), "word")
        counted = numbered.groupBy("line").agg(F.collect_list("id").alias("ids")).select("ids").mapInArrow(_count(vocabulary, buckets, most), "bucket int, n int, data binary")
    counts = counted.repartition(shuffled, "bucket").sortWithinPartitions("bucket").mapInArrow(_sum(vocabulary, buckets, least), "a long, b long, cnt long")
    a, b = (known.select(F.col("id").alias(k), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    a, b = (F.broadcast(a), F.broadcast(b)) if told else (a, b)
    named = counts.join(a, "a").join(b, "b").withColumn("total", F.lit(total))
    first = F.col("wa") < F.col("wb")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return named.select(pick("wa", "wb").alias("x"), pick("wb", "wa").alias("y"), "cnt", pick("na", "nb").alias("px"), pick("nb", "na").alias("py"), "total")


def pmi_pairs(lines: DataFrame, least: int = 10, most: int | None = None) -> DataFrame:
    """(x, y, cnt, pmi) for both orders of each pair: log10(cnt * total / (px * py)), 64-bit throughout. Whole lines count, or of each
    its first `most` tokens."""
    p = pair_counts(lines, least, most)
    pmi = F.log10(F.col("cnt") / (F.col("px").cast("double") * F.col("py")) * F.col("total"))
    return p.select(F.inline(F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))), "cnt", pmi.alias("pmi"))


def pmi_stripes(lines: DataFrame, least: int = 10, most: int = LINE_WORDS) -> DataFrame:
    """(word, stripe): a map from neighbour to PMI. A stripe holds the words that share `least` lines with the word."""
    pairs = pmi_pairs(lines, least, most)
    return pairs.groupBy(F.col("x").alias("word")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("y", "pmi")))).alias("stripe"))


def neighbours(pairs: DataFrame, k: int = 3) -> DataFrame:
    """(x, rank, y, pmi): each word's k neighbours of highest PMI, ties to the lesser word. PMI is compared to 6 digits."""
    p = pairs.withColumn("pmi", F.round("pmi", 6))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("pmi"), "y"))).where(F.col("rank") <= k).select("x", "rank", "y", "pmi")

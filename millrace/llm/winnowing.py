"""Document fingerprints by winnowing.

Hashes of all k-grams of code points (k = 16) roll by doubling (a 2j-gram's hash from two j-grams'), and of every window of
`window` = 16 consecutive hashes the least is chosen, the rightmost of equal ones. Any match of window + k - 1 = 31 code points
between two texts so shares a chosen hash, whose positions are kept. A text of fewer than twice as many code points keeps all
its k-grams, so that two thirds of it are found again; one of fewer than window + k - 1 has all its 2-grams before them. A
single code point has one hash, that of the text.

A fingerprint is written as position:hash, comma-joined, positions in code points and hashes as eight hex digits. Likeness
is the Jaccard index of the multisets of hashes; two empty texts are alike (1), an empty and another one are not (0).

The next document is the one that follows in descending order of doc_id; after the last comes the first. For it the rows
are dealt by ranges of doc_id, once, with the text: bounds come from doc_id alone, and each range also gets the first
documents of the range that follows. Within a task two neighbouring texts are held, no more than a batch of Arrow's.

Nulls and edges: a null text is empty. A null doc_id comes after all others. Rows of equal doc_id follow in the order of
their texts. A single row is its own next. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

K, WINDOW = 16, 16
#: Code points of the grams that texts shorter than a sure match have besides.
SHORT = 2
BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 32-bit hash of each k-gram; k is a power of two."""
    h, base, j = points.astype(np.uint64) + np.uint64(1), BASE, 1
    while j < k:
        h = h[:-j] * base + h[j:]
        with np.errstate(over="ignore"):
            base, j = base * base, 2 * j
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def choose(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the least hash of each window, rightmost of equal ones, each once. window: a power of two."""
    n = len(hashes)
    # ties: the greater position must be the lesser key
    key = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    if n <= window:
        least = key.min(keepdims=True)
    else:
        least, j = key, 1
        while j < window:
            least = np.minimum(least[:-j], least[j:])
            j *= 2
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF)), least >> np.uint64(32)


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a text."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < SHORT:
        whole = np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), np.uint32).astype(np.uint64)
        return np.zeros(1, np.uint64), whole
    sure = window + k - 1
    with np.errstate(over="ignore"):
        if len(points) >= 2 * sure:
            return choose(gram_hashes(points, k), window)
        grams = [gram_hashes(points, j) for j in (SHORT, k) if j <= len(points) and (j == k or len(points) < sure)]
    return np.concatenate([np.arange(len(h), dtype=np.uint64) for h in grams]), np.concatenate(grams)


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    return ",".join(map("%d:%08x".__mod__, zip(print_[0].tolist(), print_[1].tolist())))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return (x & y).total() / n if (n := (x | y).total()) else 1.0


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, extra) in descending order; a row is given out when its next one is known, but extra ones."""
    before, out, size = None, [], 0
    for batch in batches:
        for doc_id, text, extra in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text = text.as_py() or ""
            print_ = fingerprint(text)
            if before is not None and not before[3]:
                row = _row(*before[:3], text, print_)
                out.append(row)
                size += len(row[3]) + len(row[4])
                if size > 4_000_000:
                    yield _batch(out)
                    out, size = [], 0
            before = (doc_id, text, print_, extra)
    if out:
        yield _batch(out)


def _row(doc_id: int | None, text: str, print_: tuple, following: str, print_next: tuple) -> tuple:
    new = edited(text, following)
    print_new = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(print_), written(print_new), likeness(print_[1], print_new[1]), likeness(print_[1], print_next[1])


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns NAMES for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    n = partitions(spark)
    # Part p holds the ids up to bounds[p - 1] and above bounds[p]; there are as many as partitions, whatever the input's size. The
    # bounds are estimates, which need not occur, so each part's first id and which parts have rows are found besides.
    shares = F.array(*(F.lit(i / n) for i in range(1, max(n, 2))))
    found = rows.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 10 * n))).alias("q")).collect()[0]
    bounds = np.array(sorted(set(found["q"] or []), reverse=True)[: n - 1], np.int64)

    def part_of(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(-bounds, -ids, side="right")

    @F.arrow_udf("int")
    def parts(ids: pa.Array) -> pa.Array:
        return pa.array(part_of(ids.to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.int32))

    known_ids = rows.where("doc_id is not null").select("doc_id")
    firsts = {r["part"]: r["first"] for r in known_ids.groupBy(parts("doc_id").alias("part")).agg(F.max("doc_id").alias("first")).collect()}
    present = np.array(sorted(firsts), np.int64)
    first_ids = np.array([firsts[p] for p in present.tolist()], np.int64)
    last = max(0, len(present) - 1)

    @F.arrow_udf("array<int>")
    def slots(ids: pa.Array) -> pa.Array:
        """2 * part; and 2 * part + 1 of the part before, where the id is the first of its part (before the first: the last).
        Parts are numbered among those that have rows; null ids are in the last one."""
        known, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        if len(present):
            part = np.where(null, last, np.minimum(np.searchsorted(present, part_of(known)), last))
            first = ~null & (known == first_ids[part])
        else:
            part, first = np.zeros(len(known), np.int64), null
        size = 1 + first
        at = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int32)
        out[at] = 2 * part
        out[at[first] + 1] = 2 * (np.where(part > 0, part, last + 1)[first] - 1) + 1
        return pa.ListArray.from_arrays(pa.array(np.append(at, size.sum()).astype(np.int32)), pa.array(out))

    dealt = rows.withColumn("slot", F.explode(slots("doc_id")))
    dealt = dealt.repartitionById(last + 1, F.shiftright("slot", 1)).sortWithinPartitions(F.col("slot"), F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return dealt.select("doc_id", "text", (F.col("slot") % 2 == 1).alias("extra")).mapInArrow(_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir):
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""Exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into 4, 8, 16, then 32 segments. With a segment's mean m and deviation s (its population standard deviation),
and segment length L, two vectors' squared distance is at least the sum of L((m - m')^2 + (s - s')^2). Since the inner
product is (|q|^2 + |c|^2 - distance^2) / 2, that bounds it from above; in this form the norms cancel, and the bound is the
inner product of the vectors sqrt(L) * (m, s). Coarse bounds come first; where a bound is below the k-th best score known,
the pair is pruned; what is left gets the finer bound, pair by pair, and survivors the exact score.

Segments are taken after a rotation, which changes no distance: the principal axes of up to `SAMPLE` vectors (those with
the least hash). The first half of a level's segments are single axes, so bounds are exact where vectors differ most, and the
axes that are left share the other half. Rotation costs rounding; a slack of 1e-9 of the norms covers it, and exact
scores come from the vectors as they are.

Vectors travel in blocks: candidates in as many groups as a shuffle has partitions, queries in groups of `GROUP_MB` in memory
at most, and each pair of groups meets in one task, which holds its queries and streams its candidates. The plan is the
same whatever the data's size, and nothing but the rotation goes through the driver. A task keeps k for each query; the last
step takes the best k over tasks. The work is queries times candidates less what the bounds prune, which on vectors without
structure is nearly nothing.

Vectors that are null, or hold a null or non-finite component (or one whose product with the scale is), take no part.
Vectors of unequal lengths are not compared. A candidate with the query's own vec_id is the query's own row. Rows repeated
under another vec_id each take a rank; a repeated query row is one query. A null vec_id is never a query, and comes last
among equal scores. Scores beyond 64 bits are exact in comparison and saturate in the result. Empty tables give no rows.
Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

SEGMENTS = (4, 8, 16, 32)
#: Memory of a group of queries with their statistics; vectors that the rotation is fitted on.
GROUP_MB, SAMPLE = 32, 4096
QUERIES_AT_ONCE = 32
CANDIDATES_AT_ONCE = 4096
NO_ID = np.iinfo(np.int64).max


def matrices(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of floor(scale * x)) for each length of the vectors that take part."""
    n = len(vectors)
    if not n:
        return
    keys = np.array([NO_ID if x is None else x for x in ids.to_pylist()], np.int64)
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    ends = vectors.offsets.to_numpy()
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    for d in np.unique(lengths[valid]):
        rows = np.flatnonzero(valid & (lengths == d))
        m = values[ends[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore", invalid="ignore"):
            m = np.floor(m * scale)
        whole = np.isfinite(m).all(axis=1)
        yield keys[rows[whole]], m[whole]


def cuts(d: int, segments: int) -> np.ndarray:
    """Starts of segments: single places first, then equal parts of the rest."""
    if segments >= d:
        return np.arange(d)
    single = segments // 2
    return np.concatenate((np.arange(single), single + np.arange(segments - single) * (d - single) // (segments - single)))


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * deviation of each segment; the inner product of two such rows is the bound."""
    d = m.shape[1]
    if not d:
        return np.zeros((len(m), 1))
    at = cuts(d, segments)
    size = np.diff(np.append(at, d))
    with np.errstate(over="ignore", invalid="ignore"):
        mean = np.add.reduceat(m, at, axis=1) / size
        spread = np.add.reduceat((m - np.repeat(mean, size, axis=1)) ** 2, at, axis=1)
    return np.hstack((mean * np.sqrt(size), np.sqrt(spread[:, size > 1])))


def axes(m: np.ndarray) -> np.ndarray:
    """The principal axes of the rows, widest first, as columns."""
    with np.errstate(over="ignore", invalid="ignore"):
        centred = m - m.mean(axis=0)
        spread = centred.T @ centred
    return np.linalg.eigh(spread)[1][:, ::-1] if np.isfinite(spread).all() else np.eye(m.shape[1])


class Search:
    """The k best of all candidates seen, for queries of one length."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, m: np.ndarray, k: int, rotation: np.ndarray | None = None):
        self.ids, self.keys, self.m, self.k, self.rotation = ids, keys, m, k, rotation
        self.levels = self.bounds(m)
        self.norm = np.sqrt((m * m).sum(axis=1))
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)
        #: Pairs met, and pairs left after each level of bounds.
        self.pairs, self.left = 0, [0] * len(SEGMENTS)

    def bounds(self, m: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            turned = m if self.rotation is None or len(self.rotation) != m.shape[1] else m @ self.rotation
        return [statistics(turned, s) for s in SEGMENTS]

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        levels = self.bounds(m)
        norm = np.sqrt((m * m).sum(axis=1))
        exact = float(np.abs(m).max(initial=0)) * float(np.abs(self.m).max(initial=0)) * m.shape[1] < 2**53
        for i in range(0, len(self.ids), QUERIES_AT_ONCE):
            q = slice(i, i + QUERIES_AT_ONCE)
            other = self.ids[q][:, None] != ids[None, :]
            self.pairs += int(other.sum())
            a, b = None, None
            for level, (mine, theirs) in enumerate(zip(self.levels, levels)):
                # the first level for the block, the finer ones for the pairs that are left; what overflows stays
                if a is None:
                    keep = other & ~(mine[q] @ theirs.T + 1e-9 * self.norm[q][:, None] * norm[None, :] < self.least[q][:, None])
                    a, b = np.nonzero(keep)
                    a += i
                else:
                    bound = np.einsum("ij,ij->i", mine[a], theirs[b]) if len(a) < other.size // 4 else (mine[q] @ theirs.T)[a - i, b]
                    keep = ~(bound + 1e-9 * self.norm[a] * norm[b] < self.least[a])
                    a, b = a[keep], b[keep]
                self.left[level] += len(a)
            if not len(a):
                continue
            scores = np.einsum("ij,ij->i", self.m[a], m[b]) if len(a) < other.size // 4 else (self.m[q] @ m.T)[a - i, b]
            keep = ~(scores + 1e-9 * self.norm[a] * norm[b] < self.least[a])
            a, b, scores = a[keep], b[keep], scores[keep]
            start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else a
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(a)]):
                self.merge(int(a[s]), ids[b[s:e]], scores[s:e] if exact else None, m[b[s:e]])

    def merge(self, j: int, ids: np.ndarray, scores: np.ndarray | None, m: np.ndarray) -> None:
        if scores is None:  # beyond what doubles hold exactly
            mine = list(map(int, self.m[j]))
            new = [(-sum(a * int(b) for a, b in zip(mine, row)), int(x)) for row, x in zip(m, ids)]
        else:
            if len(ids) > 4 * self.k:
                first = np.lexsort((ids, -scores))[: self.k]
                ids, scores = ids[first], scores[first]
            new = [(-int(s), x) for s, x in zip(scores.tolist(), ids.tolist())]
        self.best[j] = heapq.nsmallest(self.k, self.best[j] + new)
        if len(self.best[j]) == self.k:
            self.least[j] = max(self.least[j], float(-self.best[j][-1][0]))


BLOCKS = "d int, ids binary, keys binary, m binary"
OUT = "query_id long, key long, vec_id long, score long, high decimal(38,0)"


def _blocks(scale: float):
    """Rows (vec_id, v, key) as blocks: the vectors of one length that take part, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), CANDIDATES_AT_ONCE):
                part = batch.slice(i, CANDIDATES_AT_ONCE)
                keys, out = part.column(2).to_numpy(), []
                # places stand for ids here, so that each vector finds its id and key again
                ids = np.array([NO_ID if x is None else x for x in part.column(0).to_pylist()], np.int64)
                for place, m in matrices(pa.array(np.arange(len(part))), _flat(part.column(1)), scale):
                    out.append((m.shape[1], ids[place].tobytes(), keys[place].tobytes(), m.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["d", "ids", "keys", "m"])

    return run


def top_k(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].cast("array<double>").alias("v")).withColumn("key", F.xxhash64("vec_id", "v"))
    asked = rows.where(is_query & F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    size = asked.agg(F.sum(F.size("v"))).collect()[0][0] or 0
    # a vector takes its own 8 bytes a component, and about twice as many for all levels
    n, groups = partitions(spark), max(1, math.ceil(24 * size / (GROUP_MB * 1_000_000)))
    queries = asked.dropDuplicates(["vec_id", "v"]).repartition(groups, "key").mapInArrow(_blocks(scale), BLOCKS)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # blocks of queries go to all groups of candidates, blocks of candidates to all groups of queries
    queries = queries.withColumn("g", F.pmod(F.xxhash64("keys"), F.lit(groups)).cast("int")).withColumn("c", each(n)).withColumn("side", F.lit(0))
    candidates = rows.where("v is not null").mapInArrow(_blocks(scale), BLOCKS)
    candidates = candidates.withColumn("c", F.pmod(F.xxhash64("keys"), F.lit(n)).cast("int")).withColumn("g", each(groups)).withColumn("side", F.lit(1))
    met = queries.unionByName(candidates).select("g", "c", "side", "d", "ids", "keys", "m").repartition(n, "g", "c").sortWithinPartitions("g", "c", "side")
    found = met.mapInArrow(_search(_rotations(rows, scale), k), OUT)
    w = Window.partitionBy("query_id", "key").orderBy(F.desc("high"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rotations(rows: DataFrame, scale: float) -> dict[int, np.ndarray]:
    """Principal axes by length of vectors, from SAMPLE vectors at most."""
    sample = rows.where("v is not null").orderBy("key").limit(SAMPLE).select("vec_id", "v").toArrow().combine_chunks()
    return {m.shape[1]: axes(m) for _, m in matrices(sample.column("vec_id").combine_chunks(), _flat(sample.column("v")), scale) if len(m) and m.shape[1]} if len(sample) else {}


def _search(rotations: dict[int, np.ndarray], k: int):
    def told(searches: dict[int, list[Search]]) -> Iterator[pa.RecordBatch]:
        clip = 10**38 - 1
        for s in (s for own in searches.values() for s in own):
            out = [(int(q), int(key), None if x == NO_ID else x, max(-(2**63), min(2**63 - 1, -n)), max(-clip, min(clip, -n))) for q, key, best in zip(s.ids, s.keys, s.best) for n, x in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.decimal128(38, 0)])], ["query_id", "key", "vec_id", "score", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, searches = None, {}
        for b in batches:
            for i in range(len(b)):
                g, c, side, d = (b.column(j)[i].as_py() for j in range(4))
                ids, keys, m = (np.frombuffer(b.column(j)[i].as_buffer(), kind) for j, kind in ((4, np.int64), (5, np.int64), (6, np.float64)))
                if (g, c) != at:
                    yield from told(searches)
                    at, searches = (g, c), {}
                m = m.reshape(len(ids), d)
                if side == 0:
                    searches.setdefault(d, []).append(Search(ids, keys, m, k, rotations.get(d)))
                else:
                    for s in searches.get(d, ()):
                        s.add(ids, m)
        yield from told(searches)

    return run


def _flat(column) -> pa.Array:
    """A list array with offsets from 0, whatever slice it was."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.take(pa.array(np.arange(len(column)))) if len(column) else column


def query(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.pmod("vec_id", F.lit(100)) == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::bigint AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::int AS rank, vec_id, score FROM ranked WHERE r <= 10"""

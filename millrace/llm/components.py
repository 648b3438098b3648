"""Connected components by alternating large and small stars, without an unbounded group in any task.

A star is made by joins and minima, never by collecting a node's neighbours: minima are combined before the shuffle, and
AQE splits the join's partitions that a hub makes large. Each round is checkpointed to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Edges that one task joins at once, 3 MB; more are contracted by rounds of stars until so few are left, or nothing changes.
ONE_TASK = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For linked values a, b: (each value, the least of its component), by label propagation with pointer jumping."""
    values, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(values))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        for e in (root[x], root[y], x, y):
            np.minimum.at(new, e, least)
        while (jumped := new[new] != new).any():
            new[jumped] = new[new][jumped]
        if (new == root).all():
            return values, values[root]
        root = new


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        node, root = forest(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node of its component.

    Nodes are longs. Null ends, loops and repeated edges are passed over; no edges, no rows. A round that changes nothing ends
    the loop, which two numbers tell: the count and the sum of hashes of the edges.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e = kept(e)
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).collect()[0])
        if now[0] <= ONE_TASK:
            return e.repartition(1).mapInArrow(_joined, "node long, root long")
        if now == before:
            return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select("u", "u").distinct())
        before = now
        # large star: each greater neighbour of a node to the least of the node and its neighbours
        both = e.select(F.col("v").alias("n"), F.col("u").alias("m")).union(e.select("u", "v"))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("l"))
        e = both.where("m > n").join(least, "n").select(F.col("m").alias("v"), F.col("l").alias("u")).where("v <> u").distinct()
        # small star: the lesser neighbours of a node, and the node, to the least of them
        least = e.groupBy("v").agg(F.min("u").alias("l"))
        e = e.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("l").alias("u")), F.struct(F.col("v"), F.col("l").alias("u")))).alias("x")).select("x.v", "x.u").where("v <> u").distinct()
        e = kept(e)

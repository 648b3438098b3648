"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint's bit is set if it is set in more than half of the XXH64 hashes (seed 42) of the text's 3-word shingles.
Two fingerprints link if they differ in `BITS` = 2 bits or fewer.

The index's upper nodes are masked bit patterns: of the eight bytes of a fingerprint any two are masked out, 28 masks in
all, and the other six bytes are the pattern that a node's members share. Two fingerprints that differ in two bits differ
in two bytes at most, so some node holds both; and a node has no more than 65,536 distinct members, whatever the corpus,
so no cap is needed. Members lie in the Gray order of their masked-out bytes. Below a node they are factored once more, by
the high one of these bytes: two such lower nodes are compared by their differing bits, and the members of those that
differ in more than two are pruned as a group; for the others the differences accumulate with those of the low byte.

What a task finds is given out as a forest (each member to the least fingerprint it is linked with in that chunk), not as
all pairs. Copies meet before the index: it holds distinct fingerprints only.

What Gray order does here is to bring the members of a lower node together, in an order in which neighbours differ in one bit;
the pruning itself is by the accumulated differences. `nearcopies` is for similarity of the texts instead.

Nulls and edges: a null or empty text has fingerprint zero and links like any other. A component's id is its least
doc_id, null if all are null. Rows of the same doc_id each get a row. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, partitions
from .components import components, forest

BITS = 2
SHINGLE = 3
MASKS = list(combinations(range(8), 2))
#: Rows after which a task closes a chunk, at the next node's start.
CHUNK = 200_000
#: Pairs expanded at once.
PAIRS = 2_000_000
ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles, repeats included; none for a text without words."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the white space of the contract
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in joined), np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp) for each row of docs (doc_id, text); th is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], pa.int64())], ["doc_id", "th", "fp"])

    return slim(docs).mapInArrow(run, "doc_id long, th long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The rank of 16-bit patterns in Gray order."""
    x = x.astype(np.uint16)
    for s in (1, 2, 4, 8):
        x = x ^ (x >> np.uint16(s))
    return x


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each fingerprint under its 28 upper nodes: (node: mask and pattern, gray: Gray rank of the masked-out bytes)."""
    for b in batches:
        fp = np.ascontiguousarray(b["fp"].to_numpy(np.int64))
        octets = fp.view(np.uint8).reshape(-1, 8)
        for m, (low, high) in enumerate(MASKS):
            rest = [i for i in range(8) if i not in (low, high)]
            pattern = np.zeros((len(fp), 8), np.uint8)
            pattern[:, :6] = octets[:, rest]
            pattern[:, 6] = m
            code = octets[:, high].astype(np.uint16) << np.uint16(8) | octets[:, low]
            yield pd.DataFrame({"node": pattern.view(np.int64)[:, 0], "gray": gray_rank(code).astype(np.int32), "fp": fp})


def linked(node: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers within a node whose fingerprints differ in `bits` or fewer. Rows lie by node and Gray rank."""
    mask = ((node.view(np.uint64) >> np.uint64(48)) & np.uint64(0xFF)).astype(np.int64)
    octets = fp.view(np.uint8).reshape(-1, 8)
    lows, highs = np.array(MASKS).T
    rows = np.arange(len(fp))
    low, high = octets[rows, lows[mask]], octets[rows, highs[mask]]
    # lower nodes: runs of rows of equal node and high byte
    start = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (high[1:] != high[:-1]))))
    size = np.diff(np.append(start, len(fp)))
    own, top = node[start], high[start]
    left, right, acc = [np.arange(len(start))[size > 1]], [np.arange(len(start))[size > 1]], [np.zeros((size > 1).sum(), np.int64)]
    d = 1
    while d < len(start) and len(at := np.flatnonzero(own[d:] == own[:-d])):
        differ = ONES[top[at] ^ top[at + d]]
        near = differ <= bits
        left.append(at[near])
        right.append(at[near] + d)
        acc.append(differ[near])
        d += 1
    left, right, acc = map(np.concatenate, (left, right, acc))
    # members of the lower nodes that are left, in blocks of bounded size
    n = size[left] * size[right]
    out_a, out_b = [], []
    ends = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, side="right")))
        reps = n[i:j]
        which = np.repeat(np.arange(i, j), reps)
        k = np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
        a, b = start[left[which]] + k // size[right[which]], start[right[which]] + k % size[right[which]]
        near = (a < b) & (acc[which] + ONES[low[a] ^ low[b]] <= bits)
        out_a.append(a[near])
        out_b.append(b[near])
        i = j
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the nodes in a task's rows, which lie by node and Gray rank; chunks end between nodes."""

    def links(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = linked(node, fp)
        v, r = forest(fp[a], fp[b]) if len(a) else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(v[v != r]), pa.array(r[v != r])], ["a", "b"])

    nodes, fps, n = [], [], 0
    for batch in batches:
        nodes.append(batch.column(0).to_numpy())
        fps.append(batch.column(1).to_numpy())
        n += len(batch)
        if n >= CHUNK:
            node, fp = np.concatenate(nodes), np.concatenate(fps)
            cut = int(np.searchsorted(node[::-1] != node[-1], True))
            cut = len(node) - cut
            if cut:
                yield links(node[:cut], fp[:cut])
            nodes, fps, n = [node[cut:]], [fp[cut:]], len(node) - cut
    if n:
        yield links(np.concatenate(nodes), np.concatenate(fps))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of linked fingerprints that join the same components as all pairs do. distinct: one column, fp."""
    nodes = distinct.mapInPandas(_spread, "node long, gray int, fp long")
    n = partitions(distinct.sparkSession)
    return nodes.repartition(n, "node").sortWithinPartitions("node", "gray").select("node", "fp").mapInArrow(_search, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp, fingerprint (16 hex digits), component_id for each row of docs (doc_id, text)."""
    rows = kept(fingerprints(docs))
    distinct = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp")))
    d = distinct.alias("d").join(roots.alias("r"), F.col("d.fp") == F.col("r.node"), "left").select("d.fp", "d.least", F.coalesce("r.root", "d.fp").alias("root"))
    d = kept(d)
    least = d.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = d.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "th", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def slim(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].cast("string").alias("text"))


def query(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")

"""Inverted index in blocks of documents, so that no task holds a frequent term's whole list.

A block is `BLOCK` consecutive document numbers. Within (term, block) postings lie in order of document and are encoded as
df, then gap and tf each, as variable-length integers; a block's first gap is its absolute number. The wide-row layout has
absolute numbers throughout, and the block as its qualifier. Terms' totals come from the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import ranges, tallied
from ..functions.vint import decode_each, encode_each
from ..functions.words import coded, lowered, octets, slices, words

BLOCK = 65_536
#: A posting before it is encoded: the document's place in its block, and how often it has the term.
POSTING = np.dtype([("doc", "<u2"), ("tf", "<u4")])
#: Bytes of an index decoded at once, and rows given out at once.
READ, ROWS = 1 << 20, 200_000
#: Rows of a term and block taken at once: their numbers, places and counts fit 63 bits side by side.
GROUPS = 8192


def _found(packed: bool, only: tuple[str, ...] | None = None):
    """The postings of (doc, lower-cased text), some documents at a time: (term, doc, tf), or packed (term, block, data), where a posting
    is six bytes: the document's place in its block, and how often it has the term. only: other terms are left out."""

    def own(part: pa.RecordBatch, null: bool) -> Iterator[pa.RecordBatch]:
        flat, sizes = words(part.column(1))
        if only is not None:
            good = pc.is_in(flat, value_set=pa.array(only, flat.type)).to_numpy(zero_copy_only=False)
            sizes = np.diff(np.concatenate(([0], np.cumsum(good)))[np.concatenate(([0], np.cumsum(sizes)))])
            flat = flat.filter(pa.array(good))
        if not len(flat):
            return
        codes, distinct = coded(flat)
        # by term, then document; rows of the same document are one
        ids, doc = np.unique(part.column(0).to_numpy(), return_inverse=True)
        keys, tf = tallied(codes * len(ids) + np.repeat(doc, sizes))
        term, doc = keys // len(ids), ids[keys % len(ids)]
        names = lambda t: distinct.take(pa.array(t)).cast(pa.string())
        if not packed:
            yield pa.RecordBatch.from_arrays([names(term), pa.nulls(len(doc), pa.int64()) if null else pa.array(doc), pa.array(tf)], ["term", "doc", "tf"])
            return
        block = doc // BLOCK
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
        rows = np.zeros(len(doc), POSTING)
        rows["doc"], rows["tf"] = doc - block * BLOCK, tf
        yield pa.RecordBatch.from_arrays([names(term[first]), pa.array(block[first]), binaries(rows.view(np.uint8), np.append(first, len(doc)) * POSTING.itemsize)], ["term", "block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 1)):
            if part.column(0).null_count:
                for null in (False, True):
                    some = part.filter(pc.equal(pc.is_null(part.column(0)), null))
                    yield from own(pa.RecordBatch.from_arrays([pc.fill_null(some.column(0), 0), some.column(1)], ["doc", "text"]), null)
            else:
                yield from own(part, False)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), lowered(F.col("text")).alias("text"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc, tf) of (doc_id, text). Rows of the same doc_id count as one document, those of a null one too."""
    found = _numbered(docs).mapInArrow(_found(False), "term string, doc long, tf long")
    return found.groupBy("term", "doc").agg(F.sum("tf").alias("tf"))


def block_of(doc: Column) -> Column:
    return F.floor(doc / F.lit(BLOCK)).cast("long")


def terms(p: DataFrame) -> DataFrame:
    """(term, df, total_tf, first_doc, last_doc)."""
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))


def gaps(p: DataFrame) -> DataFrame:
    """(term, doc, gap, tf): gap to the term's previous document; the first one's is its own number.

    Within a block by a window of `BLOCK` rows at most; over blocks by the last document of the block before.
    """
    b = p.withColumn("block", block_of(F.col("doc")))
    inner = b.withColumn("before", F.lag("doc").over(Window.partitionBy("term", "block").orderBy("doc")))
    last = b.groupBy("term", "block").agg(F.max("doc").alias("last"))
    last = last.select("term", "block", F.lag("last").over(Window.partitionBy("term").orderBy("block")).alias("carry"))
    return inner.join(last, ["term", "block"]).select("term", "doc", (F.col("doc") - F.coalesce("before", "carry", F.lit(0))).alias("gap"), "tf")


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array of parts of the bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _framed(with_gaps: bool):
    """(term, block, df, postings), the postings encoded, of rows (term, block, data) that lie by term and block."""

    def rows(b: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        """first: the row numbers at which a term and block begins."""
        data, offsets = octets(b.column(2))
        p = data.view(POSTING)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(offsets[first], offsets[-1])) // POSTING.itemsize)
        both = np.sort((group << 16 | p["doc"]) << 32 | p["tf"])
        keys = both >> 32
        one = np.flatnonzero(np.diff(keys, prepend=-1))
        tf = np.add.reduceat(both & 0xFFFFFFFF, one)
        group, block = keys[one] >> 16, b.column(1).to_numpy()[first]
        doc = block[group] * BLOCK + (keys[one] & 0xFFFF)
        df = np.bincount(group, minlength=len(first))
        start = np.cumsum(df) - df
        if with_gaps:
            gap = np.diff(doc, prepend=0)
            gap[start] = doc[start]
            doc = gap
        # df, then two numbers for each posting
        flat, at = np.zeros(2 * len(doc) + len(first), np.int64), np.arange(len(doc)) * 2 + group + 1
        flat[at], flat[at + 1], flat[2 * start + np.arange(len(first))] = doc, tf, df
        out, size = encode_each(flat)
        ends = np.concatenate(([0], np.cumsum(size)))[np.append(2 * start + np.arange(len(first)), len(flat))]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first)), pa.array(block), pa.array(df), binaries(out, ends)], ["term", "block", "df", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for part in (p.slice(i, GROUPS) for p in slices(b, 2) for i in range(0, len(p), GROUPS)):
                held.append(part)
                x = pa.concat_batches(held) if len(held) > 1 else part
                term, block = x.column(0), x.column(1).to_numpy()
                new = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
                first = np.concatenate(([0], np.flatnonzero(new) + 1))
                if len(first) > 1:  # the last one may go on
                    yield rows(x.slice(0, first[-1]), first[:-1])
                    x = x.slice(first[-1])
                held = [x]
        if held:
            yield rows(held[0], np.zeros(1, np.int64))

    return run


def build(docs: DataFrame, wide: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """The index of (doc_id, text): gap-encoded file layout, or the wide-row layout (term, qualifier, df, postings).

    Postings are packed by the tasks that read the texts, so what is shuffled is a row for each term, block and some documents. only:
    the terms of a query that reads the index once; as a filter of the index would, they are picked before the shuffle. Documents whose doc_id is null aren't in an index.
    """
    packed = _numbered(docs).where("doc is not null").mapInArrow(_found(True, only), "term string, block long, data binary")
    f = packed.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(_framed(not wide), "term string, block long, df long, postings binary")
    return f.withColumnRenamed("block", "qualifier") if wide else f


def _unframed(with_gaps: bool):
    """(term, doc, tf) of rows (term, postings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 1, READ)):
            numbers, size = decode_each(*octets(part.column(1)))
            start = np.cumsum(size) - size
            df = numbers[start]
            at = ranges(start + 1, 2 * df).reshape(-1, 2)
            doc, tf = numbers[at[:, 0]], numbers[at[:, 1]]
            if with_gaps:
                total, first = np.cumsum(doc), np.cumsum(df) - df
                doc = total - np.repeat((total - doc)[np.minimum(first, len(doc) - 1)], df)
            term = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), df)))
            for i in range(0, len(doc), ROWS):
                yield pa.RecordBatch.from_arrays([term[i : i + ROWS], pa.array(doc[i : i + ROWS]), pa.array(tf[i : i + ROWS])], ["term", "doc", "tf"])

    return run


def read(index: DataFrame) -> DataFrame:
    """(term, doc, tf) of either layout; df bounds what is read of a row's bytes."""
    return index.select("term", "postings").mapInArrow(_unframed("qualifier" not in index.columns), "term string, doc long, tf long")

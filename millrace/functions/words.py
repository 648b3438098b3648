"""The tokens of `text.tokens` for whole Arrow columns at once, for tasks that go on in Python: no regular expression, no object a token.

Texts come lower-cased by `lowered`, so letters are those that Spark's own function gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of texts looked at at once, some 15 times as much in memory; a longer text is looked at alone.
BYTES = 4 << 20


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def octets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each one begins, and the last one ends. No text is null."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int = 0, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many bytes of the column's texts."""
    ends = octets(batch.column(column))[1]
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts, one text after the other, and how many each text has."""
    x, offsets = octets(texts)
    letters = np.flatnonzero((x - np.uint8(97)) < 26)
    # between two bounds lies a run without white space; it has letters or it is no token
    space = np.flatnonzero((x == 32) | ((x - np.uint8(9) < 5) & (x != 11)))
    bounds = np.sort(np.concatenate((space, offsets)), kind="stable")
    at = np.searchsorted(letters, bounds)
    some = np.flatnonzero(at[1:] > at[:-1])
    first, last = letters[at[some]], letters[at[some + 1] - 1] + 1
    step = np.zeros(len(x) + 1, np.int8)
    step[first] += 1
    step[last] -= 1
    data = x[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    ends = np.concatenate(([0], np.cumsum(last - first)))
    kind, flat = (np.int32, pa.string()) if len(data) < 2**31 else (np.int64, pa.large_string())
    tokens = pa.Array.from_buffers(flat, len(first), [None, pa.py_buffer(ends.astype(kind)), pa.py_buffer(data)])
    return tokens, np.diff(np.searchsorted(first, offsets))


def coded(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each token's place in the array of distinct ones, and that array."""
    d = tokens.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary

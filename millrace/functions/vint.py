"""Variable-length integers for postings, in the public one-to-five-byte format of Hadoop's writeVInt, vectorised.

-112 to 127 take one byte. Others take a length byte (-112 - n, or -120 - n for negative numbers, whose complement is
stored) and n bytes, the highest first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_each(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers' bytes, one after the other, and how many each number has. Numbers must fit 64 bits."""
    x = np.asarray(numbers, np.int64)
    long = np.flatnonzero((x < -112) | (x > 127))
    y = x[long]
    body = np.where(y < 0, ~y, y).astype(np.uint64)
    n = np.maximum(1, sum((body >> np.uint64(8 * i) != 0).astype(np.int64) for i in range(8)))
    size = np.ones(len(x), np.int64)
    size[long] += n
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    first = x.copy()
    first[long] = np.where(y < 0, -120 - n, -112 - n)
    out[start] = first.astype(np.int8).view(np.uint8)
    for i in range(1, 9):
        at = n >= i
        out[start[long[at]] + i] = (body[at] >> (8 * (n[at] - i)).astype(np.uint64)).astype(np.uint8)
    return out, size


def encode(numbers: np.ndarray) -> bytes:
    """The numbers' bytes, one after the other. Numbers must fit 64 bits."""
    return encode_each(numbers)[0].tobytes()


def decode_each(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows' bytes, and how many each row has. Row i's bytes lie from offsets[i] to offsets[i + 1]."""
    first = data.view(np.int8).astype(np.int64)
    more = np.where(first >= -112, 0, np.where(first >= -120, -112 - first, -120 - first))
    # where the next number starts, in the same row or at the next one's first byte
    end = np.repeat(offsets[1:], np.diff(offsets))
    step = np.append(np.minimum(np.arange(len(data)) + 1 + more, end), len(data))
    # a byte starts a number if a row does there, or no byte of the eight before can lead a longer one; others are found by steps of doubled width
    led = np.cumsum(np.append(0, more > 0))
    mark = np.append(led[:-1] == led[np.maximum(np.arange(len(data)) - 8, 0)], True)
    mark[offsets] = True
    known = -1
    while known < (known := np.count_nonzero(mark)):
        mark[step[np.flatnonzero(mark)]] = True
        step = step[step]
    at = np.flatnonzero(mark[:-1])
    out, more = first[at], more[at]
    long = np.flatnonzero(more)
    value = np.zeros(len(long), np.int64)
    for i in range(1, 9):
        within = more[long] >= i
        value[within] = value[within] << 8 | data[np.minimum(at[long[within]] + i, len(data) - 1)]
    out[long] = np.where(out[long] >= -120, value, ~value)
    return out, np.diff(np.searchsorted(at, offsets))


def decode(data: bytes) -> list[int]:
    """The numbers of `encode`'s bytes."""
    out, i, signed = [], 0, np.frombuffer(data, np.int8)
    while i < len(data):
        first, i = int(signed[i]), i + 1
        if first >= -112:
            out.append(first)
            continue
        n = -112 - first if first >= -120 else -120 - first
        x = int.from_bytes(data[i : i + n], "big")
        out.append(x if first >= -120 else ~x)
        i += n
    return out


@F.pandas_udf(T.BinaryType())
def encoded(numbers: pd.Series) -> pd.Series:
    """A column of number lists, encoded."""
    return numbers.map(lambda x: None if x is None else encode(x))

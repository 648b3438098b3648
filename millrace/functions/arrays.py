"""Small steps on arrays of numbers."""

from __future__ import annotations

import numpy as np


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of the ranges of these starts and sizes, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))

"""Texts of Arrow batches as code points in numpy, a bounded number of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, code points, offsets) of runs of rows of about size bytes; a text is never cut.

    A null counts as an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    low = 0
    while low < len(texts):
        high = min(max(int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1, low + 1), len(texts))
        part = data[offsets[low] : offsets[high]]
        before = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])  # bytes that begin a character
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
        yield low, high, points, before[offsets[low : high + 1] - offsets[low]]
        low = high


def windows(offsets: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n places begin a window of width places within one row."""
    whole = np.ones(n, dtype=bool)
    for k in range(1, width):
        ends = offsets[1:] - k
        whole[ends[ends >= offsets[:-1]]] = False
    return whole


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the values of each row; zero for an empty one."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out

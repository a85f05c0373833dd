"""Vectorised work on the UTF-8 bytes of whole Arrow batches: words, rolling hashes, set arithmetic.

A slab is a run of rows whose bytes are handled at once; a text longer than the slab size is a slab of its own,
so no text is ever cut. All hashes are 64-bit polynomials over a table of random byte codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1

_rng = np.random.default_rng(20240229)
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: everything but white space; letters, digits and all above ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i up to n."""
    if len(_powers.get("up", ())) <= n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            out = np.full(size, base & (2**64 - 1), dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slabs(texts: pa.Array, size: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(max(high, low + 1), len(texts))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of kept bytes; a run never crosses two rows."""
    n = len(keep)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = keep[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = keep[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(keep & ~before)
    ends = np.flatnonzero(keep & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(CODES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes, the same wherever the span lies."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of every word."""
    starts, ends, rows = runs(table[data], offsets)
    return span_hashes(prefix_sums(data), starts, ends), rows, starts, ends


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        out = out * np.uint64(BASE) + hashes[i : i + n]
    return mix(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and count, joined."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    out = np.ones(total, dtype=np.int64)
    full = counts > 0
    starts, counts = starts[full], counts[full]
    heads = np.cumsum(counts) - counts
    out[0] = starts[0]
    out[heads[1:]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def unique_within(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs in order of row and value."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[first], values[first]

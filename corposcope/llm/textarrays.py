"""Text columns as flat NumPy arrays: many documents per vector operation."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2_000_000  #: bytes handled at once; a longer document is a chunk of its own


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls read as empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[off[0]:off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``most`` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64, Steele et al. 2014)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each."""
    if _pow[0].size < n:
        inv = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inv)):
            step = np.full(n, base & ((1 << 64) - 1), np.uint64)
            step[0] = 1
            _pow[k] = np.multiply.accumulate(step)
    return _pow[0][:n], _pow[1][:n]


def run_hashes(values: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of maximal runs where ``inside`` holds.

    The hash is a polynomial over the run's values relative to its start, taken
    from one wrapping cumulative sum, so cost does not depend on run lengths.
    """
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(values.size + 1)
    total = np.zeros(values.size + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:values.size], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start])


def windows(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive tokens (len - width + 1 of them)."""
    n = tokens.size - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(_BASE & ((1 << 64) - 1)) + tokens[j:j + n]
    return mix(out)

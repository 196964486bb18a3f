"""Vectorised text kernels over Arrow string buffers (numpy, whole batches at a time).

Every function works on UTF-8 bytes. Spans of bytes get a 64-bit hash from one prefix sum:
with S[i] = sum of T[byte_j] * P**j over j < i (mod 2**64), the hash of [a, b) is
(S[b] - S[a]) * P**-a, so all spans of a chunk cost one pass. Working memory is bounded by
``LIMIT`` bytes of text, or by the longest single span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass takes.
LIMIT = 1 << 19
U = np.uint64
P = 0x9E3779B97F4A7C15
PINV = pow(P, -1, 1 << 64)
T = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, LIMIT + 1), base, np.uint64)
        steps[0] = 1
        have = _tables[kind] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + U((seed * P + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ascending, disjoint byte spans [a, b) of data."""
    out = np.empty(len(a), np.uint64)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(b, a[i] + LIMIT, "right")))
        lo, hi = int(a[i]), int(b[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(T[data[lo:hi]] * _powers("p", P, hi - lo), out=sums[1:])
        left = a[i:j] - lo
        out[i:j] = (sums[b[i:j] - lo] - sums[left]) * _powers("inv", PINV, hi - lo + 1)[left]
        i = j
    return mix(out)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string array; a null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(column, limit: int = LIMIT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets from 0) of runs of whole rows of about ``limit`` bytes."""
    offsets, data = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds): maximal runs without ASCII white space; row k has words bounds[k]:bounds[k+1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = ~space
    start[1:] &= space[:-1] | first[1:-1]
    end = ~space
    end[:-1] &= space[1:] | first[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's word shingles (A-Z lowered); fewer words make one shingle."""
    data = LOWER[data]
    start, end, bounds = words(data, offsets)
    hashes = span_hashes(data, start, end)
    n = max(0, len(hashes) - width + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(width):
        runs += hashes[k : k + n] * U(pow(P, 2 * k + 1, 1 << 64))
    runs = mix(runs)
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if j - i >= width:
            out.append(np.unique(runs[i : j - width + 1]))
        elif j > i:
            few = np.sum(hashes[i:j] * _powers("p", P, j - i + 1)[1:], dtype=np.uint64)
            out.append(mix(np.array([few], np.uint64), seed=j - i))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's LONG."""
    return np.ascontiguousarray(x).view(np.int64)

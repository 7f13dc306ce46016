"""Vectorised byte-level text helpers for Arrow batches: word bounds, word hashes and bounded slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes of words [^\x20\x09-\x0D]+; in UTF-8 all bytes of other characters are >= 0x80 and so belong to words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: The bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(2**40, 2**62)) * 2 + 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
_SPAN = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _SPAN)
        out = []
        for base in (_BASE, _INV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """The batch in pieces of about `most` bytes of text, one row at least."""
    col = batch.column(column)
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(size):
        return
    block = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(size)], strict=True):
        yield batch.slice(int(a), int(b - a))


def word_bounds(low: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and the row each belongs to."""
    m = is_word[low]
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(len(m) + 1, bool)  # a row begins here
    edge[offsets] = True
    before = np.empty(len(m), bool)
    before[0] = False
    before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:-1]))
    after = np.empty(len(m), bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes; spans are in ascending order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[low[a:b]] * up[: b - a], out=total[1:])
        s = starts[i:j] - a
        out[i:j] = (total[ends[i:j] - a] - total[s]) * down[s]
        i = j
    return mix64(out + (ends - starts).astype(np.uint64))


def crc32_of_id(column: pa.Array) -> np.ndarray:
    """crc32 of each id as decimal text; a null id counts as the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) for x in column.to_pylist()], np.int64)

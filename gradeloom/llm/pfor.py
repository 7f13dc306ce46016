"""Patched frame-of-reference files of token ids.

A file holds blocks of 256 ids (the last may be shorter), then the documents' first positions, the block starts and a
footer. A block: the minimum (uint32), count (uint16), width and number of exceptions less the widths' room (uint8,
uint16), 256 values of `width` bits each in groups of 64, then the exceptions' positions (uint8) and values (uint32).
The width is the one of the candidate percentiles of the block that makes it smallest.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 256
MAGIC = b"PFORIDS1"
PERCENTILES = (75, 90, 97, 100)
_HEAD = np.dtype([("base", "<u4"), ("count", "<u2"), ("width", "u1"), ("pad", "u1"), ("exceptions", "<u2")])
_FOOT = struct.Struct("<QQQQQ8s")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of non-negative integers below 2**32, from a double's exponent."""
    return np.maximum((x.astype(np.float64).view(np.int64) >> 52) - 1022, 0).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 256) values below 2**width to (n, 4 * width) 64-bit words."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T.astype(np.uint64))
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(values), 4 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, lanes.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (lanes[word + 1] << np.uint64(64 - shift))
        out[i] = x & mask
    return np.ascontiguousarray(out.T).reshape(-1, BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of the blocks of ids (below 2**32), and each block's start in them."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int64)
    count = np.full(n, BLOCK, np.int64)
    count[-1] = len(ids) - (n - 1) * BLOCK
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1]
    full = full.reshape(n, BLOCK)
    base = full.min(1)
    rest = full - base[:, None]
    bits = _bits(rest)
    # of each block, how many values fit into each width; a candidate is the least width that a percentile of them fits
    fit = np.cumsum(np.bincount((np.arange(n)[:, None] * 33 + bits).ravel(), minlength=33 * n).reshape(n, 33), axis=1)
    widths = np.stack([(fit < max(1, -(-BLOCK * p // 100))).sum(1) for p in PERCENTILES], 1)
    cost = 32 * widths + 5 * (BLOCK - np.take_along_axis(fit, widths, 1))
    width = widths[np.arange(n), cost.argmin(1)]
    over = bits > width[:, None]
    extra = over.sum(1)
    size = _HEAD.itemsize + 32 * width + 5 * extra
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros(n, _HEAD)
    head["base"], head["count"], head["width"], head["exceptions"] = base, count, width, extra
    out[start[:, None] + np.arange(_HEAD.itemsize)] = head.view(np.uint8).reshape(n, -1)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        words = _pack(rest[of] & np.uint32((1 << w) - 1), w)
        out[(start[of] + _HEAD.itemsize)[:, None] + np.arange(32 * w)] = words.view(np.uint8).reshape(len(of), -1)
    block, place = np.nonzero(over)
    if len(block):
        nth = np.arange(len(block)) - (np.cumsum(extra) - extra)[block]
        at = start[block] + _HEAD.itemsize + 32 * width[block]
        out[at + nth] = place
        values = np.ascontiguousarray(rest[block, place].astype("<u4")).view(np.uint8).reshape(-1, 4)
        out[(at + extra[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return out.tobytes(), start


def decode_blocks(data: bytes, start: np.ndarray) -> np.ndarray:
    """ids of the blocks at the given starts of data, in order."""
    raw = np.frombuffer(data, np.uint8)
    n = len(start)
    if not n:
        return np.zeros(0, np.uint32)
    head = np.ascontiguousarray(raw[start[:, None] + np.arange(_HEAD.itemsize)]).view(_HEAD).reshape(-1)
    width, extra = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    out = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        words = np.ascontiguousarray(raw[(start[of] + _HEAD.itemsize)[:, None] + np.arange(32 * w)]).view("<u8")
        out[of] = _unpack(words, w)
    if extra.any():
        block = np.repeat(np.arange(n), extra)
        nth = np.arange(len(block)) - (np.cumsum(extra) - extra)[block]
        at = (start + _HEAD.itemsize + 32 * width)[block]
        values = np.ascontiguousarray(raw[(at + extra[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        out[block, raw[at + nth]] = values
    out += head["base"][:, None]
    return out.reshape(-1)[: (n - 1) * BLOCK + int(head["count"][-1])]


class Writer:
    """Streams ids to a file; at most `HELD` ids are in memory."""

    HELD = 1 << 20

    def __init__(self, sink):
        self.sink, self.at, self.starts, self.docs, self.ids, self.held, self.total = sink, len(MAGIC), [], [], [], 0, 0
        sink.write(MAGIC)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """ids of one or more documents, of `counts` ids each."""
        self.docs.append(self.total + np.cumsum(counts) - counts)
        self.ids.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.HELD:
            whole = np.concatenate(self.ids)
            cut = len(whole) // BLOCK * BLOCK
            self._write(whole[:cut])
            self.ids, self.held = [whole[cut:]], len(whole) - cut

    def _write(self, ids: np.ndarray) -> None:
        data, start = encode_blocks(ids)
        self.starts.append(start + self.at)
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.ids))
        docs = np.concatenate(self.docs).astype("<u8") if self.docs else np.zeros(0, "<u8")
        starts = np.concatenate(self.starts).astype("<u8") if self.starts else np.zeros(0, "<u8")
        self.sink.write(docs.tobytes() + starts.tobytes() + _FOOT.pack(self.at, len(docs), len(starts), self.total, 0, MAGIC))


class Reader:
    """Random access by block through the index at the file's end."""

    STEP = 4096

    def __init__(self, source):
        size = source.size()
        end, docs, blocks, self.total, _, magic = _FOOT.unpack(source.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.source, self.end = source, end
        index = source.read_at(8 * (docs + blocks), end)
        self.docs = np.frombuffer(index, "<u8", docs).astype(np.int64)
        self.starts = np.frombuffer(index, "<u8", blocks, 8 * docs).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """ids at positions first (included) to last (not included)."""
        if last <= first:
            return np.zeros(0, np.uint32)
        i, j = first // BLOCK, (last - 1) // BLOCK + 1
        a = int(self.starts[i])
        b = int(self.starts[j]) if j < len(self.starts) else self.end
        got = decode_blocks(self.source.read_at(b - a, a), self.starts[i:j] - a)
        return got[first - i * BLOCK : last - i * BLOCK]

    def documents(self):
        """(first document, ids, offsets) of runs of whole documents, of about STEP blocks."""
        bounds = np.append(self.docs, self.total)
        i = 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + self.STEP * BLOCK, "right")) - 1)
            j = min(j, len(self.docs))
            yield i, self.ids(int(bounds[i]), int(bounds[j])), bounds[i : j + 1] - bounds[i]
            i = j

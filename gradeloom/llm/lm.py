"""LM scoring: a word bigram model whose quantised counts live in a log-frequency Bloom filter.

Counting: every task merges its n-grams' hashes in memory and emits sorted arrays by hash range; ranges are merged by
their own tasks. A bigram of count c has level 1 + floor(log_b c) and is entered in the filter of its range once for each
level up to its own; a count is read by probing levels 1, 2, ... until one is missing. All bigrams enter. The ranges'
segments stay in the shared folder.

Scoring: the bigrams of the highest levels make up a filter of their own, of at most `FILTER_BYTES`, that is broadcast.
What it holds is scored where the text is read. All other bigrams of a text go to the task that has their range's
segment, as packed arrays, are probed there, and come back as one sum per text. A bigram gets the same level on both
ways, so that the bound moves work and not results (beyond the filter's false positives).

Exact token counts never leave the executors as a whole: the tokens whose count is at least a threshold that at most
`HEAD_TOKENS` reach are broadcast, all others are joined by hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm import bytetext as B
from gradeloom.runtime import ship, stored

HEAD_TOKENS = 1 << 20
FILTER_BYTES = 16 << 20
#: Bits and probes of an entry: about one false level in 400.
BITS, PROBES = 12.5, 9
LOG_BASE = 1.5
#: Bigrams of at least this count may be in the broadcast filter.
OFTEN = 8
#: Share of the bigram's relative count in the smoothed probability; the rest is the token's own add-one probability.
SHARE = 0.2
END = np.uint64(0x9E3779B97F4A7C15)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
RANGE_TEXT = 8 << 20
MERGE_AT = 1 << 20
#: Pairs that a scoring task holds before it sends them to their ranges.
SEND_AT = 1 << 20
#: Of a bigram's 64-bit hash, the range's bits and so many more are kept.
KEPT = 40
#: Level of a token whose count is not known where the text is read.
UNKNOWN = 255


def tokens(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the rows, each row's words and then one end, and the number of tokens of each row."""
    raw, at = B.utf8(batch.column(text))
    low = B.LOWER[raw]
    starts, ends, row = B.word_bounds(low, at, B.NOT_SPACE)
    count = np.bincount(row, minlength=batch.num_rows) + 1
    out = np.full(int(count.sum()), END, np.uint64)
    out[np.arange(len(row)) + row] = B.span_hashes(low, starts, ends)
    return out, count


def before(values: np.ndarray, count: np.ndarray, end) -> np.ndarray:
    """The value of the token before each one; a row's first token follows an end."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[np.cumsum(count) - count] = end
    return out


def bigrams(words: np.ndarray, count: np.ndarray, bits: int) -> np.ndarray:
    """Hash of each token with the one before it, the leading `bits` + KEPT bits of it."""
    drop = np.uint64(max(0, 64 - KEPT - bits))
    return B.mix64(before(words, count, END) * np.uint64(0xD6E8FEB86659FD93) + words) >> drop << drop


def pack(keys: np.ndarray, bits: int) -> bytes:
    """The KEPT bits after the range's bits of each key."""
    return (keys << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, : KEPT // 8].tobytes()


def unpack(data, bits: int, part: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, KEPT // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : KEPT // 8] = raw
    low = out.view(">u8")[:, 0].astype(np.uint64) >> np.uint64(bits)
    return low | np.uint64(part << (64 - bits)) if bits else low


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count.astype(np.float64)) / math.log(LOG_BASE) + 1e-9).astype(np.int64)


def level_count(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of its range; level 0 is 0."""
    at = LOG_BASE ** (levels - 1.0)
    return np.where(levels > 0, np.where(levels < 2, 1.0, (np.ceil(at - 1e-9) + np.ceil(at * LOG_BASE - 1e-9) - 1) / 2), 0.0)


class Filter:
    """Log-frequency Bloom filter in segments by the hash's leading bits."""

    def __init__(self, shift: int, segments: dict[int, tuple[int, bytes]]):
        n = 1 << (64 - shift) if shift < 64 else 1
        self.shift = shift
        self.size = np.zeros(n, np.uint64)
        self.base = np.zeros(n, np.int64)
        at, parts = 0, []
        for s in sorted(segments):
            bits, data = segments[s]
            self.size[s], self.base[s] = bits, at * 8
            parts.append(np.frombuffer(data, np.uint8))
            at += len(data)
        self.bytes = np.concatenate([*parts, np.zeros(1, np.uint8)])

    @staticmethod
    def segment(keys: np.ndarray, levels: np.ndarray) -> tuple[int, bytes]:
        bits = max(64, math.ceil(BITS * int(levels.sum())))
        on = np.zeros(bits, bool)
        for j in range(1, int(levels.max(initial=0)) + 1):
            k = keys[levels >= j]
            for i in range(PROBES):
                on[(Filter._probe(k, j, i) % np.uint64(bits)).astype(np.int64)] = True
        return bits, np.packbits(on, bitorder="little").tobytes()

    @staticmethod
    def _probe(keys: np.ndarray, j: int, i: int) -> np.ndarray:
        return B.mix64(keys + np.uint64((j * 64 + i + 1) * int(_GOLD) % (1 << 64)))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        segment = (keys >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(keys), np.int64)
        live = np.flatnonzero(self.size[segment] > 0)
        j = 1
        while len(live):
            for i in range(PROBES):
                s = segment[live]
                at = self.base[s] + (self._probe(keys[live], j, i) % self.size[s]).astype(np.int64)
                live = live[(self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                if not len(live):
                    return out
            out[live] = j
            j += 1
        return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1 if len(values) else np.zeros(0, np.int64)
    return np.concatenate([np.zeros(min(1, len(values)), np.int64), edge]), np.append(edge, len(values)) if len(values) else edge


def count_ngrams(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """A row for each range of the hash, by ord and part (the leading bits), stored.

    ord 1: k and c, the tokens' hashes and counts. ord 2: size (bits) and data of the bigrams' segment, and k and c, the
    hashes and levels of those of count OFTEN or more.
    """
    shift = np.uint64(64 - bits)

    def count(batches):
        held: list[tuple[list, list, int]] = [([], [], 0), ([], [], 0)]

        def flush(o):
            k, c = _merged(*held[o][:2])
            held[o] = ([], [], 0)
            part = (k >> shift).astype(np.int64) if bits else np.zeros(len(k), np.int64)
            pieces = [(o + 1, int(part[a]), pack(k[a:b], bits) if o else k[a:b].tobytes(), c[a:b].astype(np.uint32).tobytes()) for a, b in zip(*_runs(part), strict=True)]
            for i in range(0, len(pieces), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*pieces[i : i + 256], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["ord", "part", "k", "c"])

        for batch in batches:
            for piece in B.slices(batch, text, 1 << 20):
                words, size = tokens(piece, text)
                for o, keys in enumerate((words, bigrams(words, size, bits))):
                    k, c = np.unique(keys, return_counts=True)
                    ks, cs, n = held[o]
                    ks.append(k)
                    cs.append(c.astype(np.uint32))
                    held[o] = (ks, cs, n + len(k))
                    if held[o][2] > MERGE_AT:
                        k, c = _merged(ks, cs)
                        held[o] = ([k], [c], len(k))
                        if len(k) > MERGE_AT // 2:
                            yield from flush(o)
        for o in (0, 1):
            if held[o][2]:
                yield from flush(o)

    def merge(batches):
        now, ks, cs = None, [], []

        def done():
            o, p = now
            k, c = _merged(ks, cs)
            size, data = None, None
            if o == 2:
                lv = level(c)
                size, data = Filter.segment(k, lv)
                k, c = k[c >= OFTEN], lv[c >= OFTEN].astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([p], pa.int64()), pa.array([k.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["ord", "part", "k", "c", "size", "data"])

        for batch in batches:
            for o, p, k, c in zip(batch.column("ord").to_pylist(), batch.column("part").to_pylist(), batch.column("k"), batch.column("c"), strict=True):
                if now != (o, p):
                    if now is not None:
                        yield from done()
                    now, ks, cs = (o, p), [], []
                ks.append(np.frombuffer(k.as_buffer(), np.uint64) if o == 1 else unpack(k.as_buffer(), bits, p))
                cs.append(np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64))
        if now is not None:
            yield from done()

    schema = "ord int, part bigint, k binary, c binary"
    merged = docs.select(text).mapInArrow(count, schema).repartition("ord", "part").sortWithinPartitions("ord", "part").mapInArrow(merge, f"{schema}, size bigint, data binary")
    return stored(merged, "ngrams")


def _unigrams(counts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k, c in zip(batch.column("k"), batch.column("c"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k.as_buffer(), np.int64)), pa.array(np.frombuffer(c.as_buffer(), np.int64))], ["h", "c"])

    return counts.filter("ord = 1").select("k", "c").mapInArrow(run, "h bigint, c bigint")


def _top_filter(counts: DataFrame, bits: int) -> tuple[Filter, int]:
    """The filter of the bigrams whose level is the returned one or higher: the least level with which it fits FILTER_BYTES."""

    def tally(batches):
        n = np.zeros(256, np.int64)
        for batch in batches:
            for c in batch.column("c"):
                n += np.bincount(np.frombuffer(c.as_buffer(), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["lv", "n"])

    pairs = counts.filter("ord = 2").select("part", "k", "c")
    n = np.zeros(256, np.int64)
    for r in pairs.mapInArrow(tally, "lv bigint, n bigint").groupBy("lv").agg(F.sum("n").alias("n")).collect():
        n[r["lv"]] = r["n"]
    above = np.cumsum((n * np.arange(256))[::-1])[::-1] * BITS / 8  # bytes of the filter from each level on
    least = int(max(level(np.array([OFTEN]))[0], np.argmax(above <= FILTER_BYTES)))

    def build(batches):
        for batch in batches:
            for p, k, c in zip(batch.column("part").to_pylist(), batch.column("k"), batch.column("c"), strict=True):
                lv = np.frombuffer(c.as_buffer(), np.uint8).astype(np.int64)
                if (lv >= least).any():
                    size, data = Filter.segment(np.frombuffer(k.as_buffer(), np.uint64)[lv >= least], lv[lv >= least])
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "size", "data"])

    got = pairs.mapInArrow(build, "part bigint, size bigint, data binary").toArrow()
    return Filter(64 - bits, {p: (size, data.as_buffer()) for p, size, data in zip(got["part"].to_pylist(), got["size"].to_pylist(), got["data"], strict=True)}), least


_COUNTS = level_count(np.arange(256.0))


def log_probability(pair: np.ndarray, word: np.ndarray, context: np.ndarray, floor: int) -> np.ndarray:
    """log10 of the smoothed probability from the levels of the bigram, its word and its context."""
    c2, c1, c0 = _COUNTS[pair], _COUNTS[word], _COUNTS[context]
    ratio = np.minimum(c2, np.minimum(c0, c1)) / np.maximum(c0, 1.0)
    return np.log10(np.minimum(1.0, (1 - SHARE) * (c1 + 1) / floor + SHARE * ratio))


#: kind 0: a segment. 1: packed pairs, to be probed. 2: a text. 3: packed pairs of which a token's count is not known yet.
_SENT = "kind int, part bigint, size bigint, data binary, rid bigint, off binary, k binary, w binary, v binary, lw binary, lv binary, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _batch(n: int, more: tuple = (), **columns) -> pa.RecordBatch:
    """A batch of the columns sent, null where not given; more: (name, array) of a further column."""
    arrays = [pa.array(columns[c], _KINDS[t]) if c in columns else pa.nulls(n, _KINDS[t]) for c, t in (x.split() for x in _SENT.split(", "))]
    return pa.RecordBatch.from_arrays([*arrays, *[x for _, x in more]], [*_NAMES, *[c for c, _ in more]])


def _sent(kind: int, bits: int, held: list[tuple]):
    """Rows of packed pairs, one for each range. held: rid, key, word, context, and their levels, in pieces."""
    rid, k, w, v, lw, lv = (np.concatenate(x) for x in zip(*held, strict=True))
    part = (k >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), np.int64)
    order = np.argsort(part, kind="stable")
    part, rid, k, lw, lv = (x[order] for x in (part, rid, k, lw, lv))
    if kind == 3:
        w, v = w[order], v[order]
    base = int(rid.min())
    off = (rid - base).astype(np.uint32)
    a, b = _runs(part)
    for i in range(0, len(a), 256):
        cuts = list(zip(a[i : i + 256].tolist(), b[i : i + 256].tolist(), strict=True))
        more = {} if kind == 1 else {"w": [w[x:y].tobytes() for x, y in cuts], "v": [v[x:y].tobytes() for x, y in cuts]}
        yield _batch(
            len(cuts), part=part[a[i : i + 256]], kind=[kind] * len(cuts), rid=[base] * len(cuts), off=[off[x:y].tobytes() for x, y in cuts], k=[pack(k[x:y], bits) for x, y in cuts],
            lw=[lw[x:y].tobytes() for x, y in cuts], lv=[lv[x:y].tobytes() for x, y in cuts], **more,
        )


def _read(batch: pa.RecordBatch, i: int, bits: int) -> tuple[np.ndarray, ...]:
    """rid, keys, and levels of words and contexts of a row of packed pairs."""
    got = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
    return got("off", np.uint32).astype(np.int64) + batch.column("rid")[i].as_py(), unpack(batch.column("k")[i].as_buffer(), bits, batch.column("part")[i].as_py()), got("lw", np.uint8), got("lv", np.uint8)


def _sums(rid: list[np.ndarray], logs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    r, back = np.unique(np.concatenate(rid), return_inverse=True)
    return r, np.bincount(back, np.concatenate(logs), len(r))


class _Sums:
    """Sums by rid; they leave as packed arrays, one row for each bucket of rids."""

    def __init__(self, bits: int):
        self.bits, self.rid, self.logs, self.n = bits, [], [], 0

    def add(self, rid: np.ndarray, logs: np.ndarray) -> None:
        self.rid.append(rid)
        self.logs.append(logs)
        self.n += len(rid)
        if self.n >= SEND_AT:
            self._merge()

    def _merge(self) -> None:
        r, x = _sums(self.rid, self.logs)
        self.rid, self.logs, self.n = [r], [x], len(r)

    def full(self) -> bool:
        return self.n >= SEND_AT // 2

    def rows(self):
        """(bucket, rids, sums) of what is held, which is then forgotten."""
        if self.n:
            self._merge()
            r, x = self.rid[0], self.logs[0]
            bucket = (B.mix64(r.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(r), np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, r, x = bucket[order], r[order], x[order]
            self.rid, self.logs, self.n = [], [], 0
            for a, b in zip(*_runs(bucket), strict=True):
                yield int(bucket[a]), r[a:b].tobytes(), x[a:b].tobytes()


def _summed(rows: DataFrame) -> DataFrame:
    """rid and more_score of packed sums: part (the bucket), k (rids) and data (sums)."""

    def run(batches):
        part, rid, logs = None, [], []

        def done():
            if rid:
                r, x = _sums(rid, logs)
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(x)], ["rid", "more_score"])

        for batch in batches:
            for p, k, x in zip(batch.column("part").to_pylist(), batch.column("k"), batch.column("data"), strict=True):
                if p != part:
                    yield from done()
                    part, rid, logs = p, [], []
                rid.append(np.frombuffer(k.as_buffer(), np.int64))
                logs.append(np.frombuffer(x.as_buffer(), np.float64))
        yield from done()

    return rows.select("part", "k", "data").repartition("part").sortWithinPartitions("part").mapInArrow(run, "rid bigint, more_score double")


def _read_texts(docs: DataFrame, text: str, key: str, shared, bits: int, floor: int) -> DataFrame:
    """Rows of kinds 1 to 3 of all texts. shared: tokens and counts, whether these are all tokens, the filter and its least level."""
    kind_of = docs.schema[key].dataType.simpleString()

    def run(batches):
        top_h, top_c, complete, top, least = shared.value
        top_lv = level(top_c).astype(np.uint8)
        end_at = np.searchsorted(top_h, END)
        end_lv = top_lv[end_at] if end_at < len(top_h) and top_h[end_at] == END else np.uint8(0)
        held: dict[int, list] = {1: [], 3: []}
        for batch in batches:
            for piece in B.slices(batch, text, 1 << 20):
                words, size = tokens(piece, text)
                row = np.repeat(np.arange(piece.num_rows), size)
                rid = piece.column("rid").to_numpy()
                keys, back = np.unique(words, return_inverse=True)
                at = np.minimum(np.searchsorted(top_h, keys), max(0, len(top_h) - 1))
                there = top_h[at] == keys if len(top_h) else np.zeros(len(keys), bool)
                exact = np.where(there, top_c[at], 0)[back] if len(top_h) else np.zeros(len(words), np.int64)
                lw = np.where(there, top_lv[at], 0 if complete else UNKNOWN).astype(np.uint8)[back] if len(top_h) else np.full(len(words), 0 if complete else UNKNOWN, np.uint8)
                lv = before(lw, size, end_lv)
                pair = bigrams(words, size, bits)
                later = (lw == UNKNOWN) | (lv == UNKNOWN) & (lw > 0)
                both = np.flatnonzero(~later & (lw > 0) & (lv > 0))
                some, some_back = np.unique(pair[both], return_inverse=True)
                found = top.levels(some)[some_back]
                lp = np.zeros(len(words), np.int64)
                lp[both] = found
                send = both[found < least]
                now = ~later
                now[send] = False
                score = np.bincount(row[now], log_probability(lp[now], lw[now], lv[now], floor), piece.num_rows)
                known = np.bincount(row, exact > 0, piece.num_rows).astype(np.int64)
                logs = np.bincount(row, np.log10(exact + 1.0), piece.num_rows)
                n = piece.num_rows
                yield _batch(n, [("__key", piece.column(key))], kind=[2] * n, part=rid & ((1 << bits) - 1), rid=rid, held_out=piece.column("held_out"), n_tokens=size, n_known=known, logs=logs, score=score)
                for kind, at in ((1, send), (3, np.flatnonzero(later))):
                    if len(at):
                        context = before(words, size, END)[at] if kind == 3 else np.zeros(0, np.uint64)
                        held[kind].append((rid[row[at]], pair[at], words[at] if kind == 3 else context, context, lw[at], lv[at]))
                    if held[kind] and sum(len(x[0]) for x in held[kind]) >= SEND_AT:
                        for out in _sent(kind, bits, held[kind]):
                            yield out.append_column("__key", pa.nulls(out.num_rows, piece.column(key).type))
                        held[kind] = []
        for kind in (1, 3):
            if held[kind]:
                for out in _sent(kind, bits, held[kind]):
                    yield out.append_column("__key", pa.nulls(out.num_rows, piece.column(key).type))

    return docs.mapInArrow(run, f"{_SENT}, __key {kind_of}")


def _probed(rows: DataFrame, bits: int, floor: int) -> DataFrame:
    """Rows of kinds 0 to 3: packed pairs of kind 1 are probed in their range's segment and become packed sums; kind 0 goes."""

    def run(batches):
        part, filter_, sums, key_type = None, None, _Sums(bits), None

        def packed():
            got = list(sums.rows())
            for i in range(0, len(got), 256):
                p, k, x = zip(*got[i : i + 256], strict=True)
                yield _batch(len(p), [("__key", pa.nulls(len(p), key_type))], kind=[1] * len(p), part=p, k=k, data=x)

        for batch in batches:
            kind, parts, key_type = batch.column("kind").to_numpy(), batch.column("part").to_numpy(), batch.schema.field("__key").type
            for i in np.flatnonzero(kind < 2).tolist():
                if part != parts[i]:
                    part, filter_ = int(parts[i]), Filter(64, {})
                if kind[i] == 0:
                    filter_ = Filter(64, {0: (batch.column("size")[i].as_py(), batch.column("data")[i].as_buffer())})
                    continue
                rid, keys, lw, lv = _read(batch, i, bits)
                sums.add(*_sums([rid], [log_probability(filter_.levels(keys), lw, lv, floor)]))
                if sums.full():
                    yield from packed()
            rest = np.flatnonzero(kind > 1)
            if len(rest):
                yield batch.take(pa.array(rest))
        yield from packed()

    return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, rows.schema)


def _flat(rows: DataFrame, bits: int) -> DataFrame:
    """rid, k, w and v (hashes; null where the level is known), and lw, lv of packed pairs of kind 3."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rid, k, lw, lv = _read(batch, i, bits)
                w, v = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("w", "v"))
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(k.view(np.int64)), pa.array(w, mask=lw != UNKNOWN), pa.array(v, mask=lv != UNKNOWN), pa.array(lw.astype(np.int32)), pa.array(lv.astype(np.int32))], ["rid", "k", "w", "v", "lw", "lv"])

    return rows.filter("kind = 3").select("part", "rid", "off", "k", "w", "v", "lw", "lv").mapInArrow(run, "rid bigint, k bigint, w bigint, v bigint, lw int, lv int")


def _probed_flat(rows: DataFrame, segments: DataFrame, bits: int, floor: int) -> DataFrame:
    """Packed sums (part, k, data) of pairs rid, k, lw, lv."""
    part = F.shiftrightunsigned("k", 64 - bits) if bits else F.lit(0).cast("long")
    asked = rows.select(F.lit(1).alias("kind"), part.alias("part"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("data"), "rid", "k", "lw", "lv")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("rid", "long"), ("k", "long"), ("lw", "int"), ("lv", "int"))]
    both = asked.unionByName(segments.select(F.lit(0).alias("kind"), "part", "size", "data", *none))

    def run(batches):
        part, filter_, sums = None, None, _Sums(bits)

        def packed():
            got = list(sums.rows())
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "k", "data"])

        for batch in batches:
            parts, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            for a, b in zip(*_runs(parts), strict=True):
                if part != parts[a]:
                    part, filter_ = int(parts[a]), Filter(64, {})
                if kind[a] == 0:
                    filter_ = Filter(64, {0: (batch.column("size")[a].as_py(), batch.column("data")[a].as_buffer())})
                    a += 1
                if a < b:
                    k, lw, lv = (batch.column(c).slice(a, b - a).to_numpy() for c in ("k", "lw", "lv"))
                    found = np.zeros(len(k), np.int64)
                    at = np.flatnonzero((lw > 0) & (lv > 0))
                    found[at] = filter_.levels(k[at].view(np.uint64))
                    sums.add(*_sums([batch.column("rid").slice(a, b - a).to_numpy()], [log_probability(found, lw, lv, floor)]))
                    if sums.full():
                        yield from packed()
        yield from packed()

    return both.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, "part bigint, k binary, data binary")


def score_texts(docs: DataFrame, *, text: str = "text", key: str = "doc_id", folds: int = 7, held: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows whose crc32(key as text) mod `folds` is not `held`; a null key counts as the empty
    text. Null and empty texts are the end token alone. Repeated rows count and are scored each. With nothing to learn
    from, N and V are 0 and all scores are 0. Other input columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(key), F.col(text), (F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held).alias("held_out"))
    total = own.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / RANGE_TEXT))))
    counts = count_ngrams(own.filter(~F.col("held_out")), text, bits)
    unigrams = stored(_unigrams(counts), "unigrams")
    bins = unigrams.groupBy(F.floor(F.log2("c")).alias("p")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()
    n_all, vocabulary = sum(b["n"] for b in bins), sum(b["v"] for b in bins)
    head_from = next(x for x in (1 << p for p in range(64)) if sum(b["v"] for b in bins if (1 << b["p"]) >= x) <= HEAD_TOKENS)
    head = unigrams.filter((F.col("c") >= head_from) | (F.col("h") == F.lit(int(END.view(np.int64))))).toArrow()
    order = np.argsort(head_h := head.column("h").to_numpy().view(np.uint64))
    floor = n_all + vocabulary + 1
    top, least = _top_filter(counts, bits)
    shared = spark.sparkContext.broadcast((head_h[order], head.column("c").to_numpy()[order], head_from == 1, top, least))
    del head, top
    read = _read_texts(own.withColumn("rid", F.monotonically_increasing_id()), text, key, shared, bits, floor)
    segments = counts.filter("ord = 2").select("part", "size", "data")
    sent = [F.lit(0).alias("kind"), "part", "size", "data"] + [F.lit(None).cast(f.dataType).alias(f.name) for f in read.schema.fields[4:]]
    out = stored(_probed(read.unionByName(segments.select(*sent)), bits, floor), "lm-scores")

    rare = unigrams.filter(F.col("c") < head_from)
    lv = lambda c: F.coalesce((F.lit(1) + F.floor(F.log(c.cast("double")) / F.lit(math.log(LOG_BASE)) + F.lit(1e-9))).cast("int"), F.lit(0))
    flat = _flat(out, bits).join(rare.select(F.col("h").alias("w"), F.col("c").alias("cw")), "w", "left").join(rare.select(F.col("h").alias("v"), F.col("c").alias("cv")), "v", "left")
    flat = stored(
        flat.select(
            "rid", "k", F.when(F.col("lw") == UNKNOWN, lv(F.col("cw"))).otherwise(F.col("lw")).alias("lw"), F.when(F.col("lv") == UNKNOWN, lv(F.col("cv"))).otherwise(F.col("lv")).alias("lv"), "cw",
        ),
        "lm-rare",
    )
    scores = _summed(out.filter("kind = 1").select("part", "k", "data").unionByName(_probed_flat(flat, segments, bits, floor)))
    counted = flat.filter("cw is not null").groupBy("rid").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("cw") + F.lit(1.0))).alias("more_logs"))
    none = F.lit(0.0)
    return out.filter("kind = 2").join(scores, "rid", "left").join(counted, "rid", "left").select(
        F.col("__key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", none) - F.col("n_tokens") * F.lit(math.log10(floor))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", none)).alias("score"),
    )


def op6_lm(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every document. Nulls, repeated rows and empty tables: see `score_texts`."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

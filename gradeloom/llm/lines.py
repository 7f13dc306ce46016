"""Fuzzy line dedup: SimHash of normalised lines, least-hash bands, edit similarity, one occurrence per group.

Equal normalised lines are one line from the start. Pigeonhole blocks of a SimHash can't find lines from an edit
similarity of 0.8 on: such fingerprints differ in 10 to 20 of 64 bits, for which blocks select nothing. Lines therefore
meet in bands of least hashes of their word pairs (byte pairs, if the line has few words), and the SimHash is the check
of those that meet: pairs within `BUDGET` bits are candidates. In the first band that a pair shares it is verified by
edit similarity, unless verified links have joined it there already. Of each group of verified links the first
occurrence (smallest document, then line) stays.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm import bytetext as B
from gradeloom.llm.components import components
from gradeloom.llm.nearcopies import whole_runs
from gradeloom.llm.trie import trie_links
from gradeloom.runtime import ship, stored

#: Bits in which candidates may differ: with a fifth of the words changed 13 +- 3.2 do, of unrelated lines 32 +- 4.
BUDGET = 18
SIMILARITY = 0.8
#: A band is the least hash of so many functions: word pairs, or byte pairs of lines of up to FEW words.
BANDS, ROWS, FEW_ROWS, FEW = 12, 2, 3, 3
#: Bytes of a band's key.
KEY = 5
_RNG = np.random.Generator(np.random.PCG64(8))
_FACTORS = _RNG.integers(0, 1 << 63, (BANDS, FEW_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TWO_BYTES = _RNG.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BEGIN, _END, _WEAVE = (np.uint64(x) for x in _RNG.integers(1 << 62, 1 << 63, 3, dtype=np.uint64) | np.uint64(1))
#: Words up to which lines are aligned by words before their distance is computed.
MATCHED = 400
#: Lines of fewer words stay as they are, if not said otherwise.
LEAST_WORDS = 5


def _middles(a: str, b: str) -> tuple[str, str]:
    """a and b without their common end and beginning."""
    n, m = 0, min(len(a), len(b))
    while n < m and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k:], b[k:]


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 where it is larger; bit-parallel over the longer text."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    a, b = _middles(a, b)
    if not b:
        return min(len(a), most + 1)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, apart, get = full, 0, len(a), len(a) - len(b), where.get
    for n, x in enumerate(b, 1):
        m = get(x, 0)
        zero = (((m & up) + up) ^ up) | m | down
        plus = down | ~(zero | up) & full
        minus = up & zero
        if plus & top:
            score += 1
        if minus & top:
            score -= 1
        if score - (len(b) - n) > most:
            return most + 1
        plus = (plus << 1 | 1) & full
        minus = minus << 1 & full
        up = minus | ~(zero | plus) & full
        down = plus & zero
        if not n & 31:  # the distance is at least that of two beginnings of one length, less what the lengths differ
            head = (1 << n) - 1
            if n + (up & head).bit_count() - (down & head).bit_count() - apart > most:
                return most + 1
    return score


def _surely_within(a: str, b: str, most: int) -> bool:
    """Whether replacing whole words is at most so many edits; False decides nothing."""
    if max(len(a), len(b)) <= most:
        return True
    v, w = a.split(" "), b.split(" ")
    if len(v) == len(w) and sum(max(len(x), len(y)) for x, y in zip(v, w, strict=True) if x != y) <= most:
        return True
    if max(len(v), len(w)) > MATCHED:
        return False
    cost = 0
    for kind, i, j, k, m in SequenceMatcher(None, v, w, autojunk=False).get_opcodes():
        if kind != "equal":  # a space goes or comes with the words
            cost += max(sum(map(len, v[i:j])) + j - i, sum(map(len, w[k:m])) + m - k)
    return cost <= most


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """1 - distance / the longer length >= least."""
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    a, b = _middles(a, b)
    return _surely_within(a, b, most) or edit_distance(a, b, most) <= most


def _byte_pairs(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the byte pairs of lines with single blanks between and around words, and each line's begin and end in them.

    starts, ends: the words; first: whether a word is its line's first.
    """
    size = ends - starts
    room = size + 1 + first
    at = np.cumsum(room) - room
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = np.full(int(room.sum()), 32, np.uint16)
    out[np.repeat(at + first, size) + step] = low[np.repeat(starts, size) + step]
    begin = at[first]
    return _TWO_BYTES[out[:-1] << np.uint16(8) | out[1:]], begin, np.append(begin[1:], len(out)) - 1


def _band_keys(least, rows: int, lines: int) -> np.ndarray:
    """(lines, BANDS * KEY) bytes; least(factor): each line's least hash under a function."""
    out = np.empty((lines, BANDS, KEY), np.uint8)
    for band in range(BANDS):
        key = np.full(lines, band * 8 + rows, np.uint64)
        for factor in _FACTORS[band, :rows]:
            key = B.mix64(B.mix64(key) + least(factor))
        out[:, band] = key.view(np.uint8).reshape(-1, 8)[:, :KEY]
    return out.reshape(lines, -1)


def _simhashes(of: np.ndarray, votes: np.ndarray, lines: int) -> np.ndarray:
    """SimHash of each line by its distinct votes: repeated ones would draw unlike lines together. Every line has a vote."""
    one = np.unique((of.astype(np.uint64) << np.uint64(44)) | (votes >> np.uint64(20)), return_index=True)[1]
    of, votes = of[one], votes[one]
    fp, begin, i = np.zeros(lines, np.uint64), np.searchsorted(of, np.arange(lines + 1)), 0
    while i < lines:  # blocks of whole lines
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + (1 << 17), "right")) - 1)
        bits = np.unpackbits(votes[begin[i] : begin[j]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, begin[i:j] - begin[i], axis=0, dtype=np.int32)
        fp[i:j] = np.packbits(2 * count > np.diff(begin[i : j + 1])[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        i = j
    return fp


def marks(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SimHash and band keys of lines. starts, ends, words: bounds and hashes of their words; new: each line's first word."""
    size = np.diff(np.append(new, len(words)))
    of = np.repeat(np.arange(len(new)), size)
    few = size <= FEW
    votes, keys = [], np.empty((len(new), BANDS * KEY), np.uint8)
    if not few.all():
        mine = ~few[of]
        w, n = words[mine], size[~few]
        begin = np.cumsum(n) - n
        before = np.concatenate([w[:1], w[:-1]])
        before[begin] = _BEGIN
        pair, tail = B.mix64(w + before * _WEAVE), B.mix64(_END + w[begin + n - 1] * _WEAVE)
        keys[~few] = _band_keys(lambda factor: np.minimum(np.minimum.reduceat(pair * factor, begin), tail * factor), ROWS, len(n))
        votes.append((of[mine], w))
    if few.any():
        mine = few[of]
        pair, begin, end = _byte_pairs(low, starts[mine], ends[mine], np.isin(np.flatnonzero(mine), new))
        cut = np.column_stack([begin, end]).ravel()
        last = np.append(pair, np.uint64(0))  # so that the last line's end is a position
        keys[few] = _band_keys(lambda factor: np.minimum.reduceat(last * factor, cut)[::2], FEW_ROWS, len(begin))
        inside = np.ones(len(last), bool)
        inside[end] = False
        votes.append((np.repeat(np.flatnonzero(few), end - begin), last[inside]))
    return _simhashes(np.concatenate([v[0] for v in votes]), np.concatenate([v[1] for v in votes]), len(new)), keys


def line_table(docs: DataFrame, text: str, key: str, least_words: int) -> DataFrame:
    """key, doc (the text's hash), line (from 0), h (of the normalised line), fp and f (band keys) of every line of so many words or more."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in B.slices(batch, text):
                raw, at = B.utf8(piece.column(text))
                low = B.LOWER[raw]
                feed = np.flatnonzero(raw == 10)
                starts, ends, row = B.word_bounds(low, at, B.NOT_SPACE)
                before = np.searchsorted(feed, starts)  # line ends before the word, in all rows
                line = before - np.searchsorted(feed, at[:-1])[row]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])])) if len(row) else np.zeros(0, np.int64)
                size = np.diff(np.append(new, len(row)))
                words = B.span_hashes(low, starts, ends)
                keep = size >= least_words
                if not keep.any():
                    continue
                place = np.arange(len(words)) - np.repeat(new, size)
                weave = B.mix64(words + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
                h = B.mix64(np.add.reduceat(weave, new) + size.astype(np.uint64))[keep]
                fp, f = marks(low, starts, ends, words, new)
                first = new[keep]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(key).take(pa.array(row[first])), piece.column("doc").take(pa.array(row[first])), pa.array(line[first].astype(np.int32)), pa.array(h.view(np.int64)), pa.array(fp[keep].view(np.int64)), pa.array([x.tobytes() for x in f[keep]], pa.binary())],
                    [key, "doc", "line", "h", "fp", "f"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, F.xxhash64(text).alias("doc")).mapInArrow(run, f"`{key}` {kind}, doc bigint, line int, h bigint, fp bigint, f binary")


def candidates(own: DataFrame) -> DataFrame:
    """h, g, band: every line once for each band in which another one is within the budget; own: h, fp, f.

    g names the set of lines of a band key that steps within the budget connect; the same set in several bands is one
    group, with the least of them. A task holds 24 bytes per line of its largest band key.
    """

    def deal(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(i, 1 << 14)
                f = np.frombuffer(b"".join(part.column("f").to_pylist()), np.uint8).reshape(-1, BANDS, KEY)
                for band in range(BANDS):
                    k = np.zeros((len(f), 8), np.uint8)
                    k[:, :KEY], k[:, KEY] = f[:, band], band
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)[:, 0]), part.column("h"), part.column("fp")], ["k", "h", "fp"])

    def join(batches):
        for t in whole_runs(batches, "k"):
            k, h, fp = (t[c].to_numpy() for c in ("k", "h", "fp"))
            k, fp = k.view(np.uint64), fp.view(np.uint64)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= BUDGET]
            mark = B.mix64(h.view(np.uint64))
            pair = mark[two] + mark[two + 1]
            rows, name = [two, two + 1], [pair, pair]
            for i in np.flatnonzero(size > 2):
                v, at, n = np.unique(fp[edge[i] : edge[i + 1]], return_inverse=True, return_counts=True)
                root = trie_links(v, BUDGET)
                met = np.flatnonzero((np.bincount(root, n, len(v))[root] > 1)[at])
                rows.append(edge[i] + met)
                total = np.zeros(len(v), np.uint64)
                np.add.at(total, root[at], mark[edge[i] : edge[i + 1]])
                name.append(total[root[at[met]]])
            at = np.concatenate(rows)
            g = B.mix64(np.concatenate(name))
            band = (k[at] >> np.uint64(8 * KEY)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(g.view(np.int64)), pa.array(band)], ["h", "g", "band"])

    dealt = own.select("h", "fp", "f").mapInArrow(deal, "k bigint, h bigint, fp bigint")
    met = dealt.repartition("k").sortWithinPartitions("k").mapInArrow(join, "h bigint, g bigint, band int")
    return met.groupBy("h", "g").agg(F.min("band").alias("band"))


def _verified(members: DataFrame) -> DataFrame:
    """Links (a, b) between the hashes of similar lines. members: g, band, h, fp, f, t (the normalised line).

    A pair is verified in the first band that it shares, by lengths and counts of letters before the distance, unless
    verified links of the group have joined it already. A task holds the lines of its largest group.
    """

    def open_pairs(i, j, band, keys, size, counts):
        """Pairs that share no band before, and whose lengths and counts of letters differ by no more than the edits allowed: one changes a count by one up, one down or both."""
        most = ((1 - SIMILARITY) * np.maximum(size[i], size[j]) + 1e-9).astype(np.int64)
        at = np.flatnonzero((np.abs(size[i] - size[j]) <= most) & ((keys[i] == keys[j]).argmax(1) == band))
        more = counts(i[at]) - counts(j[at])
        return at[np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)) <= most[at]]

    def letters(t):
        return np.array([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) & np.uint32(63), minlength=64) for x in t], np.int32).reshape(-1, 64)

    def group(band, h, fp, keys, size, t):
        order = np.argsort(fp, kind="stable")
        h, fp, keys, size, t = h[order], fp[order], keys[order], size[order], [t[i] for i in order]
        counts = letters(t)

        def sift(i, j):
            keep = np.zeros(len(i), bool)
            keep[open_pairs(i, j, band, keys, size, counts.__getitem__)] = True
            return keep

        root = trie_links(fp, BUDGET, lambda i, j: similar(t[i], t[j]), sift=sift)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return h[root[moved]], h[moved]

    def run(batches):
        for m in whole_runs(batches, "g"):
            g, band, h, fp = (m[c].to_numpy() for c in ("g", "band", "h", "fp"))
            fp, t, size = fp.view(np.uint64), m["t"], pc.utf8_length(m["t"]).to_numpy()
            keys = np.zeros((len(g), BANDS, 8), np.uint8)
            keys[:, :, :KEY] = np.frombuffer(b"".join(m["f"].to_pylist()), np.uint8).reshape(-1, BANDS, KEY)
            keys = keys.view(np.uint64)[:, :, 0]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
            many = np.diff(edge) > 2
            two = edge[:-1][np.diff(edge) == 2]
            two = two[open_pairs(two, two + 1, band[two], keys, size, lambda i: letters(t.take(i).to_pylist()))]
            two = two[[similar(t[i].as_py(), t[i + 1].as_py()) for i in two.tolist()]] if len(two) else two
            links = [(h[two], h[two + 1])]
            for x, y in zip(edge[:-1][many], edge[1:][many], strict=True):
                links.append(group(band[x], h[x:y], fp[x:y], keys[x:y], size[x:y], t[x:y].to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*links, strict=True)], ["a", "b"])

    return members.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint")


def dedup_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs, the text without the lines that repeat an earlier one, with n_lines, n_removed and removed_lines (positions from 0).

    Lines end at line feeds; they are compared in lower case (A-Z) with white space runs as one space. Lines of fewer than
    `least_words` words, and lines without words, always stay. Null texts stay null, with no lines. Documents come in order of key (null
    first) and text hash; rows alike in both are one document and get one result. Input columns named like an output
    column are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed", "removed_lines")
    lines = stored(line_table(docs, text, key, max(1, least_words)), "lines")
    own = stored(lines.groupBy("h", "fp").agg(F.min(F.struct(key, "doc", "line")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("f").alias("f")), "line-kinds")
    met = stored(candidates(own), "line-candidates")
    open_ = own.join(met.select("h").distinct(), "h").select("h", "fp", "f", F.col(f"first.{key}").alias("k0"), F.col("first.doc").alias("d0"), F.col("first.line").alias("l0"))
    wanted = open_.groupBy("k0", "d0").agg(F.collect_list(F.struct("h", "fp", "f", "l0")).alias("w"))
    marked = docs.select(F.col(key).alias("k1"), F.xxhash64(text).alias("d1"), F.col(text).alias("__text"))
    text_of = marked.join(wanted, F.col("k1").eqNullSafe(F.col("k0")) & (F.col("d1") == F.col("d0"))).select(F.split("__text", "\n", -1).alias("s"), F.explode("w").alias("w"))
    plain = F.trim(F.regexp_replace(F.translate(F.get("s", F.col("w.l0")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    texts = text_of.select("w.h", "w.fp", "w.f", plain.alias("t")).dropDuplicates(["h"])
    groups = components(_verified(met.join(texts, "h"))).toDF("h", "root")
    led = own.join(groups, "h", "left").withColumn("root", F.coalesce("root", "h"))
    lead = led.groupBy("root").agg(F.min("first").alias("lead"), F.sum("n").alias("all")).filter("all > 1")
    repeat = stored(led.join(lead, "root").select("h", "lead"), "line-leads")
    gone = lines.join(repeat, "h").filter(~F.struct(key, "doc", "line").eqNullSafe(F.col("lead"))).groupBy(F.col(key).alias("__k"), F.col("doc").alias("__d")).agg(F.array_sort(F.collect_set("line")).alias("removed_lines"))
    all_lines = F.split(F.col(text), "\n", -1)
    left = docs.withColumn("__doc", F.xxhash64(text)).join(gone, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__doc") == F.col("__d")), "left")
    stay = F.array_join(F.filter(all_lines, lambda _, i: ~F.array_contains(F.col("removed_lines"), i)), "\n")
    return left.select(
        *[F.when(F.col("removed_lines").isNull(), F.col(text)).otherwise(stay).alias(text) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.when(F.col(text).isNotNull(), F.size(all_lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("removed_lines").isNull(), 0).otherwise(F.size("removed_lines")).cast("long").alias("n_removed"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )


def op8_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier one. Nulls, short lines and ties: see `dedup_lines`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, least_words=1)
    return out.select("doc_id", "n_lines", "n_removed", "removed_lines", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

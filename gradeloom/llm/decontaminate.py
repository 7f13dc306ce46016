"""Benchmark decontamination with training suffix arrays.

Each task packs its documents into shards of about `SHARD_WORDS` words and builds the shard's suffix array by prefix
doubling, as deep as the longest benchmark item. All benchmark suffixes are then binary-searched in it together, word by
word: the range of the array that agrees with a suffix narrows until it is empty. Where it has reached a window's length,
its entries are the places of that window; where it changes or ends, its entries are verbatim matches of that length.
Benchmark texts are read by the tasks from the shared folder in blocks, so that no side is broadcast and memory is bounded
by one shard and one block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gradeloom.llm import bytetext as B
from gradeloom.runtime import run_folder, ship

WINDOW = 13
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 4 << 20


class SuffixArray:
    """Suffixes of a word sequence (hashes; 0 ends a document) in order of their first `depth` words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.keys, group, count = np.unique(words, return_inverse=True, return_counts=True)
        self.edge = np.concatenate([[0], np.cumsum(count)])
        self.rank = self.edge[group]  # the first slot of a suffix's group of equals
        self.sa = np.argsort(group, kind="stable")
        self.depth = 1
        self.open = np.flatnonzero((np.diff(self.edge) > 1)[group[self.sa]] & (words[self.sa] != 0))  # slots in groups of several

    def deepen(self, depth: int) -> None:
        while self.depth < depth and len(self.open):
            at = self.sa[self.open]
            after = np.minimum(at + self.depth, len(self.words) - 1)
            key = (self.rank[at].astype(np.uint64) << np.uint64(32)) | self.rank[after].astype(np.uint64)
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(first) - 1
            self.sa[self.open] = at
            self.rank[at] = self.open[np.flatnonzero(first)][group]
            self.open = self.open[(np.bincount(group) > 1)[group]]
            self.depth *= 2
        self.depth = max(self.depth, depth)

    def narrow(self, lo: np.ndarray, hi: np.ndarray, at: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ranges whose suffixes agree on `at` words, the part whose next word is the given one."""
        if not at:
            i = np.minimum(np.searchsorted(self.keys, word), len(self.keys) - 1)
            there = self.keys[i] == word
            return np.where(there, self.edge[i], 0), np.where(there, self.edge[i + 1], 0)
        return self._bound(lo, hi, at, word, np.less), self._bound(lo, hi, at, word, np.less_equal)

    def _bound(self, lo, hi, at, word, before):
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            go = before(self.words[np.minimum(self.sa[np.where(open_, mid, 0)] + at, len(self.words) - 1)], word)
            lo, hi = np.where(open_ & go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo

    def places(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the suffixes in the ranges, and the range each is in."""
        size = hi - lo
        of = np.repeat(np.arange(len(lo)), size)
        return self.sa[np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)], of


def _benchmark_block(table: pa.Table) -> dict:
    raw, at = B.utf8(table.column("text"))
    low = B.LOWER[raw]
    starts, ends, row = B.word_bounds(low, at, B.ALNUM)
    count = np.bincount(row, minlength=table.num_rows)
    ids = [str(x) for x in table.column("item_id").to_pylist()]
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    order = np.empty(len(ids), np.int64)
    order[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    return {"words": _hashes(low, starts, ends), "row": row, "place": place, "rest": count[row] - place, "size": count[row], "ids": ids, "order": order}


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.maximum(B.span_hashes(low, starts, ends), np.uint64(1))


def _search(array: SuffixArray, block: dict, window: int):
    """All benchmark suffixes that hold a window, searched together.

    Gives (True, length, lo, hi, suffix) where suffixes have reached a window's length, and (False, length, lo, hi,
    suffix) where a verbatim match of that length ends, once for each range.
    """
    words, rest, least = block["words"], block["rest"], np.minimum(block["size"], window)
    q = np.flatnonzero(rest >= least)
    if not len(q) or not len(array.words):
        return
    array.deepen(int(rest[q].max()))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(array.words))
    for at in range(int(rest[q].max())):
        new_lo, new_hi = array.narrow(lo, hi, at, words[np.minimum(q + at, len(words) - 1)])
        new_hi = np.where(rest[q] > at, new_hi, new_lo)
        ended = (at >= least[q]) & ((new_lo != lo) | (new_hi != hi))
        if ended.any():
            yield False, at, lo[ended], hi[ended], q[ended]
        on = new_lo < new_hi
        q, lo, hi = q[on], new_lo[on], new_hi[on]
        if not len(q):
            return
        reached = least[q] == at + 1
        if reached.any():
            yield True, at + 1, lo[reached], hi[reached], q[reached]
    if (whole := rest[q] == at + 1).any():
        yield False, at + 1, lo[whole], hi[whole], q[whole]


def _best(found: list[tuple]) -> tuple[np.ndarray, ...]:
    """Of (document, length, place, item id, place in the item) the longest of each document; ties: the first place, id and place in the item."""
    doc, length, place, item, inside = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((inside, item, place, -length, doc))
    doc = doc[order]
    first = order[np.concatenate([[True], doc[1:] != doc[:-1]])] if len(doc) else order
    return tuple(x[first] for x in (np.concatenate([f[0] for f in found]), length, place, item, inside))


def _scan(parts_words: np.ndarray, parts_doc: np.ndarray, docs: int, blocks, window: int) -> tuple[np.ndarray, list[set], np.ndarray, dict]:
    """Words hit, items found, longest run of hit words, and longest verbatim match of each document of one shard."""
    n_words = np.bincount(parts_doc, minlength=docs)
    begin = np.cumsum(n_words + 1) - n_words - 1  # every document is followed by a 0
    words, doc = np.zeros(len(parts_words) + docs, np.uint64), np.repeat(np.arange(docs), n_words + 1)
    words[np.arange(len(parts_words)) + parts_doc] = parts_words
    array = SuffixArray(words)
    edge = np.zeros(len(words) + 1, np.int64)
    items: list[set] = [set() for _ in range(docs)]
    match: dict[int, tuple] = {}
    for block in blocks:
        ids, row, found = block["ids"], block["row"], []
        prefer = np.lexsort((block["place"], block["order"][row]))
        rank = np.empty(len(row), np.int64)
        rank[prefer] = np.arange(len(row))
        for window_found, length, lo, hi, q in _search(array, block, window):
            order = np.lexsort((rank[q], lo))  # ranges of one length are equal or apart
            lo, hi, q = lo[order], hi[order], q[order]
            one = np.flatnonzero(np.concatenate([[True], lo[1:] != lo[:-1]]))
            at, of = array.places(lo[one], hi[one])
            if window_found:
                edge[at] += 1
                np.add.at(edge, at + length, -1)
                until = np.append(one[1:], len(lo))
                # pairs (document, range) once: a passage may occur in a document many times
                for d, i in np.unique(np.stack([doc[at], of], 1), axis=0).tolist():
                    items[d].update(ids[k] for k in row[q[one[i] : until[i]]].tolist())
            else:
                found.append((doc[at], np.full(len(at), length), at - begin[doc[at]], rank[q[one[of]]], np.zeros(len(at), np.int64)))
                if sum(len(f[0]) for f in found) > 1 << 20:
                    found = [_best(found)]
        if found:
            for d, length, place, r, _ in zip(*(x.tolist() for x in _best(found)), strict=True):
                k = prefer[r]
                new = (-length, place, ids[row[k]], int(block["place"][k]))
                if d not in match or new < match[d]:
                    match[d] = new
    hit = np.cumsum(edge[:-1]) > 0
    n_hit = np.bincount(doc[hit], minlength=docs)
    # the longest run of hit words of a document
    longest = np.zeros(docs, np.int64)
    if hit.any():
        new = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1]]))
        end = np.flatnonzero(hit & np.concatenate([~hit[1:], [True]])) + 1
        np.maximum.at(longest, doc[new], end - new)
    return n_hit, items, longest, match


OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_verbatim", "match_item", "match_start", "match_item_start"]


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words, one hit at least), longest_match and longest_verbatim.

    longest_match is the longest run of hit words, which windows of several items may make up; longest_verbatim the length
    of the longest run of words, a window at least, that one item holds as well (0: none), with the item's id
    (match_item), and its first word's place in the document (match_start) and in the item (match_item_start), from 0; of
    several the first in the document, then by id as a string and place in the item.

    Null and empty texts have no words and are clean; null or wordless items match nothing; items of fewer words than the
    window match as a whole; items with one id are one item, a null id counts as "None". Repeated rows are judged alike.
    Input columns named like an output column are replaced. An empty benchmark leaves every document clean.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = run_folder(spark, "benchmark")
    benchmark.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).write.parquet(folder)
    docs = docs.drop(*OUT)
    names = docs.columns

    def run(batches):
        from pyarrow import fs, parquet

        store, path = fs.FileSystem.from_uri(folder)
        files = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
        cache: list = []

        def blocks():
            if cache:
                yield from cache
                return
            seen = []
            for f in sorted(files):
                with store.open_input_file(f) as source:
                    for batch in parquet.ParquetFile(source).iter_batches(batch_size=4096):
                        for part in B.slices(batch, "text", BLOCK_BYTES):
                            block = _benchmark_block(pa.Table.from_batches([part]))
                            seen = None if seen is None or len(seen) >= 4 else [*seen, block]
                            yield block
            if seen is not None:  # a small benchmark stays in memory, a large one is read again for each shard
                cache.extend(seen)

        def judged(parts, words, doc):
            total = sum(p.num_rows for p in parts)
            doc = np.concatenate(doc)
            n_hit, items, longest, match = _scan(np.concatenate(words), doc, total, blocks(), window)
            n_words = np.bincount(doc, minlength=total)
            first = 0
            for p in parts:
                s = slice(first, first + p.num_rows)
                digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items[s]]
                best = [match.get(d, (0, None, None, None)) for d in range(s.start, s.stop)]
                columns = [n_words[s], n_hit[s], np.array([len(x) for x in items[s]], np.int64), pa.array(digest), (n_hit[s] > 0) & (share * n_hit[s] >= n_words[s]), longest[s]]
                columns += [pa.array([-x[0] for x in best], pa.int64()), pa.array([x[2] for x in best], pa.string()), pa.array([x[1] for x in best], pa.int64()), pa.array([x[3] for x in best], pa.int64())]
                yield pa.RecordBatch.from_arrays([*p.columns, *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], [*names, *OUT])
                first += p.num_rows

        parts, words, doc, count, rows, held = [], [], [], 0, 0, 0
        for batch in batches:
            for part in B.slices(batch, text):
                raw, at = B.utf8(part.column(text))
                low = B.LOWER[raw]
                starts, ends, row = B.word_bounds(low, at, B.ALNUM)
                parts.append(part)
                words.append(_hashes(low, starts, ends))
                doc.append(row + rows)
                rows += part.num_rows
                count += len(starts)
                held += len(raw)
                if count >= SHARD_WORDS or held >= 16 * SHARD_WORDS:
                    yield from judged(parts, words, doc)
                    parts, words, doc, count, rows, held = [], [], [], 0, 0, 0
        if parts:
            yield from judged(parts, words, doc)

    kinds = [T.LongType()] * 3 + [T.StringType(), T.BooleanType(), T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType()]
    added = [T.StructField(c, t) for c, t in zip(OUT, kinds, strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones; options, and what holds for nulls, short items and empty tables, as in `mark_contaminated`."""
    return mark_contaminated(docs, benchmark, **options).filter(~F.col("contaminated")).drop(*OUT)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Nulls, short items and empty tables: see `mark_contaminated`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.drop("text")

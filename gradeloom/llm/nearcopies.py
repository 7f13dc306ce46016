"""Near copies by word-shingle similarity: SimHash trie self-join and MinHash bands, candidate groups, exact Jaccard, components.

Two texts are near copies from a similarity (Jaccard of their sets of five-word shingles) of `SIMILARITY` on. The SimHashes
of the sets are joined within `BUDGET` bits by the operator of `simhash`, a binary trie in pigeonhole subtrees. That finds
copies that are all but equal; for those down to `SIMILARITY`, texts that agree on all `ROWS` least hashes of one of
`BANDS` bands meet in a bucket as well and are linked there by a loose estimate. What either links, over any number of
steps, is a candidate group and no more. Within each candidate group all pairs are then compared by the exact similarity
of their shingle sets, pairs that verified links have joined already excepted, and only verified links join. All
parameters are the same at every size.

Least hashes agree with the probability of the similarity, whatever the size of the sets, and those of the bands are
independent: a pair at 0.8 meets in a bucket with probability 0.9993.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm import bytetext as B
from gradeloom.llm.components import components
from gradeloom.llm.simhash import fingerprint_links, one_of_each
from gradeloom.runtime import ship, stored

SHINGLE = 5
#: Near copies share 4 of 5 of their shingles: 9 * shared >= 4 * (both sizes added).
SIMILARITY = 0.8
#: Bits in which the SimHashes of candidates may differ, as in `simhash`: of pairs at 0.8 about 10 of 64 do.
BUDGET = 3
BANDS, ROWS = 24, 6
#: One byte of so many least hashes is the sketch; in a bucket, texts that agree on LOOSE of them are candidates: 3.5 deviations below the mean at 0.8.
SKETCH, LOOSE = 64, 40
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(piece: pa.RecordBatch, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of shingle hashes, in ascending order, one after the other, and their sizes; fewer words than a shingle: all of them."""
    raw, at = B.utf8(piece.column(text))
    low = B.LOWER[raw]
    starts, ends, row = B.word_bounds(low, at, B.NOT_SPACE)
    words = B.span_hashes(low, starts, ends)
    count = np.bincount(row, minlength=piece.num_rows)
    first = np.cumsum(count) - count
    h = np.zeros(len(words), np.uint64)
    for k in range(min(shingle, len(words))):  # words past the text's end add nothing
        part = B.mix64(words[k:] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        h[: len(words) - k] += np.where(row[k:] == row[: len(words) - k], part, np.uint64(0))
    h = B.mix64(h)
    own = [np.unique(h[a : a + max(1, n - shingle + 1)]) if n else h[:0] for a, n in zip(first.tolist(), count.tolist(), strict=True)]
    return np.concatenate([h[:0], *own]), np.array([len(x) for x in own], np.int64)


def band_keys(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sets, BANDS) keys and (sets, SKETCH) bytes of sets, none of them empty."""
    begin = np.cumsum(sizes) - sizes
    keys, sketch = np.empty((len(sizes), BANDS), np.uint64), np.empty((len(sizes), SKETCH), np.uint8)
    for k, factor in enumerate(_FACTORS):
        # a product's low bits depend on the set's low bits alone: mix before they are used
        least = B.mix64(np.minimum.reduceat(values * factor, begin))
        if k < SKETCH:
            sketch[:, k] = least.astype(np.uint8)
        band = k // ROWS
        keys[:, band] = B.mix64((keys[:, band] if k % ROWS else np.uint64(band)) + least)
    return keys, sketch


def simhashes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of each set, none of them empty: a bit is 1 if set in over half the hashes."""
    out, end, i = np.empty(len(sizes), np.uint64), np.cumsum(sizes), 0
    while i < len(sizes):  # blocks of whole sets
        a = int(end[i] - sizes[i])
        j = max(i + 1, int(np.searchsorted(end, a + (1 << 16), "right")))
        bits = np.unpackbits(values[a : end[j - 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, end[i:j] - sizes[i:j] - a, axis=0, dtype=np.int32)
        out[i:j] = np.packbits(2 * count > sizes[i:j, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        i = j
    return out


def fingerprints(docs: DataFrame, *, text: str, key: str, shingle: int) -> DataFrame:
    """key, row_hash (of the text), node (of the shingle set), fp (its SimHash) and f (band keys, then the sketch) of every row; no words: fp and f null."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, text, 1 << 20):
                values, sizes = shingle_sets(part, text, shingle)
                node, fp, f = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64), [None] * len(sizes)
                at = np.flatnonzero(sizes)
                if len(at):
                    some = sizes[at]
                    node[at] = B.mix64(np.add.reduceat(B.mix64(values + np.uint64(0xD6E8FEB86659FD93)), np.cumsum(some) - some) + some.astype(np.uint64))
                    fp[at] = simhashes(values, some)
                    keys, sketch = band_keys(values, some)
                    for i, x, y in zip(at.tolist(), keys, sketch, strict=True):
                        f[i] = x.tobytes() + y.tobytes()
                own = [pa.array(node.view(np.int64)), pa.array(fp.view(np.int64), mask=sizes == 0), pa.array(f, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("row_hash"), *own], [key, "row_hash", "node", "fp", "f"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, F.xxhash64(F.col(text)).alias("row_hash")).mapInArrow(run, f"`{key}` {kind}, row_hash bigint, node bigint, fp bigint, f binary")


def _dealt(nodes: DataFrame) -> DataFrame:
    """k (band key), node and s (sketch): each node that has words once per band."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(i, 1 << 13)
                f = np.frombuffer(b"".join(part.column("f").to_pylist()), np.uint8).reshape(-1, 8 * BANDS + SKETCH)
                keys, s = np.ascontiguousarray(f[:, : 8 * BANDS]).view(np.int64), pa.array([x.tobytes() for x in f[:, 8 * BANDS :]], pa.binary())
                for band in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, band].copy()), part.column("node"), s], ["k", "node", "s"])

    return nodes.filter("f is not null").select("node", "f").mapInArrow(run, "k bigint, node bigint, s binary")


def _joined(n: int, near) -> np.ndarray:
    """Group of each of n members, named by a member; near(i, far): which of the later members far are linked to i. Members of i's group are not asked for again."""
    group, left = np.arange(n), n
    for i in range(n):
        if left == 1:
            break
        far = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if not len(far):
            continue
        found = np.unique(group[near(i, far)])
        if len(found):
            group[np.isin(group, found)] = group[i]
            left -= len(found)
    return group


def whole_runs(batches, by: str):
    """Batches that hold whole runs of equal `by`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(by).to_numpy()
        last = int(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))[-1])  # the last run may go on in the next batch
        if held and held[-1].column(by)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def trie_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join the nodes whose SimHashes `simhash.fingerprint_links` joins; equal ones are linked to the least of them."""
    first = nodes.filter("fp is not null").groupBy("fp").agg(F.min("node").alias("one"))
    near = fingerprint_links(first.select("fp"), BUDGET)
    for c in "ab":
        near = near.join(first.toDF(c, f"{c}_node"), c)
    equal = nodes.select("node", "fp").join(first, "fp").filter("node <> one")
    return near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).unionByName(equal.select(F.col("node").alias("a"), F.col("one").alias("b")))


def band_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that meet in a bucket; a task holds SKETCH + 16 bytes per member of its largest bucket."""

    def run(batches):
        for t in whole_runs(batches, "k"):
            k, node = t["k"].to_numpy(), t["node"].to_numpy()
            s = np.frombuffer(b"".join(t["s"].to_pylist()), np.uint8).reshape(-1, SKETCH)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
            size = np.diff(edge)
            pair = edge[:-1][size == 2]
            pair = pair[(s[pair] == s[pair + 1]).sum(1) >= LOOSE]
            a, b = [node[pair]], [node[pair + 1]]
            for i in np.flatnonzero(size > 2):
                own, at = s[edge[i] : edge[i + 1]], node[edge[i] : edge[i + 1]]
                group = _joined(len(own), lambda j, far: far[(own[far] == own[j]).sum(1) >= LOOSE])  # noqa: B023
                moved = np.flatnonzero(group != np.arange(len(own)))
                a.append(at[group[moved]])
                b.append(at[moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return _dealt(nodes).repartition("k").sortWithinPartitions("k").mapInArrow(run, "a bigint, b bigint")


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join the candidate groups."""
    both = trie_links(nodes).unionByName(band_links(nodes))
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def exact_groups(sets: list[np.ndarray]) -> np.ndarray:
    """Group of each set, named by a member: sets of similarity SIMILARITY or more are joined, by exact comparison."""
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    values, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mine = np.zeros(len(values), np.int32)

    def near(i, far):
        far = far[: np.searchsorted(size[far], size[i] * 5 // 4, "right")]  # larger sets cannot be similar enough
        if not len(far):
            return far
        mine[own := ids[at[i] : at[i + 1]]] = 1
        if 4 * len(far) > far[-1] - i:
            shared = np.add.reduceat(mine[ids[at[i + 1] : at[far[-1] + 1]]], at[i + 1 : far[-1] + 1] - at[i + 1])[far - i - 1]
        else:
            shared = np.add.reduceat(mine[np.concatenate([ids[at[j] : at[j + 1]] for j in far])], np.cumsum(size[far]) - size[far])
        mine[own] = 0
        return far[9 * shared >= 4 * (size[i] + size[far])]

    out = np.empty(len(sets), np.int64)
    out[order] = order[_joined(len(sets), near)]
    return out


def verified_roots(docs: DataFrame, members: DataFrame, *, text: str, key: str, shingle: int) -> DataFrame:
    """node and root (a node) of members joined by exact similarity. members: g (the candidate group), node, and k and h, the key and hash of a text.

    A candidate group's distinct shingle sets, 8 bytes a shingle, are held and compared by one task.
    """

    def sets(batches):
        for batch in batches:
            for part in B.slices(batch, "t"):
                values, sizes = shingle_sets(part, "t", shingle)
                end = np.cumsum(sizes)
                own = [values[b - n : b].tobytes() for b, n in zip(end.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("g"), part.column("node"), pa.array(own, pa.binary())], ["g", "node", "s"])

    def solve(batches):
        for t in whole_runs(batches, "g"):
            g, node, s = t["g"].to_numpy(), t["node"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t["s"]]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
            root = np.concatenate([node[a:b][exact_groups(s[a:b])] for a, b in zip(edge[:-1], edge[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

    own = docs.select(F.col(key).alias("k1"), F.xxhash64(text).alias("h1"), F.col(text).alias("t"))
    with_text = own.join(members, F.col("k1").eqNullSafe(F.col("k")) & (F.col("h1") == F.col("h"))).select("g", "node", "t")
    return with_text.mapInArrow(sets, "g bigint, node bigint, s binary").dropDuplicates(["node"]).repartition("g").sortWithinPartitions("g").mapInArrow(solve, "node bigint, root bigint")


def near_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """key, row_hash and component_id (the smallest key reachable) of every row.

    Null and empty texts, and texts of white space, are copies of each other. Equal shingle sets share a node and
    meet before the join. Null keys are never a component's id unless all of its keys are null. Repeated rows stay. An
    empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, text=text, key=key, shingle=shingle), "near")
    nodes = stored(fps.groupBy("node").agg(F.min(key).alias("least"), F.first("fp").alias("fp"), F.first("f").alias("f"), F.min(F.struct(F.col(key).alias("k"), F.col("row_hash").alias("h"))).alias("one")), "near-nodes")
    links = stored(candidate_links(nodes), "near-links")
    members = components(links).withColumnRenamed("root", "g").join(nodes.select("node", "one.k", "one.h"), "node")
    roots = stored(verified_roots(docs, members, text=text, key=key, shingle=shingle), "near-roots")
    named = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = stored(named.join(least, "root").select("node", "component_id"), "near-labels")
    return fps.join(label, "node").select(key, "row_hash", "component_id")


def deduplicated(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component."""
    return one_of_each(docs, near_copies(docs, text=text, key=key, shingle=shingle), text, key)

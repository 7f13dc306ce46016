"""SimHash near-duplicates: fingerprints, a binary trie self-join and connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm import bytetext as B
from gradeloom.llm.components import components
from gradeloom.llm.trie import trie_links
from gradeloom.runtime import ship, stored

SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of one lower-cased UTF-8 text; no words: 0."""
    import xxhash

    words = text.split()  # bytes.split() breaks at space and \x09-\x0D, and at nothing else
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1 :] or ends[-1:]
    h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts, last)], np.uint64)
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        count += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """key, row_hash (of the text) and fp (the fingerprint's bits as a signed long) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, text):
                raw, at = B.utf8(part.column(text))
                low = B.LOWER[raw].tobytes()
                fps = np.array([fingerprint(low[i:j], shingle) for i, j in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("row_hash"), pa.array(fps.view(np.int64))], [key, "row_hash", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, F.xxhash64(F.col(text)).alias("row_hash")).mapInArrow(run, f"`{key}` {kind}, row_hash bigint, fp bigint")


def _block_keys(budget: int, blocks: int) -> list[list[tuple[int, int]]]:
    """(shift, width) of the blocks in each choice of blocks - budget of them: two fingerprints within the budget agree on one choice."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    cut = [(edge[i], edge[i + 1] - edge[i]) for i in range(blocks)]
    return [list(c) for c in combinations(cut, blocks - budget)]


def fingerprint_links(nodes: DataFrame, budget: int = 3) -> DataFrame:
    """Links (a, b) between fingerprints that join exactly the groups that all pairs within the budget would join.

    nodes: distinct fp. Each fingerprint goes to one subtree per choice of blocks - budget out of budget + 2 blocks, so
    that any two within the budget meet in one; each subtree is walked as a trie and gives one link per member of a
    group to the group's least, never all pairs. A task holds 8 bytes per fingerprint of its largest subtree.
    """
    ship(nodes.sparkSession)
    tables = _block_keys(budget, budget + 2)
    keys = []
    for t, blocks in enumerate(tables):
        k, n = F.lit(t).cast("long"), 0
        for shift, width in blocks:
            k = F.shiftleft(k, width).bitwiseOR(F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1)))
            n += width
        assert n <= 57
        keys.append(k)
    dealt = nodes.select("fp", F.explode(F.array(*keys)).alias("k"))

    def subtree(fps: np.ndarray):
        v = np.sort(fps.view(np.uint64))
        root = trie_links(v, budget)
        moved = np.flatnonzero(root != np.arange(len(v)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(v[root[moved]].view(np.int64)), pa.array(v[moved].view(np.int64))], ["a", "b"])

    def run(batches):
        left_k, left = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("k").to_numpy()
            fp = batch.column("fp").to_numpy()
            cuts = np.flatnonzero(np.diff(k)) + 1
            if left_k is not None and left_k != k[0]:
                whole, left = np.concatenate(left), []
                if len(whole) > 1:
                    yield from subtree(whole)
            if not len(cuts):
                left.append(fp)
                left_k = k[0]
                continue
            first = np.concatenate([*left, fp[: cuts[0]]])
            if len(first) > 1:
                yield from subtree(first)
            size = np.diff(cuts)
            for i in np.flatnonzero(size > 1):
                yield from subtree(fp[cuts[i] : cuts[i + 1]])
            left_k, left = k[-1], [fp[cuts[-1] :]]
        if left:
            whole = np.concatenate(left)
            if len(whole) > 1:
                yield from subtree(whole)

    return dealt.repartition("k").sortWithinPartitions("k").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, budget: int = 3) -> DataFrame:
    """key, row_hash, fingerprint (16 hex digits) and component_id (the smallest key reachable) of every row.

    Null and empty texts, and texts of white space, have fingerprint 0, which links like any other. Exact copies share a
    fingerprint and meet before the join. Null keys are never a component's id unless all of its keys are null. Repeated
    rows stay. An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, text=text, key=key, shingle=shingle), "simhash")
    nodes = stored(fps.groupBy("fp").agg(F.min(key).alias("least")), "simhash-nodes")
    roots = components(fingerprint_links(nodes.select("fp"), budget))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = stored(named.join(least, "root").select("fp", "component_id"), "simhash-labels")
    return fps.join(label, "fp").select(key, "row_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame, text: str, key: str) -> DataFrame:
    """docs with one row of each component of groups: the one with the smallest key (of several, the one with the smallest text hash)."""
    stay = groups.groupBy("component_id").agg(F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("row_hash").alias("h"))).alias("s"))
    stay = stay.select(F.col("s.k").alias("__sim_key"), F.col("s.h").alias("__sim_hash"))
    marked = docs.withColumn("__sim_hash", F.xxhash64(F.col(text)))
    kept = marked.join(stay, marked[key].eqNullSafe(stay["__sim_key"]) & (marked["__sim_hash"] == stay["__sim_hash"]), "left_semi")
    return kept.dropDuplicates([key, "__sim_hash"]).drop("__sim_hash")


def deduplicated(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, budget: int = 3) -> DataFrame:
    """docs with one row of each component."""
    return one_of_each(docs, near_duplicates(docs, text=text, key=key, shingle=shingle, budget=budget), text, key)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Nulls, empty texts and ties: see `near_duplicates`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")

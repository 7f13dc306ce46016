"""SentencePiece encoding and decoding by a table of distinct marked words, joined back by position.

A piece that holds a white-space marker after another character would reach over the start of a word. Where the model has
none, a word with the markers before it is segmented alike wherever it stands, so each distinct one is segmented once.

Texts become numbers of words within blocks of bounded size. Each block asks once for each of its distinct words; the asked
words are sorted, so equal ones are neighbours, are segmented once, and their ids go back packed to the blocks that asked.
Neither texts nor occurrences of words are shuffled, and nothing is stored on the way: the texts are read twice instead.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm import bytetext as B
from gradeloom.runtime import ship

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Characters of the texts whose distinct words a task numbers together; a longer text is a block of its own.
BLOCK_CHARS = 32 << 20
#: Answers that a task packs by block before it sends them on.
PACKED_WORDS = 1 << 20
_MODELS: dict[str, Pieces] = {}


class Pieces:
    """A model's marked words, their ids and the text of ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", self.model.id_to_piece(i)) for i in range(size))
        self.prefixed = self.model.normalize("a").startswith(MARK)
        self.digits = [str(i) for i in range(size)]
        self.width = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")

    def words(self, text: str) -> list[str]:
        """The marked words of a text: all of it as one where pieces cross markers."""
        marked = self.model.normalize(text)
        return WORDS.findall(marked) if self.apart else [marked] if marked else []

    def encode(self, words: list[str]) -> list[list[int]]:
        """ids of each marked word. The model puts its own marker before a text, so the word's first one is left out."""
        ids = self.model.encode([w[1:] if self.prefixed else w for w in words], out_type=int, add_bos=False, add_eos=False, num_threads=1)
        return [[self.model.piece_to_id(MARK)] if w == MARK and self.prefixed else x for w, x in zip(words, ids, strict=True)]


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def squeeze(data: np.ndarray) -> bytes:
    """An array's bytes, compressed, their number before."""
    return data.nbytes.to_bytes(8, "little") + pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def release(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^28 in groups of seven bits, the last group marked by its high bit, compressed."""
    groups = np.stack([(numbers >> 7 * i) & 127 for i in range(4)], 1).astype(np.uint8)
    last = (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    groups[np.arange(len(numbers)), last] |= 128
    return squeeze(groups[np.arange(4) <= last[:, None]])


def unpack(data: bytes) -> np.ndarray:
    a = np.frombuffer(release(data), np.uint8)
    end = np.flatnonzero(a >= 128)
    if not len(end):
        return np.zeros(0, np.int64)
    start = np.concatenate([[0], end[:-1] + 1])
    shift = 7 * (np.arange(len(a)) - np.repeat(start, end - start + 1))
    return np.add.reduceat((a & 127).astype(np.int64) << shift, start)


def proof(words: list[str], numbers: np.ndarray) -> int:
    """A sum over words and their numbers, so that answers can be held against what was asked."""
    crc = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.uint64, len(words))
    return int((crc * (numbers.astype(np.uint64) * np.uint64(2) + np.uint64(1))).sum().astype(np.int64))


def numbered(docs: DataFrame, model: str, text: str, key: str, block_chars: int, *, texts: bool) -> DataFrame:
    """block, word, no for each distinct word of each block, the most frequent first; or block, key, seq (the text's
    word numbers), n and proof (of the block's words) for each of the texts. Both number alike what they read alike."""

    def blocks(batches, own):
        known, seqs, keys, held, n = {}, [], [], 0, 0
        for batch in batches:
            for part in B.slices(batch, "t"):
                for i, t in enumerate(part.column("t").to_pylist()):
                    if held and held + len(t or "") > block_chars:
                        yield n, known, seqs, keys
                        known, seqs, keys, held, n = {}, [], [], 0, n + 1
                    seqs.append(np.array([known.setdefault(w, len(known)) for w in own.words(t or "")], np.int32))
                    keys.append(part.column("key").slice(i, 1))
                    held += len(t or "") + 1
        if seqs:
            yield n, known, seqs, keys

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 24
        for n, known, seqs, keys in blocks(batches, pieces(model)):
            order = np.argsort(-np.bincount(np.concatenate(seqs), minlength=len(known)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            if texts:
                sums = np.array([[base + n, len(known), proof(list(known), rank)]] * len(seqs), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sums[:, 0]), pa.concat_arrays(keys), pa.array([pack(rank[s]) for s in seqs], pa.binary()), pa.array(sums[:, 1]), pa.array(sums[:, 2])], ["block", "key", "seq", "n", "proof"])
            else:
                words = pa.array(list(known), pa.string())
                order = pc.sort_indices(words)  # like words in a row take less room in the shuffle
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), base + n)), words.take(order), pa.array(rank.astype(np.int32)).take(order)], ["block", "word", "no"])

    given = docs.select(F.col(text).alias("t"), F.col(key).alias("key"))  # the same columns both times, as what is read may hang on them
    return given.mapInArrow(run, f"block bigint, key {docs.schema[key].dataType.simpleString()}, seq binary, n bigint, proof bigint" if texts else "block bigint, word string, no int")


def answers(asked: DataFrame, model: str) -> DataFrame:
    """block, n, proof and nos, sizes, ids (packed) of the words asked: rows come sorted by word, and each distinct word is segmented once."""

    def packed(held, own):
        block, no, crc, size, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        first = np.cumsum(size) - size
        order = np.argsort(block, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            n = size[rows]
            flat = ids[np.repeat(first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(own.width)
            total = int((crc[rows] * (no[rows].astype(np.uint64) * np.uint64(2) + np.uint64(1))).sum().astype(np.int64))
            yield pa.RecordBatch.from_pydict({"block": pa.array(block[rows[:1]]), "n": pa.array([len(rows)], pa.int64()), "proof": pa.array([total], pa.int64()), "nos": pa.array([pack(no[rows])]), "sizes": pa.array([pack(n)]), "ids": pa.array([squeeze(flat)])})

    def run(batches):
        own, held, rows, last = pieces(model), [], 0, (None, [])
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            fresh = np.array([a != b for a, b in zip(words, [last[0], *words], strict=False)])
            new = [words[i] for i in np.flatnonzero(fresh)]
            found = [last[1], *own.encode(new)]
            last = (words[-1], found[-1])
            at = np.cumsum(fresh)
            size = np.fromiter(map(len, found), np.int64, len(found))
            start = np.cumsum(size) - size
            crc = np.fromiter((zlib.crc32(w.encode()) for w in [words[0], *new]), np.uint64, len(found))  # the first is that of the word carried over, if any
            flat, n = np.array([x for f in found for x in f], np.int64), size[at]
            held.append((batch.column("block").to_numpy(), batch.column("no").to_numpy().astype(np.int64), crc[at], n, flat[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]))
            rows += len(words)
            if rows >= PACKED_WORDS:
                yield from packed(held, own)
                held, rows = [], 0
        if held:
            yield from packed(held, own)

    return asked.repartition("word").sortWithinPartitions("word").mapInArrow(run, "block bigint, n bigint, proof bigint, nos binary, sizes binary, ids binary")


def assembled(sent: DataFrame, texts: DataFrame, model: str, kind: str) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each text of a block, from the block's answers."""

    def ids_of(given: pa.Table, n: int, wanted: int, own: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's first id, their number, and all ids."""
        if sum(given.column("n").to_pylist()) != n or (sum(given.column("proof").to_pylist()) - wanted) % (1 << 64):
            raise RuntimeError("texts were not read alike twice: store them first")
        first, count, parts, used = np.zeros(n, np.int64), np.zeros(n, np.int64), [np.zeros(0, own.width)], 0
        for nos, sizes, ids in zip(*(given.column(c).to_pylist() for c in ("nos", "sizes", "ids")), strict=True):
            at, size = unpack(nos), unpack(sizes)
            first[at], count[at] = used + np.cumsum(size) - size, size
            parts.append(np.frombuffer(release(ids), own.width))
            used += len(parts[-1])
        return first, count, np.concatenate(parts)

    def run(given: pa.Table, asking: pa.Table) -> pa.Table:
        own, out = pieces(model), []
        if asking.num_rows:
            first, count, flat = ids_of(given, asking.column("n")[0].as_py(), asking.column("proof")[0].as_py(), own)
        elif given.num_rows:
            raise RuntimeError("texts were not read alike twice: store them first")
        for seq in asking.column("seq").to_pylist():
            words = unpack(seq)
            size = count[words]
            found = flat[np.repeat(first[words] - np.cumsum(size) + size, size) + np.arange(size.sum())].tolist()
            out.append((len(found), hashlib.sha256(",".join(map(own.digits.__getitem__, found)).encode()).hexdigest(), hashlib.sha256(own.model.decode(found).encode()).hexdigest()))
        n, a, b = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_arrays([asking.column("key"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return sent.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, model: str, *, text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the ids' text) of every row.

    Null texts count as empty, which have no ids. Repeated rows, rows with one key and null keys stay, each with its own
    result. An empty table gives an empty result. docs is read twice, alike, as files and stored tables are; where it is
    not, the run fails and no wrong row comes out. A task holds one block: the ids of its distinct
    words and the packed numbers of its texts' words. A word of all blocks has one row a block (of 32 M characters) in
    the task that segments it.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    sent = answers(numbered(docs, model, text, key, block_chars, texts=False), model)
    return assembled(sent, numbered(docs, model, text, key, block_chars, texts=True), model, kind).withColumnRenamed("key", key)


def op13_pieces(spark, sf_dir: str) -> DataFrame:
    """ids and decoded text of every whole text. Nulls, repeated rows and empty tables: see `encoded`."""
    import public_tokenizers

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

"""Token-ID output: whole texts to ids of a public tokenizer, in patched frame-of-reference files, and back."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.llm import bytetext as B
from gradeloom.llm.pfor import Reader, Writer
from gradeloom.runtime import run_folder, ship, stored

#: Characters with the Unicode property White_Space, which the tokenizer's pattern splits at.
SPACES = "\t-\r \x85\xa0  -     　"
#: A space and what follows up to the next white space: the tokenizer's pattern never joins two of these pieces.
PIECE = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: The tokenizer's own pattern within a piece that holds more than letters.
PARTS = "'(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\p{L}\\p{N}]+"
#: Below it the classes of letters and digits are the same in all versions of Unicode that matter here.
SETTLED = "\u0500"
#: Pieces, and words within them, that a Python worker remembers; beyond that it starts anew.
MOST_PIECES, MOST_WORDS = 500_000, 1_000_000
FILE_BYTES = 32 << 20
_ENCODERS: dict[str, PieceEncoder] = {}


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Number of each piece in order of first use; pieces that are new are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at


class PieceEncoder:
    """Encodes texts piece by piece and remembers each piece's ids; the ids are those of the whole text.

    A text that holds one of the tokenizer's added tokens is encoded as a whole, as these are split off before pieces are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self.parts, self.words = regex.compile(PARTS).findall, {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.forget()

    def forget(self) -> None:
        self.known = _Pieces()
        self.first, self.count, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 0

    def _word(self, word: str) -> list[int]:
        """ids of one input of the model."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= MOST_WORDS:
                self.words.clear()
            found = self.words[word] = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]
        return found

    def _ids(self, piece: str) -> list[int]:
        body = piece[1:] if piece[0] == " " else piece
        if body.isalpha():  # letters alone
            return self._word(piece)
        if body and body[0] not in SPACES and max(body) < SETTLED:
            return [x for w in self.parts(piece) for x in self._word(w)]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _learn(self) -> None:
        """ids of the pieces noted as new, in order."""
        ids = [self._ids(p) for p in self.known.new]
        self._add(ids)
        self.known.new.clear()

    def _add(self, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        n = len(self.known) - len(ids)
        while n + len(ids) > len(self.first):
            self.first, self.count = np.append(self.first, np.zeros_like(self.first)), np.append(self.count, np.zeros_like(self.count))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.first[n : n + len(ids)] = self.used + np.cumsum(size, dtype=np.int64) - size
        self.count[n : n + len(ids)] = size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each followed by `end`, and the number of ids of each."""
        if len(self.known) > MOST_PIECES:
            self.forget()
        pieces, last, whole = [], np.empty(len(texts), np.int64), {}
        for i, t in enumerate(texts):
            if self.added.search(t):
                whole[i] = self.tokenizer.encode(t, add_special_tokens=False).ids
            else:
                pieces += PIECE.findall(t)
            last[i] = len(pieces)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        if self.known.new:
            self._learn()
        size = self.count[at]
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        found = self.flat[np.repeat(self.first[at] - upto[:-1], size) + np.arange(upto[-1])]
        stop = upto[last]
        for i in sorted(whole, reverse=True):
            found = np.concatenate([found[: stop[i]], np.array(whole[i], np.uint32), found[stop[i] :]])
            stop[i:] += len(whole[i])
        return np.insert(found, stop, end), np.diff(stop, prepend=0) + 1


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, *, text: str = "text", key: str = "doc_id", end: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes token files in ascending order of key and returns file, part and tokens of each, stored.

    Ranges of keys are files; rows with one key are ordered by their text's hash. Every attempt of a task writes files of
    its own name; the returned table names those of the committed attempts.
    """
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-total // file_bytes))
    rows = docs.select(key, text, F.xxhash64(text).alias("h")).withColumn("salt", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts, F.col(key), "h", "salt").sortWithinPartitions(key, "h").drop("h", "salt")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name, out, keys = f"tokens-{part:07d}-{uuid.uuid4().hex}.pfor", None, []
        enc = encoder(tokenizer)
        for batch in batches:
            for piece in B.slices(batch, text, 1 << 20):
                if out is None:
                    sink = store.open_output_stream(f"{path}/{name}")
                    out = Writer(sink)
                ids, counts = enc.encode([t or "" for t in piece.column(text).to_pylist()], end)
                out.add(ids, counts)
                keys.append(piece.column(key))
        if out is not None:
            out.close()
            sink.close()
            with store.open_output_stream(f"{path}/{name}.keys") as side, pa.ipc.new_file(side, pa.schema([(key, keys[0].type)])) as table:
                table.write_table(pa.table([pa.chunked_array(keys)], [key]))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([out.total], pa.int64())], ["file", "part", "tokens"])

    return stored(ordered.mapInArrow(run, "file string, part bigint, tokens bigint"), "token-files")


def read_tokens(files: DataFrame, folder: str, key: str, key_type: str) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every document, from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    n = max(1, files.count())

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}.keys") as side:
                    keys = pa.ipc.open_file(side).read_all().column(key).combine_chunks()
                with store.open_input_file(f"{path}/{name}") as source:
                    reader = Reader(source)
                    for first, ids, at in reader.documents():
                        data = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        start = reader.docs[first : first + len(crc)] + base
                        yield pa.RecordBatch.from_arrays([keys.slice(first, len(crc)), pa.array(start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return placed.repartitionByRange(n, "part").select("file", "before").mapInArrow(run, f"`{key}` {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", end: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every row, read back from the files written.

    Null and empty texts have the end id alone. Null keys come first. Repeated rows and rows with one key stay, each with
    ids of its own. An empty table writes no file and gives an empty result.
    """
    folder = run_folder(docs.sparkSession, "tokens")
    files = write_tokens(docs, tokenizer, folder, text=text, key=key, end=end, file_bytes=file_bytes)
    return read_tokens(files, folder, key, docs.schema[key].dataType.simpleString())


def op3_tokens(spark, sf_dir: str) -> DataFrame:
    """ids of every whole text, read back from the files. Nulls, added tokens and empty tables: see `token_files`."""
    import public_tokenizers

    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

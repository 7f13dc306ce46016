"""Media columns: content-addressed payloads in tar shards, in the shared folder.

A payload is stored as an 8-bit greyscale PNG (lossless; one byte is one sample). Each task writes tar shards of its own
and stores a payload once per shard; members are named by the payload's digest. Rows carry digest, shard, offset and
length. Of a digest's places the first is canonical; the others are what later compaction may drop. Reading back goes
shard by shard in order of offset: a range read of the member's first bytes gives the metadata columns, a second one
the samples. Only digests and places are shuffled, never payloads.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm import bytetext as B
from gradeloom.runtime import run_folder, ship, stored

UNIT = 576
#: Bytes before a PNG's image data: signature, the IHDR chunk and the first chunk's length and type.
HEADER = 41
SHARD_BYTES = 256 << 20
#: Stored bytes that a task reads back, about.
STRETCH = 16 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def text_payload(text: Column) -> Column:
    """UTF-8 bytes (null: none) with bytes 255 to the next positive multiple of 576."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(UNIT))) * UNIT
    return F.rpad(raw, size.cast("int"), F.lit(b"\xff"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image of 576 samples a row, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    ihdr = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", ihdr) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    """Width, height, bit depth and colour type from a PNG's first bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def decode_png(data: bytes) -> bytes:
    """Samples of an unfiltered 8-bit greyscale PNG; checks every chunk."""
    at, image, head = 8, b"", png_header(data[:HEADER])
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(data[at + 4 : at + 8 + size]):
            raise ValueError("damaged chunk")
        if data[at + 4 : at + 8] == b"IDAT":
            image += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(image), np.uint8).reshape(head["height"], head["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return lines[:, 1:].tobytes()


def write_shards(rows: DataFrame, payload: str, folder: str) -> DataFrame:
    """rows, its column `payload` (binary) replaced by digest, shard, offset and length; stored.

    A shard is written under a name of its own attempt, so that a task that runs again never meets a half-written one;
    the stored rows name the shards of the attempts that were committed.
    """
    ship(rows.sparkSession)
    names = [c for c in rows.columns if c != payload]

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, shard, at, places = None, None, 0, {}
        for batch in batches:
            digests, shards, offsets, lengths = [], [], [], []
            for value in batch.column(payload):
                data = value.as_buffer().to_pybytes()
                digest = hashlib.sha256(data).hexdigest()
                if digest not in places:
                    if out is not None and at >= SHARD_BYTES:
                        out.write(b"\0" * 1024)
                        out.close()
                        out, places = None, {}
                    if out is None:
                        shard, at = f"shard-{uuid.uuid4().hex}.tar", 0
                        out = store.open_output_stream(f"{path}/{shard}")
                    image = encode_png(data)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(image)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head)
                    out.write(image)
                    out.write(b"\0" * (-len(image) % 512))
                    places[digest] = (at + len(head), len(image))
                    at += len(head) + len(image) + -len(image) % 512
                digests.append(digest)
                shards.append(shard)
                offsets.append(places[digest][0])
                lengths.append(places[digest][1])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(digests, pa.string()), pa.array(shards, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], [*names, "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return stored(rows.mapInArrow(run, f"{schema}, digest string, shard string, offset bigint, length bigint"), "media-rows")


READ = "digest string, shard string, offset bigint, length bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, width int, height int, bit_depth int, feature string"


def read_members(places: DataFrame, folder: str) -> DataFrame:
    """Metadata and features of the members at digest, shard, offset, length, from the stored bytes."""
    ship(places.sparkSession)

    def feature(samples: np.ndarray) -> str:
        count = np.bincount(samples, minlength=256)
        share = count[count > 0] / len(samples)
        x = np.arange(256)
        mean = float((count * x).sum() / len(samples))
        return json.dumps({"samples": len(samples), "levels": int((count > 0).sum()), "mean": round(mean, 6), "std": round(float(np.sqrt((count * (x - mean) ** 2).sum() / len(samples))), 6), "entropy": round(float(-(share * np.log2(share)).sum()), 6)}, sort_keys=True)

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for digest, shard, offset, length in zip(*[batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")], strict=True):
                if shard != name:
                    if source is not None:
                        source.close()
                    name, source = shard, store.open_input_file(f"{path}/{shard}")
                head = png_header(source.read_at(HEADER, offset))
                media = source.read_at(length, offset)
                data = decode_png(media)
                found = hashlib.sha256(data).hexdigest()
                if found != digest:
                    raise ValueError(f"member {digest} of {shard} holds {found}")
                out.append((digest, shard, offset, length, len(data), found, zlib.crc32(data[-32:]), length, hashlib.sha256(media).hexdigest(), head["width"], head["height"], head["bit_depth"], feature(np.frombuffer(data, np.uint8))))
            if out:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])
        if source is not None:
            source.close()

    return places.select("digest", "shard", "offset", "length").mapInArrow(run, READ)


def media_columns(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, digest, shard, offset, length and what is read back of every row's payload.

    Null and empty texts are one payload of 576 bytes 255. Equal texts share a digest and so all values; repeated rows
    stay. Other input columns are left out. An empty table writes no shard and gives an empty result.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "media")
    rows = write_shards(docs.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text_payload(F.col(text)).alias("payload")), "payload", folder)
    canon = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    # dealt by shard and 4 MB of it, so that a task reads one stretch of a shard from front to back
    # by number: the places are small whatever they point to, so they must not be coalesced
    total = rows.agg(F.sum("length")).first()[0] or 0
    dealt = canon.repartition(max(1, -(-total // STRETCH)), "shard", F.floor(F.col("offset") / F.lit(4 << 20))).sortWithinPartitions("shard", "offset")
    read = stored(read_members(dealt, folder), "media-read")
    # both sides are stored tables: a digest that many rows have can be split over tasks
    return rows.drop("shard", "offset", "length").join(read, "digest")


def op1_media(spark, sf_dir: str) -> DataFrame:
    """What is read back of every document's payload. Nulls, empty texts, ties and empty tables: see `media_columns`."""
    out = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height", "bit_depth")

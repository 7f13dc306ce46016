"""WARC derivatives: responses to linked metadata and plain-text conversion records.

Responses are read record by record by their offsets, each a gzip member of its own. A derived record names the response
it comes from in WARC-Refers-To, and carries its URI, date, payload digest and the headers its server sent.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm import bytetext as B
from gradeloom.runtime import run_folder, ship, stored

#: Date of records whose page has none.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
#: Compressed bytes of responses that a task derives from, about.
STRETCH = 4 << 20
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gradeloom:warc")

# Every pattern goes on to the page's end where its own end is missing, so that no part of a page is searched twice.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*(?:>.*?(?:</\1\b[^>]*(?:>|\Z)|\Z)|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*(?:>(.*?)(?:</title\b|\Z)|\Z)", re.S | re.I)
_ANCHOR = re.compile(r"<a\b([^>]*)(?:>|\Z)", re.I)
_HREF = re.compile(r"""\bhref\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ROOT = re.compile(r"<html\b([^>]*)(?:>|\Z)", re.I)
_LANG = re.compile(r"""\blang\s*+=\s*+["']?([\w-]+)""", re.I)
_BREAK = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|nav|header|footer|title|blockquote|pre)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*(?:>|\Z)")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def shown(page: str) -> str:
    """A page without comments, scripts and styles."""
    return _HIDDEN.sub(" ", page)


def plain_text(page: str) -> str:
    """What a reader sees of a page that is `shown`: no markup; blocks on lines of their own."""
    text = _TAG.sub("", _BREAK.sub("\n", page))
    return _LINES.sub("\n", _BLANKS.sub(" ", entities.unescape(text))).strip()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member; the block's length and digest are checked."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or headers.get("WARC-Block-Digest", digest(block)) != digest(block):
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


def response(page_id, url: str | None, page: str | None, nth: int = 0) -> tuple[str, bytes]:
    """Record id and record of one page; a null url leaves the URI out, a null page is empty. nth tells repeated rows apart."""
    body = (page or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    own = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{url}|{hashlib.sha1(body).hexdigest()}' + (f'|{nth}' if nth else ''))}>"
    uri = [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))] if url else []
    return own, record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE), *uri, ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http)), ("Content-Type", "application/http; msgtype=response")], http)


def derive(headers: dict[str, str], block: bytes) -> list[tuple[str, str, list[tuple[str, str]], bytes]]:
    """(type, id, headers, block) of the metadata and the conversion record of a response."""
    http, _, body = block.partition(b"\r\n\r\n")
    page = body.decode("utf-8", "replace")
    source = [x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:] if ": " in x]
    refers = headers["WARC-Record-ID"]
    shared = [("WARC-Refers-To", refers), ("WARC-Date", headers["WARC-Date"])] + ([("WARC-Target-URI", headers["WARC-Target-URI"])] if "WARC-Target-URI" in headers else [])
    title, root, seen = _TITLE.search(page), _ROOT.search(page), shown(page)
    lang = _LANG.search(root[1]) if root else None
    found = (_HREF.search(m[1]) for m in _ANCHOR.finditer(seen))
    links = list(dict.fromkeys(entities.unescape(next(g for g in m.groups() if g is not None)) for m in found if m))
    fields = [("source-payload-digest", headers.get("WARC-Payload-Digest", digest(body))), ("source-block-digest", headers.get("WARC-Block-Digest", digest(block)))]
    fields += [(f"source-{k.lower()}", v) for k, v in source]
    if title and title[1]:
        fields.append(("title", " ".join(entities.unescape(title[1]).split())))
    if lang:
        fields.append(("language", lang[1]))
    fields += [("outlink", re.sub(r"[\r\n]+", "", x)) for x in links]
    text = plain_text(seen).encode()
    out = []
    for kind, content, data in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()), ("conversion", "text/plain; charset=utf-8", text)):
        own = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}|{refers}')}>"
        extra = [("WARC-Source-Payload-Digest", headers.get("WARC-Payload-Digest", digest(body)))]
        out.append((kind, own, [("WARC-Type", kind), ("WARC-Record-ID", own), *shared, *extra, ("WARC-Block-Digest", digest(data)), ("Content-Type", content)], data))
    return out


def _info(name: str) -> bytes:
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


#: Kinds of repeated rows that are sent to all tasks; more of them are joined by a shuffle of the pages.
MOST_KINDS = 1 << 16


def _numbered(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """pages with nth: 0 where no other row is alike, else a number of the row's own."""
    own = pages.select(key, url, page).withColumn("h", F.xxhash64(F.col(key), F.col(url), F.col(page)))
    kinds = stored(own.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", F.lit(True).alias("many")), "warc-repeats")
    found = kinds.count()
    if not found:
        return own.select(key, url, page, F.lit(0).cast("long").alias("nth"))
    marked = own.withColumn("row", F.monotonically_increasing_id() + 1).join(F.broadcast(kinds) if found <= MOST_KINDS else kinds, "h", "left")
    return marked.select(key, url, page, F.when(F.col("many"), F.col("row")).otherwise(F.lit(0)).alias("nth"))


def write_responses(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One response record per row; key, file, offset and length of each, stored. A task writes one file, named by its attempt."""
    ship(pages.sparkSession)

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, out, at = f"responses-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for piece in B.slices(batch, page):
                rows = []
                for k, u, p, nth in zip(*[piece.column(c).to_pylist() for c in (key, url, page, "nth")], strict=True):
                    if out is None:
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                        at = out.write(_info(name))
                    _, data = response(k, u, p, nth)
                    out.write(data)
                    rows.append((at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([piece.column(key), pa.array([name] * len(rows)), *[pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]], [key, "file", "offset", "length"])
        if out is not None:
            out.close()

    kind = pages.schema[key].dataType.simpleString()
    return stored(_numbered(pages, key, url, page).mapInArrow(run, f"`{key}` {kind}, file string, offset bigint, length bigint"), "warc-responses")


DERIVED = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, source_payload_digest string, block_digest string, content_length bigint, source_headers string, file string, offset bigint, length bigint"


def write_derivatives(index: DataFrame, folder: str, *, key: str = "page_id") -> DataFrame:
    """Metadata and conversion records of the responses at file, offset and length; a row for each, stored."""
    ship(index.sparkSession)
    names = [x.split()[0] for x in DERIVED.split(", ")]

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        name, out, at, now, source = f"derived-{uuid.uuid4().hex}.warc.gz", None, 0, None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True):
                if file != now:
                    if source is not None:
                        source.close()
                    now, source = file, store.open_input_file(f"{path}/{file}")
                headers, block = parse(source.read_at(length, offset))
                http = block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]
                for kind, own, head, data in derive(headers, block):
                    if out is None:
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                        at = out.write(_info(name))
                    packed = record(head, data)
                    out.write(packed)
                    rows.append((kind, own, headers["WARC-Record-ID"], headers.get("WARC-Target-URI"), headers["WARC-Date"], headers["WARC-Payload-Digest"], digest(data), len(data), json.dumps(dict(x.split(": ", 1) for x in http)), name, at, len(packed)))
                    at += len(packed)
            if rows:
                kinds = [pa.int64() if x.endswith("bigint") else pa.string() for x in DERIVED.split(", ")]
                twice = batch.column(key).take(pa.array([i // 2 for i in range(len(rows))]))
                yield pa.RecordBatch.from_arrays([twice, *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], [key, *names])
        for x in (out, source):
            if x is not None:
                x.close()

    # by number: what the index weighs says nothing of the records behind it, so it must not be coalesced
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.repartition(max(1, -(-total // STRETCH)), "file", F.floor(F.col("offset") / F.lit(1 << 18))).sortWithinPartitions("file", "offset")
    kind = index.schema[key].dataType.simpleString()
    return stored(dealt.mapInArrow(run, f"`{key}` {kind}, {DERIVED}"), "warc-derived")


def derivatives(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Two rows, metadata and conversion, for every row of pages, from records that were written, read and derived.

    Null and empty pages give an empty conversion; null urls a null target_uri; repeated rows give records of their own,
    with ids of their own. Markup that is not closed ends with the page. Other input columns are left out. An empty table writes nothing and gives an empty result.
    """
    folder = run_folder(pages.sparkSession, "warc")
    return write_derivatives(write_responses(pages, folder, key=key, url=url, page=page), folder, key=key)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages. Nulls, repeated rows, open markup and empty tables: see `derivatives`."""
    return derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("file", "offset", "length")

"""WARC archives: written by Spark's own writer, read back record by record, assembled into one nested row per capture."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import methodcaller

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import by_batch, salted, small_batches, stored

RECORD = "file string, place long, warc_type string, record_id string, concurrent_to array<string>, headers map<string,string>, block binary"
#: The records a capture is about; requests and metadata go with one of these.
PRIMARY = ("response", "revisit", "resource")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 4096
_COLON = methodcaller("partition", ":")
_KIND = re.compile(rb"\r\nwarc-type:[ \t]*([^\r\n]*)", re.I)


@lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _shrink(x: bytes) -> bytes:
    return _codec()[0].compress(x)


def _grow(x: bytes) -> bytes:
    return _codec()[1].decompress(x)


_URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)")


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, which is how archives are read in part."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    data = head.encode() + block + b"\r\n\r\n"
    coder = zlib.compressobj(4 if len(data) > 1024 else 6, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def _uri(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url or "about:blank")


def capture_records(url: str | None, payload: bytes, digest: bytes, ids: tuple[str, str, str], refers_to: str | None, fields: dict[str, str], date: str) -> bytes:
    """The request, the response or revisit, and the metadata record of one capture; the latter two ids name the first's partners."""
    response_id, request_id, metadata_id = (f"<urn:uuid:{x}>" for x in ids)
    uri = _uri(url)
    host, path = (m[1], m[2] or "/") if (m := _URL.match(uri)) else ("", "/")
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    proof = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        main = _record([("WARC-Type", "response"), ("WARC-Record-ID", response_id), *common, *proof], http + payload)
    else:
        main = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", response_id), *common, *proof, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers_to}>")], http)
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", request_id), *common, ("WARC-Concurrent-To", response_id), ("Content-Type", "application/http;msgtype=request")], f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    about = "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata_id), *common, ("WARC-Concurrent-To", response_id), ("Content-Type", "application/warc-fields")], about)
    return request + main + metadata


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def write_captures(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", row_bytes: int = 4 << 20, rows_per_file: int = 16) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row of pages (page_id, url, html).

    The payload is html in UTF-8; null counts as empty. Of the rows with equal payloads of at least least_bytes, that
    with the largest page_id (nulls last, then the largest url) is a response and the others are revisits that refer to it;
    smaller ones are all responses. Equal rows, page_id and url and all, are numbered, so that each is a capture of its own; those with the
    largest page_id are all responses. Other columns are not looked at.

    The payloads are shuffled once, compressed, by digest and a salt of page_id, so a payload that a third of all pages have is
    dealt out; what is joined to them is one row per digest and salt that occurs. Spark's text writer commits the
    files: a row is the gzip members of captures, three for each, up to row_bytes or those of one capture, and without the last byte, which is the high byte of a metadata
    record's length and so 0, and which the writer puts back as its line separator. A file has rows_per_file rows at most."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    base = base.withColumn("salt", salted("digest", "page_id"))
    large = base.where(F.octet_length("payload") >= least_bytes)
    last = large.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.collect_set("salt").alias("salts"))
    last = last.select("digest", F.explode("salts").alias("salt"), "last", _uuid(F.lit("response"), F.col("last.page_id"), F.col("last.url"), F.hex("digest"), F.lit(1)).alias("last_id"))
    packed = base.mapInArrow(by_batch(_packed), "page_id long, url string, payload binary, digest binary, salt int")
    joined = packed.join(last, ["digest", "salt"], "left")
    # the join has brought equal rows together, so that numbering them takes no further shuffle
    numbered = joined.withColumn("nth", F.row_number().over(Window.partitionBy("digest", "salt", "page_id", "url").orderBy(F.lit(0))))
    repeats = F.col("last.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    ids = [_uuid(F.lit(role), F.col("page_id"), F.col("url"), F.hex("digest"), F.col("nth")).alias(role) for role in ("response", "request", "metadata")]
    rows = numbered.select("page_id", "url", "payload", "digest", *ids, F.when(repeats, F.col("last_id")).alias("refers_to"), F.when(repeats, F.col("last.page_id")).alias("refers_page"))

    def row(captures: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(captures)[:-1]], pa.binary())], names=["members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                page_id, url, payload, digest, response, request, metadata, refers_to, refers_page = r
                fields = {k: str(v) for k, v in (("page-id", page_id), ("refers-to-page-id", refers_page)) if v is not None}
                out.append(capture_records(url, _grow(payload), digest, (response, request, metadata), refers_to, fields, date))
                held += len(out[-1])
                if held >= row_bytes:
                    yield row(out)
                    out, held = [], 0
        if out:
            yield row(out)

    rows.mapInArrow(run, "members binary").select(F.col("members").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", rows_per_file).text(path)


def _packed(b: pa.RecordBatch) -> pa.RecordBatch:
    z = pa.array([_shrink(x) for x in b.column("payload").to_pylist()], pa.binary())
    return pa.RecordBatch.from_arrays([z if n == "payload" else b.column(n) for n in b.schema.names], names=b.schema.names)


def _unpacked(b: pa.RecordBatch) -> pa.RecordBatch:
    """Blocks of primary records, which are compressed while they are shuffled."""
    z = pa.array([None if x is None else _grow(x) for x in b.column("block").to_pylist()], pa.binary())
    return pa.RecordBatch.from_arrays([z if n == "block" else b.column(n) for n in b.schema.names], names=b.schema.names)


def _members(raw: memoryview) -> Iterator[bytes]:
    """The records of an archive, compressed or not."""
    if bytes(raw[:2]) != b"\x1f\x8b":
        yield from _records(bytes(raw))
        return
    at = 0
    while at < raw.nbytes:
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= raw.nbytes:
                raise ValueError("the archive ends within a record")
            parts.append(d.decompress(raw[at : at + _STEP]))
            at += min(_STEP, raw.nbytes - at)
        at -= len(d.unused_data)
        yield from _records(b"".join(parts))


def _records(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        m = re.search(rb"\r\ncontent-length:\s*(\d+)", data[at:head], re.I)
        if head < 0 or not m or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        end = head + 4 + int(m[1])
        yield data[at:end]
        at = end + 4 * data.startswith(b"\r\n\r\n", end)


def read_records(spark: SparkSession, path: str, types: tuple[str, ...] | None = None, blocks: str = "plain") -> DataFrame:
    """RECORD rows of all archives below path (*.warc, *.warc.gz and *.txt, which write_captures makes), file by file; types: only those records.
    Without an archive there it fails.

    blocks: plain, packed (by zstandard) or other (plain, and none for primary records). Header names are in lower case; payload-sha1, in hexadecimal, is added where the payload digest is a SHA-1, and http-header-bytes to
    primary records: where the payload begins in the block, 0 without a blank line. A record without an id goes by its file and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found, held = [], 0
                for place, record in enumerate(_members(memoryview(content.as_buffer()))):
                    if types is not None and (not (m := _KIND.search(record)) or m[1].strip().decode() not in types):
                        continue
                    head, _, block = record.partition(b"\r\n\r\n")
                    fields = [(k.strip().lower(), v.strip()) for k, _, v in map(_COLON, head.decode("utf-8", "replace").split("\r\n")[1:])]
                    headers = dict(fields)
                    kind = headers.get("warc-type", "")
                    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
                    if algorithm.lower() == "sha1" and len(digest) == 32:
                        headers["payload-sha1"] = base64.b32decode(digest.upper()).hex()
                    if kind in PRIMARY:  # looked for in the whole block, here where that is cheap
                        headers["http-header-bytes"] = str(end + 4 if (end := block.find(b"\r\n\r\n")) >= 0 else 0)
                    found.append((file, place, kind, headers.get("warc-record-id") or f"<{file}#{place}>", [v for k, v in fields if k == "warc-concurrent-to"], list(headers.items()), _shrink(block) if blocks == "packed" else block if blocks == "plain" or kind not in PRIMARY else None))
                    held += len(block)
                    if held > 4 << 20 or len(found) >= 2000:
                        yield _batch(found)
                        found, held = [], 0
                if found:
                    yield _batch(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc,warc.gz}").load(path)
    if not files.inputFiles():
        raise FileNotFoundError(f"no WARC archive below {path}")
    return files.select("path", "content").mapInArrow(run, RECORD)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    file, place, kind, record_id, to, headers, block = zip(*found, strict=True)
    edges = pa.array(np.cumsum([0, *map(len, headers)]), pa.int32())
    flat = [kv for h in headers for kv in h]
    maps = pa.MapArray.from_arrays(edges, pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string()))
    arrays = [pa.array(file, pa.string()), pa.array(place, pa.int64()), pa.array(kind, pa.string()), pa.array(record_id, pa.string()), pa.array(to, pa.list_(pa.string())), maps, pa.array(block, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in RECORD.split(", ")])


def capture_ids(narrow: DataFrame) -> DataFrame:
    """record_id -> capture_id of all records but the primary ones, from (warc_type, record_id, concurrent_to).

    Links count both ways and over several steps: a record that names another one's request is of the same capture. Where more than
    one primary record can be reached in the fewest steps, that with the smallest id is taken. A record from which
    none can be reached goes by the smallest id that it names, or else its own."""
    links = narrow.select("record_id", F.explode("concurrent_to").alias("to"))
    links = stored(links.union(links.select("to", "record_id")).where("record_id <> to").distinct(), "warc-links")
    known = narrow.where(F.col("warc_type").isin(*PRIMARY)).select("record_id", F.col("record_id").alias("capture_id"))
    rest = stored(narrow.where(~F.col("warc_type").isin(*PRIMARY)).select("record_id", F.coalesce(F.array_min("concurrent_to"), "record_id").alias("lone")).distinct(), "warc-rest")
    edge, done = known, None
    while True:
        reached = links.join(edge, "record_id").groupBy(F.col("to").alias("record_id")).agg(F.min("capture_id").alias("capture_id")).join(rest.select("record_id"), "record_id", "left_semi")
        edge = stored(reached if done is None else reached.join(done, "record_id", "left_anti"), "warc-reached")
        if edge.isEmpty():
            break
        done = edge if done is None else done.union(edge)
        if done.count() >= rest.count():
            break
    if done is None:
        return rest.select("record_id", F.col("lone").alias("capture_id"))
    return rest.join(done, "record_id", "left").select("record_id", F.coalesce("capture_id", "lone").alias("capture_id"))


def assemble(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per capture: capture_id; record (the response, revisit or resource record, null if there is none);
    requests and metadata (arrays, ordered by record_id, empty if there are none).

    Requests, metadata and responses are joined by capture, which follows from the concurrent-to identifiers. Only
    the primary records, unique by id, are shuffled with their blocks, once and compressed."""
    others = stored(read_records(spark, path, blocks="other").where(F.col("record_id").isNotNull()), "warc-others")
    resolved = capture_ids(others.select("warc_type", "record_id", "concurrent_to"))
    rows = read_records(spark, path, PRIMARY, "packed").select(F.col("record_id").alias("capture_id"), "warc_type", "headers", "block")
    others = others.where(F.col("warc_type").isin("request", "metadata")).select("warc_type", "record_id", F.struct("record_id", "headers", "block").alias("r")).join(resolved, "record_id")
    # collect_list leaves out the nulls that when() makes of the other kind
    lists = [F.array_sort(F.collect_list(F.when(F.col("warc_type") == kind, F.col("r"))), _by_id).alias(name) for kind, name in (("request", "requests"), ("metadata", "metadata"))]
    joined = rows.join(others.groupBy("capture_id").agg(*lists), "capture_id", "full_outer")
    whole = joined.mapInArrow(by_batch(_unpacked), joined.schema)
    empty = F.array().cast("array<struct<record_id:string,headers:map<string,string>,block:binary>>")
    record = F.when(F.col("warc_type").isNotNull(), F.struct("warc_type", F.col("capture_id").alias("record_id"), "headers", "block"))
    return whole.select("capture_id", record.alias("record"), *[F.coalesce(n, empty).alias(n) for n in ("requests", "metadata")])


def _by_id(a: Column, b: Column) -> Column:
    return F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)


def http_header_bytes(headers: Column) -> Column:
    """How many bytes the HTTP header of a primary record's block has, its blank line included."""
    return F.coalesce(headers["http-header-bytes"].cast("int"), F.lit(0))


def http_body(record: Column) -> Column:
    """What follows the HTTP header in a record's block."""
    return F.substring(record["block"], http_header_bytes(record["headers"]) + 1, F.octet_length(record["block"]))


def field(block: Column, name: str) -> Column:
    """A field of an application/warc-fields block or of an HTTP header; null if it isn't there."""
    found = F.regexp_extract(F.decode(block, "ISO-8859-1"), rf"(?mi)^{re.escape(name)}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)

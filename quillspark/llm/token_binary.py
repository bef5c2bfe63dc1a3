"""Token ids in binary shards: one zstandard frame per document, one dictionary for all, an index for short-document access.

A shard, in this order: MAGIC; the width of an id in bytes (1 byte); the SHA-256 of the dictionary (32 bytes); the
frames; the index, one INDEX record per document in the order of the frames; TRAILER; END. Shards are written by
Spark's own writer, so they are committed once, on any file system that Spark knows, also if a task is lost or run twice.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import small_batches, stored
from quillspark.llm.tokens import word_ids

MAGIC, END = b"QTOKZ1\n", b"QTOKEND\n"
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u8")])
TRAILER = struct.Struct("<QQQ")  # place of the index, documents, ids
HEAD = len(MAGIC) + 1 + 32


@lru_cache(maxsize=4)
def _codecs(dictionary: bytes):
    import zstandard as zstd

    d = zstd.ZstdCompressionDict(dictionary) if dictionary else None
    return zstd.ZstdCompressor(level=1, dict_data=d, write_content_size=True), zstd.ZstdDecompressor(dict_data=d)


def train_dictionary(docs: DataFrame, tokenizer_path: str, width: int, sample_docs: int = 800, sample_chars: int = 16384, dict_bytes: int = 65536) -> bytes:
    """A dictionary from the serialized ids of at most sample_docs texts, chosen by hash; of a text longer than sample_chars, a part from a place chosen by hash.

    The bound only decides how well the frames compress. Few ids give a smaller dictionary, a twentieth of them at most;
    where the trainer refuses even that (some ten short texts), the ids themselves serve, and with none there is no dictionary."""
    import zstandard as zstd

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_narrow(x, width) for x in words.encode_many(b.column(0))], pa.binary())], names=["ids"])

    fits = docs.where(F.octet_length("text") > 0)
    share = min(1.0, 3 * sample_docs / max(1, docs.count()))  # some more than wanted, so that little is sorted
    few = fits.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    spare = F.greatest(F.length("text") - sample_chars, F.lit(0))
    part = F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(1), "doc_id"), spare.cast("long") + 1) + 1).cast("int"), F.lit(sample_chars))
    few = few.select("doc_id", part.alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs)
    samples = sorted(bytes(r[0]) for r in few.select("text").mapInArrow(run, "ids binary").collect())
    size = min(dict_bytes, sum(map(len, samples)) // 20)
    while size >= 256:
        try:
            return zstd.train_dictionary(size, samples).as_bytes()
        except zstd.ZstdError:
            size //= 2
    return b"".join(samples)[-dict_bytes:]


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() if width < 4 else ids


class Shard:
    def __init__(self, dictionary: bytes, width: int):
        self.coder, self.width = _codecs(dictionary)[0], width
        self.parts, self.at, self.index, self.ids = [MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest()], HEAD, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.coder.compress(_narrow(ids, self.width))
        self.index.append((doc_id or 0, doc_id is not None, self.at, len(frame), len(ids) // 4))
        self.parts.append(frame)
        self.at += len(frame)
        self.ids += len(ids) // 4

    def blob(self) -> bytes:
        """The file without its last byte, the line feed that Spark's text writer puts after a row."""
        return b"".join([*self.parts, np.array(self.index, INDEX).tobytes(), TRAILER.pack(self.at, len(self.index), self.ids), END[:-1]])


def read_index(blob: bytes | memoryview, dictionary: bytes) -> tuple[int, np.ndarray]:
    if bytes(blob[: len(MAGIC)]) != MAGIC or bytes(blob[-len(END) :]) != END:
        raise ValueError("not a whole shard of token ids")
    if bytes(blob[len(MAGIC) + 1 : HEAD]) != hashlib.sha256(dictionary).digest():
        raise ValueError("the shard was written with another dictionary")
    place, n, _ = TRAILER.unpack(blob[-len(END) - TRAILER.size : -len(END)])
    return blob[len(MAGIC)], np.frombuffer(blob, INDEX, count=n, offset=place)


def read_documents(blob: bytes | memoryview, entries: np.ndarray, width: int, dictionary: bytes) -> bytes:
    """Some documents' ids, one after the other, as little-endian unsigned 32-bit integers; only their own frames are decompressed."""
    grow = _codecs(dictionary)[1].decompress
    raw = b"".join([grow(blob[at : at + size]) for at, size in zip(entries["offset"].tolist(), entries["size"].tolist(), strict=True)])
    return np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes() if width < 4 else raw


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, width: int = 2, shard_bytes: int = 8 << 20) -> bytes:
    """Encodes every text, appends end_id and writes shards below path in ascending order of doc_id; returns the dictionary.

    docs: doc_id long, text string; other columns are not looked at. Null texts count as empty; rows with equal doc_id
    follow each other by a hash of their texts, null ids come first; an empty table gives a folder without shards. The raw texts are
    range-partitioned once (a hot source plays no part), and each partition is encoded and written in order. width: bytes of an id on
    disk, 2 for a vocabulary of up to 65,536 ids, else 4; ids that don't fit are refused."""
    spark = docs.sparkSession
    small_batches(spark)
    largest = max(end_id, max(word_ids(tokenizer_path).tokenizer.get_vocab().values()))
    if largest >= 1 << 8 * width:
        raise ValueError(f"ids of up to {largest} don't fit into {width} bytes")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dictionary = train_dictionary(narrow, tokenizer_path, width)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer_path), np.uint32(end_id).tobytes()
        shard = Shard(dictionary, width)
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), words.encode_many(b.column(1)), strict=True):
                shard.add(doc_id, ids + end)
                if shard.at >= shard_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([shard.blob()], pa.binary())], names=["blob"])
                    shard = Shard(dictionary, width)
        if shard.index:
            yield pa.RecordBatch.from_arrays([pa.array([shard.blob()], pa.binary())], names=["blob"])

    shards = narrow.orderBy("doc_id", F.xxhash64("text")).mapInArrow(run, "blob binary")
    shards.select(F.col("blob").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(f"{path}/shards")
    return dictionary


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a folder of shards: shard, place (of the document in its shard), doc_id, n_tokens, start, ids.

    start counts the ids of all documents before it, over all shards. The ids are decompressed twice, first for the counts alone."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").head()["dictionary"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    number = F.format_string("%s.%s", F.lpad(F.regexp_extract("path", r"part-(\d+)", 1), 12, "0"), F.lpad(F.regexp_extract("path", r"-c(\d+)\.", 1), 12, "0"))
    files = files.select(number.alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                blob = memoryview(content.as_buffer())
                width, index = read_index(blob, dictionary)
                before = np.cumsum(index["n_tokens"]) - index["n_tokens"]
                for lo in range(0, len(index), 1000):
                    part = index[lo : lo + 1000]
                    n = part["n_tokens"].astype(np.int64)
                    ends = pa.py_buffer(np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32))
                    ids = pa.Array.from_buffers(pa.binary(), len(part), [None, ends, pa.py_buffer(read_documents(blob, part, width, dictionary))])
                    doc_ids = pa.array(part["doc_id"].astype(np.int64), mask=part["known"] == 0)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part)), pa.array(np.arange(lo, lo + len(part))), doc_ids, pa.array(n), pa.array(before[lo : lo + 1000].astype(np.int64)), ids], names=["shard", "place", "doc_id", "n_tokens", "before", "ids"])

    return files.mapInArrow(run, "shard string, place long, doc_id long, n_tokens long, before long, ids binary")


def with_starts(read: DataFrame) -> DataFrame:
    """read_tokens() rows (with any derived columns) with `start`, the ids of all documents before each.

    One row per shard is gathered to sum up the shards before it; a shard holds thousands of documents."""
    per_shard = read.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    bases = per_shard.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_base"))
    return read.join(bases, "shard").withColumn("start", F.col("_base") + F.col("before")).drop("_base")


def token_digests(docs: DataFrame, path: str, tokenizer_path: str) -> DataFrame:
    """The contract's view of the files: doc_id, start, n_tokens, ids_crc32, and the shard that holds the document."""
    write_tokens(docs, path, tokenizer_path)
    read = read_tokens(docs.sparkSession, path)
    slim = stored(read.select("shard", "place", "doc_id", "n_tokens", "before", F.crc32("ids").alias("ids_crc32")), "token-index")
    return with_starts(slim).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "place")

"""Token counts through a digest cache: a text that was counted before, by the same tokenizer version, isn't encoded again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches, stored, texts_of

CACHE = "content_digest binary, n_tokens long, tokenizer_digest string"
#: Words of 64 bits in the filter that keeps texts which aren't needed out of the shuffle: 8 MB, whatever the table.
WORDS = 1 << 20


@lru_cache(maxsize=4)
def _counter(path: str):
    """Counts the ids of texts with the library that the file is for, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: list(map(len, model.encode(texts, num_threads=1)))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _part(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/tokenizer_digest={version}"


def empty_cache(spark: SparkSession, path: str, version: str) -> None:
    spark.createDataFrame([], "content_digest binary, n_tokens long").write.mode("ignore").parquet(_part(path, version))


def _likely(keyed: DataFrame, misses: DataFrame) -> DataFrame:
    """The rows of keyed that are in misses (content_digest, _id), and a few others: a row stays if its bit is set, one of WORDS * 64 that each miss sets one of."""
    place = lambda id_col: F.xxhash64("content_digest", id_col)
    word, bit = (lambda h: h.bitwiseAND(F.lit(WORDS - 1)).cast("int")), (lambda h: F.shiftrightunsigned(h, 58).cast("int"))
    bits = misses.select(word(place("_id")).alias("_word"), bit(place("_id")).alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    rows = keyed.withColumns({"_word": word(place("doc_id")), "_bit": bit(place("doc_id"))})
    return rows.join(F.broadcast(bits), "_word").where(F.getbit("_bits", F.col("_bit")) == 1).select(*keyed.columns)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and content_digest of every row, encoding each distinct text that the cache lacks once.

    Content is normalised only by taking null as empty: anything more could change a count. Digests of the content
    (SHA-256) and of the tokenizer's file are the key of the cache, a Parquet folder of CACHE rows in a folder for each tokenizer; its
    misses are encoded and appended by Spark's committed writer before this returns. An append that runs twice adds equal rows, which
    count as one. Digests are made distinct before they are joined with the cache, and texts are shuffled once, only those that a filter of
    fixed size takes for the one chosen row of a miss: what the cache has stays where it lies, and so do other copies of a text. The counts go back by an equi-join that AQE splits
    where a digest is hot. Null and repeated ids stay; other columns are not looked at."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    small_batches(spark)
    empty_cache(spark, cache_path, version)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    known = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer_digest") == version)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("content_digest"), pa.array(count(texts_of(b)), pa.int64())], names=["content_digest", "n_tokens"])

    # digests alone are compared with the cache; then one row of each miss has its text fetched
    digests = keyed.groupBy("content_digest").agg(F.min("doc_id").alias("_id"))
    misses = stored(digests.join(known.select("content_digest"), "content_digest", "left_anti"), "token-misses")
    likely = _likely(keyed, misses)
    # a row that passes the filter wrongly has the text of another miss or one that the cache has; copies go before the shuffle and after it
    distinct = likely.select("content_digest", "text").dropDuplicates(["content_digest"]).join(misses.select("content_digest"), "content_digest", "left_semi")
    counted = distinct.mapInArrow(run, "content_digest binary, n_tokens long")
    counted.select("content_digest", "n_tokens").write.mode("append").parquet(_part(cache_path, version))

    now = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens").distinct()
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest")
    return rows.join(now, "content_digest").select("doc_id", "n_bytes", "n_tokens", F.lower(F.hex("content_digest")).alias("content_digest"))

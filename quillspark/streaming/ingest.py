"""Documents that keep coming: chunked and added to a stored index, each as it is now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import text as T
from quillspark.operators import bm25
from quillspark.operators.chunking import ChunkConfig, chunk_documents, with_metadata
from quillspark.operators.postings import Segments
from quillspark.shared import exists, stored


def add_batch(docs: DataFrame, index_path: str, config: ChunkConfig = ChunkConfig(), segment: T.Segment | None = None, delivery: str | None = None) -> Segments:
    """docs (doc_id, page_content) as they are now are one segment of the index below index_path, and their chunks one of its `texts`.

    Chunks that a document had before and has no more leave the index; those that stay as they were are left alone. A document that comes twice in a batch counts once, as
    either. delivery: the batch's name; one that the index has by that name adds nothing."""
    spark, index = docs.sparkSession, Segments(docs.sparkSession, index_path)
    if delivery is not None and delivery in index.deliveries():
        return index
    docs = docs.dropDuplicates(["doc_id"])
    chunks = stored(with_metadata(chunk_documents(docs, config), segment).dropDuplicates(["chunk_id"]), "chunks")
    number = max(index.numbers(), default=-1) + 1
    chunks.write.mode("overwrite").parquet(f"{index_path}/texts/segment={number}")
    index.add(chunks, number, removed=docs.select("doc_id"), segment=segment, delivery=delivery)
    return index


def stream(spark: SparkSession, source: str, schema: str, index_path: str, checkpoint: str, segment: T.Segment | None = None) -> StreamingQuery:
    """Takes in all files of a folder that aren't taken in yet, and stops. A batch that is run again is known by the checkpoint's name and its number."""
    docs = spark.readStream.schema(schema).parquet(source)
    add = lambda df, n: add_batch(df, index_path, segment=segment, delivery=f"{checkpoint}#{n}")
    return docs.writeStream.foreachBatch(lambda df, n: add(df, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, index_path: str) -> bm25.Index:
    """The live postings below a path."""
    return Segments(spark, index_path).as_index()


def read_chunks(spark: SparkSession, index_path: str) -> DataFrame | None:
    """The live chunks with their texts and metadata; None where there are none."""
    live = Segments(spark, index_path).live()
    if live is None or not exists(spark, f"{index_path}/texts"):
        return None
    return spark.read.parquet(f"{index_path}/texts").join(live.select("chunk_id", "segment"), ["chunk_id", "segment"], "left_semi").drop("segment")

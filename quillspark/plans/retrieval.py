"""Whole plans: taking documents in, searching collections, building chat prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import prompts as P
from quillspark.operators import bm25, hybrid, postings, vectors
from quillspark.operators.catalog import Collections
from quillspark.operators.chunking import ChunkConfig, chunk_documents, with_metadata
from quillspark.shared import small, stored
from quillspark.sources import files


def ingest(docs: DataFrame, collection: str, embedder: vectors.Embedder, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """docs (doc_id, page_content) as embedded chunks of a collection, in one lazy plan."""
    rows = vectors.embed(with_metadata(chunk_documents(docs, config)), embedder)
    return rows.withColumns({"collection": F.lit(collection), "embedding_model": F.lit(type(embedder).__name__), "embedding_dimension": F.lit(embedder.dimension)})


def search(chunks: DataFrame, queries: DataFrame, k: int = 10, weights: dict[str, float] | None = None, word_weight: float = 0.3, vector_weight: float = 0.7, threshold: float | None = 0.3, vector_threshold: float | None = vectors.DEFAULT_THRESHOLD, where: dict[str, object] | None = None, index: bm25.Index | postings.Segments | None = None) -> DataFrame:
    """Fused results over the collections of chunks (collection, chunk_id, page_content, embedding) for queries (query_id, query_text, query_embedding).

    All collections are searched in one plan; word statistics, candidates and ranks are each collection's own. Filters hold for both searches;
    for words they come after the collection's statistics. Chunks without an embedding are found by words alone. index: one by collection; of a stored one (postings.Segments) only the blocks that count are read."""
    cond, many, by = bm25.equals(where), hybrid.candidates(k), ("collection",)
    allowed = None if cond is None else chunks.where(cond)
    if isinstance(index, postings.Segments):
        words = index.normalised_top_k(queries, many, keep=allowed)
    else:
        words = bm25.top_k(bm25.normalised(index or bm25.build(chunks, by=by), queries), many, keep=allowed, by=by)
    near = vectors.search(chunks if allowed is None else allowed, queries, many, vector_threshold, by=by)
    fused = hybrid.fuse(words, near, word_weight, vector_weight, threshold, k, by=("query_id", *by))
    return hybrid.over_collections(fused, weights, threshold, k)


def with_content(results: DataFrame, chunks: DataFrame, metadata: list[str] | None = None) -> DataFrame:
    """search()'s rows as they are handed out: query_id, rank, content, metadata (a map of chunks' other columns), score and collection_name."""
    hidden = {"collection", "chunk_id", "page_content", "embedding", "bm25_tokens", "language_info"}
    names = [c for c in chunks.columns if c not in hidden] if metadata is None else metadata
    pairs = [x for c in names for x in (F.lit(c), F.col(c).cast("string"))]
    about = chunks.select(F.col("collection").alias("_c"), F.col("chunk_id").alias("_i"), F.col("page_content").alias("content"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"))
    results = small(results)  # some rows a query: texts don't go through a shuffle for them
    asked = results.select(F.col("collection").alias("_c"), F.col("chunk_id").alias("_i")).distinct()
    about = about.join(asked, ["_c", "_i"], "left_semi")
    rows = results.join(about, (F.col("collection") == F.col("_c")) & (F.col("chunk_id") == F.col("_i")), "left")
    return rows.select("query_id", "rank", "chunk_id", "content", "metadata", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("collection", F.lit("unknown")).alias("collection_name"))


def chat_prompts(questions: DataFrame, results: DataFrame, messages: DataFrame, template: str | None = None, examples: dict[str, str] | None = None) -> DataFrame:
    """conv_id and prompt for questions (conv_id, query, language): the best three results as context, and what was said before.

    results: conv_id, rank, page_content; messages: conv_id, turn, role, text, the newest being the question. template: its variables are
    filled in, then those of examples (a template's example values); else the default prompt is taken."""
    from quillspark.functions import constants as K

    rows = questions.join(P.context_lines(results, "conv_id"), "conv_id", "left")
    rows = rows.join(P.history(messages, 6, K.HISTORY_ROLES), "conv_id", "left")
    context, past = F.coalesce("context", F.lit("")), F.coalesce("history", F.lit(""))
    if not template:
        system = P.default_prompt(F.col("query"), context, F.col("language"))
    else:
        rows = rows.join(P.history(messages, 4, K.TEMPLATE_ROLES).withColumnRenamed("history", "short"), "conv_id", "left")
        values = {"context": context, "query": F.col("query"), "language": F.col("language"), "user_id": F.col("conv_id").cast("string"), "chat_history": F.coalesce("short", F.lit(""))}
        system = P.substitute(F.lit(template), {**values, **{k: F.lit(v) for k, v in (examples or {}).items()}})
    return rows.select("conv_id", P.chat_prompt(P.with_clean_output(system, F.col("language")), past, F.col("query"), F.col("language")).alias("prompt"))


def process_files(spark: SparkSession, paths: str | list[str], collections: Collections, collection: str, embedder: vectors.Embedder, chunk_size: int = 512, chunk_overlap: int = 64, extractors: dict[str, files.Extractor] | None = None, extra: dict[str, object] | None = None) -> DataFrame:
    """Files to chunks in a collection in one call: loaded, cleaned, chunked, embedded and put there by id. Their chunk_ids."""
    docs = files.documents(files.load(spark, paths, extractors), extra)
    kept = [c for c in ("source_file", "file_extension", "language", "content_type", "processing_timestamp", *(extra or {})) if c in docs.columns]
    kept = list(dict.fromkeys(kept))
    docs = stored(docs.withColumn("doc_id", F.concat_ws("#", "path", F.col("part").cast("string"))), "documents")  # each file is parsed once
    chunks = ingest(docs, collection, embedder, ChunkConfig(chunk_size=chunk_size, chunk_overlap=chunk_overlap)).drop("collection")
    rows = chunks.join(docs.select("doc_id", *kept), "doc_id")
    collections.create(collection)
    return collections.put(collection, rows)


def check_index(index: bm25.Index | postings.Segments | None, collections: list[str] | None = None) -> tuple[bool, str]:
    """Whether a search can start, and why not."""
    if index is None:
        return False, "there is no index"
    if isinstance(index, postings.Segments) and not index.numbers():
        return False, "the index is empty"
    if not isinstance(index, bm25.Index | postings.Segments):
        return False, f"not an index: {type(index).__name__}"
    if index.by and not collections:
        return False, "no collection is named"
    return True, ""


def describe_index(index: object) -> dict[str, object]:
    """What kind of index it is: its type, whether it is stored, whether collections have statistics of their own, and whether there is anything in it to search."""
    stored_index = isinstance(index, postings.Segments)
    known = stored_index or isinstance(index, bm25.Index)
    return {"type": type(index).__name__, "is_stored": stored_index, "is_multi_collection": known and bool(index.by), "has_chunks": known and (bool(index.numbers()) if stored_index else not index.stats.isEmpty())}


def chunks_of(collections: Collections, name: str | None = None) -> DataFrame | None:
    """The chunks of a named collection, of the first one without a name; None where there is none."""
    known = collections.names()
    pick = name if name is not None else (known[0] if known else None)
    return collections.read(pick) if pick in known else None

"""The registered queries over the test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import constants as K
from quillspark.functions import llm_calls
from quillspark.functions import prompts as P
from quillspark.functions import segmentation
from quillspark.functions import text as T
from quillspark.operators import bm25, catalog, chunking, fields, hybrid, postings, results, runs, vectors
from quillspark.operators.vector_lists import Lists
from quillspark.plans import retrieval
from quillspark.shared import scratch
from quillspark.sources import files
from quillspark.streaming import history

LANGUAGES = ("de", "en", "es", "fr")  # of the test documents; only the SQL needs to know them
QUERY = "the and thon Heri ation"
QUERIES_TEXT = ((1, "the and thon Heri ation"), (2, "und das achberach"), (3, "la ciónes que"))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk of the collection named by its language."""
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("collection"), "source", F.col("text").alias("page_content"))


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES_TEXT, "query_id int, query_text string")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bm25.build(_chunks(spark, sf_dir))
    return _ranked(bm25.top_k(bm25.scores(index, _asked(spark)).withColumnRenamed("raw", "score"), 10))


_INDICES: dict[tuple[str, str, tuple[str, ...]], postings.Segments] = {}


def _stored_index(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> postings.Segments:
    """The stored index of all documents, two segments: made by the first search of an application, read by those after it."""
    key = (spark.sparkContext.applicationId, sf_dir, by)
    if key not in _INDICES:
        index = postings.Segments(spark, scratch(spark, "bm25"), by)
        docs = _chunks(spark, sf_dir).withColumn("doc_id", F.col("chunk_id"))
        index.add(docs.where("collection <> 'de'"))
        index.add(docs.where("collection = 'de'"))
        _INDICES[key] = index
    return _INDICES[key]


def bm25_stored_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, over the stored index: only blocks that can hold one of the best are read."""
    return _ranked(_stored_index(spark, sf_dir).top_k(_asked(spark), 10).withColumnRenamed("raw", "score"))


def bm25_stored_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk_filtered, over the stored index."""
    keep = _chunks(spark, sf_dir).where(bm25.equals({"source": ["src1", "src2", "src3"]}))
    return _ranked(_stored_index(spark, sf_dir).normalised_top_k(_asked(spark), 10, 0.2, keep))


def hybrid_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As hybrid_multi_collection, words by the stored index of all collections."""
    index = _stored_index(spark, sf_dir, ("collection",))
    rows = retrieval.search(_embedded(spark, sf_dir), _both_queries(spark, sf_dir), 10, {"de": 0.5}, threshold=0.05, vector_threshold=None, index=index)
    return rows.select("query_id", "rank", "collection", "chunk_id", F.round("score", 6).alias("score"))


def _maintained(spark: SparkSession, sf_dir: str) -> postings.Segments:
    """An index that went through old texts, their edits, and a removal: documents without a line's end had other texts first, French ones went."""
    docs = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("_half"), "lang", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    part = F.when(F.col("_half") == 0, F.left("text", half)).otherwise(F.substr("text", half + 1))
    chunks = docs.select("doc_id", (F.col("doc_id") * 2 + F.col("_half")).alias("chunk_id"), "lang", part.alias("page_content"))
    old = chunks.withColumn("page_content", F.when(F.col("doc_id") % 2 == 0, F.lower(F.reverse("page_content"))).otherwise(F.col("page_content")))
    index = postings.Segments(spark, scratch(spark, "bm25-kept"))
    index.add(old)
    index.add(chunks.where("not (doc_id % 10 = 0 and chunk_id % 2 = 1)"), removed=docs.limit(0).select("doc_id"))
    index.add(chunks.limit(0), removed=docs.where("lang = 'fr'").select("doc_id"))
    return index


def bm25_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited, shortened and removed documents in an index in segments: what is left of each chunk."""
    index = _maintained(spark, sf_dir).as_index()
    terms = index.postings.groupBy("chunk_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))
    return index.stats.join(terms, "chunk_id", "left").select("chunk_id", "dl", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def bm25_merged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index merged to one segment: how many terms have each document frequency, and their weights."""
    stats = _maintained(spark, sf_dir).merge(scratch(spark, "bm25-merged")).term_stats()
    return stats.groupBy("df").agg(F.count("*").alias("terms"), F.round(F.max("idf"), 6).alias("idf"))


def bm25_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm25.normalised(bm25.build(_chunks(spark, sf_dir)), _asked(spark))
    return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    rows = bm25.normalised(bm25.build(chunks), _asked(spark))
    return _ranked(bm25.top_k(rows, 10, threshold=0.2, keep=chunks.where(bm25.equals({"source": ["src1", "src2", "src3"]}))))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its document frequency and weight."""
    return bm25.term_stats(bm25.build(_chunks(spark, sf_dir))).select("term", "df", F.round("idf", 6).alias("idf"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three vectors ask."""
    return _t(spark, sf_dir, "embeddings").where("vec_id < 3").select((F.col("vec_id") + 1).cast("int").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_embedding"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _t(spark, sf_dir, "embeddings").where("vec_id = 0").head()["embedding"]
    found = vectors.search_one(_vectors(spark, sf_dir), list(query), 10, None)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


def vector_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _t(spark, sf_dir, "embeddings").where("vec_id = 0").head()["embedding"]
    found = vectors.search_one(_vectors(spark, sf_dir), list(query), 50, 0.1, where=bm25.equals({"label": [0, 1, 2, 3]}))
    return found.select("chunk_id", F.round("score", 6).alias("score"))


def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(vectors.search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 10, None))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = bm25.top_k(bm25.normalised(bm25.build(_chunks(spark, sf_dir)), _asked(spark)), 200)
    near = vectors.search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 200, None)
    rows = hybrid.fuse(words, near, threshold=0.1, top_k=20)
    return rows.select("query_id", "rank", "chunk_id", *[F.round(c, 6).alias(c) for c in ("bm25_score", "vector_score", "hybrid_score")])


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks, with the vector of their number where there is one."""
    return _chunks(spark, sf_dir).join(_vectors(spark, sf_dir).select("chunk_id", "embedding"), "chunk_id", "left")


def _both_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark).join(_vector_queries(spark, sf_dir), "query_id")


def hybrid_multi_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _found(spark, sf_dir)
    return rows.select("query_id", "rank", "collection", "chunk_id", F.round("score", 6).alias("score"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word search over the chunks as they lie: joined to their vectors, whole texts would go through a shuffle."""
    index = bm25.build(_chunks(spark, sf_dir), by=("collection",))
    return retrieval.search(_embedded(spark, sf_dir), _both_queries(spark, sf_dir), 10, {"de": 0.5}, threshold=0.05, vector_threshold=None, index=index)


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.with_content(_found(spark, sf_dir), _chunks(spark, sf_dir))
    return rows.select("query_id", "rank", F.md5("content").alias("content_md5"), F.col("metadata")["source"].alias("source"), F.round("score", 6).alias("score"), "collection_name")


def bm25_topk_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut before the threshold, and the last of ties first."""
    rows = bm25.normalised(bm25.build(_chunks(spark, sf_dir)), _asked(spark), constant_is_one=True)
    return _ranked(bm25.top_k(rows, 10, threshold=0.3, threshold_after=True, last_of_ties=True))


def bm25_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of one language, then of all: what was in stays once."""
    chunks = _chunks(spark, sf_dir)
    index = bm25.append(bm25.build(chunks.where("collection = 'de'")), chunks)
    terms = index.postings.groupBy("chunk_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))
    return index.stats.join(terms, "chunk_id", "left").select("chunk_id", "dl", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


def vi_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(T.vietnamese_score(F.col("text")), 9).alias("score"), T.has_vietnamese(F.col("text")).alias("marked"))


def doc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.document_language(F.col("text")).alias("language"))


def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.content_type(F.col("text")).alias("content_type"))


def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.with_document_metadata(_docs(spark, sf_dir).select("doc_id", "text"), "text")
    return rows.select("doc_id", "length", "words", "content_type", "language", "detected", F.round("score", 9).alias("score"))


def chunk_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = T.chunk_language(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", info["language"].alias("language"), F.round(info["vietnamese_ratio"], 6).alias("ratio"), F.round(info["confidence"], 6).alias("confidence"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


def structure_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", T.structure(F.col("text")).alias("s"))
    return rows.select("doc_id", *[f"s.{c}" for c in ("has_headings", "has_lists", "has_tables", "has_code", "paragraph_count", "structure_type")], F.col("s.language_info.language").alias("language"))


def text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.looks_like_table(t).alias("is_table"), T.mentions_image(t).alias("is_image"), T.looks_like_header(t).alias("is_header"), T.looks_like_list(t).alias("is_list"))


def heading_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.inline(T.headings(F.col("text"))))


def _pages_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.col("text").alias("page_content"))


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for paragraphs here: the test texts have no blank lines."""
    docs = _docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("page_content"))
    return chunking.chunk_semantic(docs, chunking.ChunkConfig(max_chunk_size=256)).select("doc_id", "chunk_index", "page_content")


def chunk_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(_pages_content(spark, sf_dir)).select("doc_id", "section", "section_level", F.length("content").alias("n"), F.md5("content").alias("md5"))


def chunk_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_simple(_pages_content(spark, sf_dir)).select("doc_id", "chunk_index", "page_content")


def chunk_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.with_metadata(chunking.chunk_documents(_pages_content(spark, sf_dir)))
    return rows.select("chunk_id", "doc_id", "chunk_index", "strategy", "token_count", F.size("bm25_tokens").alias("n_tokens"))


def chunk_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which strategy each text got; parts of long sections count as hierarchical."""
    rows = chunking.chunk_documents(_pages_content(spark, sf_dir))
    return rows.select("doc_id", F.regexp_replace("strategy", "_split$", "").alias("strategy"), "original_length").distinct()


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_document_index(_docs(spark, sf_dir).select("doc_id", "source")).select("doc_id", "document_index")


def tokenize_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.bm25_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(tokens).cast("long").alias("n"), F.md5(F.array_join(tokens, " ")).alias("md5"))


def tokenize_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.chunk_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("md5"))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("content"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's collection."""
    ext = F.when(F.col("doc_id") % 3 == 0, ".TXT").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".md")
    return _docs(spark, sf_dir).select(F.col("source").alias("collection"), ext.alias("file_extension"), F.col("n_chars").alias("size"))


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = catalog.collection_stats(_files(spark, sf_dir))
    return s.select("collection", "documents", "total_size", "size_mb", *[F.coalesce(F.col("file_types")[e], F.lit(0)).cast("long").alias(n) for e, n in ((".txt", "txt"), (".md", "md"))])


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads: names with all kinds of endings, some missing; sizes to beyond what is taken."""
    ends = F.array(*[F.lit(e) for e in ("txt", "PDF", "exe", "docx", "tar.gz", "md")])
    name = F.when(F.col("doc_id") % 11 > 0, F.concat(F.lit("f"), "doc_id", F.lit("."), F.get(ends, (F.col("doc_id") % 6).cast("int"))))
    return _docs(spark, sf_dir).select("doc_id", F.col("source").alias("collection"), name.alias("filename"), (F.col("n_chars") * 20000).alias("size"), F.when(F.col("doc_id") % 3 == 0, "text/plain").alias("content_type"), F.timestamp_seconds(F.col("doc_id") * 61).alias("uploaded_at"))


def upload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploads(spark, sf_dir).select("doc_id", files.upload_error().alias("error"))


def file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.file_info(_uploads(spark, sf_dir).where("filename is not null")).drop("upload_time")


def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploads(spark, sf_dir).select("doc_id", files.object_key().alias("object_key"))


def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_stats(_chunks(spark, sf_dir)).withColumn("avg_tokens_per_text", F.round("avg_tokens_per_text", 6))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of operations."""
    log = _t(spark, sf_dir, "events").select(F.when(F.col("value") > 50, "index").otherwise("search").alias("operation"), F.lit(3).cast("long").alias("n"), F.round("value", 2).cast("decimal(18,2)").alias("seconds"))
    return catalog.operation_stats(log).select("total_documents_indexed", "total_searches_performed", *[F.round(c, 4).alias(c) for c in ("total_indexing_time", "total_search_time", "avg_search_time_per_search", "avg_indexing_time_per_doc")])


def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.known(_t(spark, sf_dir, "labels").select((F.col("doc_id") * 3).alias("doc_id")), _docs(spark, sf_dir), "doc_id")


def dictionary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.format_string('{"metadata": {"version": "1"}, "a": ["x", "%s"], "b": ["%s", "x"], "c": "none"}', "source", "lang")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.dictionary_union(json), ",").alias("words"))


def kb_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    names = docs.select(F.col("source").alias("name")).distinct()
    meta = docs.groupBy(F.col("source").alias("name")).agg(F.concat(F.lit("about "), F.min("lang")).alias("description"), F.lit("2024-01-01").alias("created_at"), F.when(F.min("doc_id") % 2 == 0, "2024-02-02").alias("updated_at"))
    stats = docs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("total_size"), F.when(F.max("doc_id") % 2 == 0, "2024-03-03").alias("updated_at"))
    return catalog.catalog(names, meta, stats)


def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _docs(spark, sf_dir).select((F.col("doc_id") % 3).alias("documents"), (F.col("doc_id") % 7).alias("chunks"), (F.col("doc_id") % 7).alias("vectors"), (F.col("doc_id") % 10 == 0).alias("failed"))
    s = catalog.pipeline_stats(files)
    return s.select("files", "documents", "chunks", "vectors", *[F.round(c, 6).alias(c) for c in ("documents_per_file", "chunks_per_file", "vectors_per_file", "chunks_per_document", "success_rate")])


def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collection_info(_t(spark, sf_dir, "embeddings").withColumn("collection", F.concat(F.lit("label"), F.col("label").cast("string"))))


def delete_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _t(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return catalog.delete_rows(_docs(spark, sf_dir), bad, key="doc_id").select("doc_id", "source")


def delete_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.delete_rows(_docs(spark, sf_dir), conditions={"lang": "en", "source": ["src0", "src1"]}).select("doc_id", "lang", "source")


def missing_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all sources and languages, those that aren't the name of a source of English texts."""
    docs = _docs(spark, sf_dir)
    wanted = docs.select(F.col("source").alias("name")).union(docs.select("lang")).distinct()
    return catalog.missing(wanted, docs.where("lang = 'en'").select(F.col("source").alias("name")))


def paginate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(_t(spark, sf_dir, "benchmark"), ["item_id"], skip=10, limit=15).select("item_id", T.preview(F.col("text")).alias("preview"))


def chat_history_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.history(_t(spark, sf_dir, "conversations"), 6, K.HISTORY_ROLES)


def chat_history_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.history(_t(spark, sf_dir, "conversations"), 4, K.TEMPLATE_ROLES)


def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are dealt to the conversations as what was found, by doc_id; the best three are a prompt's context."""
    messages = _t(spark, sf_dir, "conversations")
    questions = messages.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query")).withColumn("language", F.when(F.col("conv_id") % 2 == 0, "vi").otherwise("en"))
    n = F.broadcast(messages.agg((F.max("conv_id") + 1).alias("n")))  # one row
    found = _docs(spark, sf_dir).crossJoin(n).select((F.col("doc_id") % F.col("n")).alias("conv_id"), (F.floor(F.col("doc_id") / F.col("n")) + 1).alias("rank"), F.col("text").alias("page_content"))
    return retrieval.chat_prompts(questions, found, messages)


def response_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _t(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("`"), F.substring("text", 1, 3), F.lit("`"))).otherwise(F.col("text"))
    return m.select("conv_id", "turn", T.guarded_response(said, F.when(F.col("conv_id") % 2 == 0, "vi").otherwise("en")).alias("answer"))


def patient_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit(" "), F.substring("c_name", 1, 2), F.when(F.col("c_custkey") % 3 == 0, "-").otherwise(""), (F.col("c_custkey") % 100).cast("string"), F.lit(" "))
    return _t(spark, sf_dir, "customer").select("c_custkey", T.valid_patient_id(F.when(F.col("c_custkey") % 7 > 0, made)).alias("valid"))


def template_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.when(F.col("doc_id") % 2 == 0, "{a} and {{b}} of {c}").otherwise("{a} {d}")
    return _docs(spark, sf_dir).select("doc_id", P.format_template(template, {"a": F.col("lang"), "c": F.col("source")}).alias("filled"))


def careplan_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    r = {"patientId": F.col("c_name"), "age": c % 100, "gender": F.lit("Nam"), "bmi": (c % 40).cast("int"), "diabetesType": F.lit("Type 1"), "insulinSchedule": F.lit(None).cast("string"), "treatmentMethod": F.lit("diet"), "complications": F.array(F.lit("x"), F.lit("y")), "pastDiseases": F.when(c % 2 == 0, F.array(F.col("c_name"))).otherwise(F.array().cast("array<string>")), "lifestyle": F.lit("calm")}
    return _t(spark, sf_dir, "customer").select("c_custkey", P.care_plan_prompt(r).alias("prompt"))


def measurement_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    r = {"measurementType": F.lit("Blood Glucose"), "value": c % 15, "time": F.lit("noon"), "context": F.when(c % 2 == 0, "after a meal"), "note": F.when(c % 3 == 0, F.col("c_name")).otherwise("")}
    return _t(spark, sf_dir, "customer").select("c_custkey", P.measurement_prompt(r).alias("prompt"))


def clean_llm_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit('<p>"'), F.col("text"), F.lit('\\n</p> `x` ```code```\\t \\"end\\"'))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_response(said).alias("cleaned"))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a plan of two rows, right or wrong, or without one."""
    c = F.col("c_custkey")
    first = F.format_string('{"recordType":"%s","period":"%s","subtype":"%s","reason":"r%d"}', F.when(c % 5 == 0, "Weight").otherwise("BloodGlucose"), F.when(c % 7 == 0, "midnight").otherwise("noon"), F.when(c % 11 == 0, "sitting").otherwise("fasting"), c)
    second = F.when(c % 13 == 0, '{"recordType":"BloodPressure","period":"morning","subtype":null,"reason":""}').otherwise('{"recordType":"BloodPressure","period":"morning","subtype":null,"reason":" b "}')
    return _t(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 4 == 0, "none").otherwise(F.concat(F.lit("Here: ["), first, F.lit(", "), second, F.lit(" ] done"))).alias("response"))


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).select("id", T.json_array(F.col("response")).alias("found"))


def extract_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return llm_calls.care_plan_rows(_plans(spark, sf_dir)).select("id", "item", "recordType", "period", "subtype", "reason", "error")


def careplan_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return llm_calls.care_plan_lists(_plans(spark, sf_dir)).select("id", F.size("plan").alias("rows"), "error").withColumn("rows", F.when(F.col("error").isNull(), F.col("rows")))


def careplan_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 150).alias("age"), (F.col("c_custkey") % 60).cast("double").alias("bmi"))
    r = {"age": F.col("age"), "bmi": F.col("bmi"), "gender": F.when(F.col("c_custkey") % 4 == 0, "X").otherwise("Nữ"), "diabetesType": F.when(F.col("c_custkey") % 5 == 0, "type 9").otherwise("Type 2")}
    return customers.select("c_custkey", P.care_plan_error(r).alias("error"))


def prompt_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.concat(F.lit("{{ query }} in {{"), F.col("lang"), F.lit("}} by {{query}} and {{source}}"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.template_variables(template), ",").alias("variables"), P.substitute(template, {"source": F.col("source"), "query": F.lit("Q")}).alias("filled"))


def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.sanitize(F.col("text"), 200).alias("sanitized"))


def embed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.embedding_input(F.col("text"))).alias("md5"), T.count_words(F.col("text")).alias("tokens"))


def hash_embed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedder = vectors.HashEmbedder(64)
    rows = vectors.embed(_chunks(spark, sf_dir), embedder)
    found = vectors.search_one(rows, embedder.encode(["query: " + QUERY])[0], 10, None)
    return found.select("chunk_id", F.round("score", 4).alias("score"))


def vector_lists_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As vector_batch_topk, over stored lists of vectors."""
    lists = Lists.build(_vectors(spark, sf_dir), scratch(spark, "lists"))
    return _ranked(lists.search(_vector_queries(spark, sf_dir), 10))


def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a collection of chunks; every third one is put again, some new ones come, the badly rated and then one source's English ones go."""
    c = catalog.Collections(spark, scratch(spark, "collections"))
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"), F.col("lang").alias("file_extension"), "n_chars", F.md5("text").alias("digest"))
    c.put("kb", rows.where("chunk_id % 5 > 0"))
    c.put("kb", rows.where("chunk_id % 3 = 0").withColumns({"n_chars": -F.col("n_chars"), "note": F.lit("again")}))
    c.delete("kb", _t(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("chunk_id")))
    c.delete("kb", conditions={"source_file": "src1", "file_extension": "en"})
    return c.read("kb").select("chunk_id", "source_file", "file_extension", "n_chars", "digest", "note", "collection")


def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and id, twenty after a row of the second language."""
    docs = _docs(spark, sf_dir).select("lang", "doc_id", "source")
    first = catalog.page_after(docs, ["lang", "doc_id"], ["de", 0], 20).collect()
    return catalog.page_after(docs, ["lang", "doc_id"], [first[-1]["lang"], first[-1]["doc_id"]], 20)


def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their text, language and source at once."""
    rows = _docs(spark, sf_dir).select("doc_id", "lang", "source", "text")
    asked = spark.createDataFrame([(1, "de und src3 the"), (2, "es la que")], "query_id int, query_text string")
    found = fields.search(rows, asked, {"text": 1.0, "lang": 2.0, "source": 0.5}, 10, id_col="doc_id")
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat history as keyed state over the stream of all messages; of each conversation the newest."""
    path, source = scratch(spark, "history"), _t(spark, sf_dir, "conversations")
    source.repartition(6).write.parquet(f"{path}/in")  # turns are dealt at random, so they come out of order
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    told = history.histories(stream, expires_ms=None)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/told/batch={n}")
    told.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/told").groupBy("conv_id").agg(F.max_by("history", F.struct("newest", "batch")).alias("history"))
    return last.where("history is not null")


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their vectors are written, and what is told of them is observed by the same job; a first run is reset."""
    rows, log = _embedded(spark, sf_dir), runs.Runs(spark, scratch(spark, "runs"))
    log.write(rows.limit(0), scratch(spark, "ingested"))
    log.reset()
    log.write(rows, scratch(spark, "ingested"))
    return log.metrics().select("operation", "metric", F.col("total").cast("long").alias("total"))


def embed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are embedded in two deliveries over one table of results: how many inputs, and how many were encoded."""
    at, docs = scratch(spark, "results"), _chunks(spark, sf_dir)
    e = vectors.HashEmbedder(16)
    results.embed(docs.where("collection = 'de'"), e, at, "hash").write.format("noop").mode("overwrite").save()
    rows = results.embed(docs, e, at, "hash")
    held = spark.read.parquet(f"{at}/model=hash").agg(F.count("*").alias("encoded"))
    asked = rows.agg(F.count("*").alias("rows"), F.count("embedding").alias("embedded"), F.countDistinct(T.embedding_input(F.col("page_content"))).alias("distinct_inputs"))
    return asked.crossJoin(held)  # one row each


def _content(chunks: DataFrame) -> DataFrame:
    """How many characters but blanks a document's chunks hold, and which: their sorted sequence. Parts of a long section have one index, so their order isn't told."""
    text = F.array_join(F.collect_list(F.regexp_replace("page_content", r"(?U)\s+", "")), "")
    held = chunks.groupBy("doc_id").agg(text.alias("t"))
    return held.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort(F.split("t", "")), "")).alias("md5"))


def word_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a segmenter learns from all documents: single syllables and pairs that keep together, with their costs."""
    return segmentation.cost_table(_docs(spark, sf_dir), longest=2).select("word", F.round("cost", 6).alias("cost"))


_NO_OVERLAP = chunking.ChunkConfig(chunk_overlap=0)


def chunk_simple_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without overlap nothing of a text is lost, doubled or moved."""
    return _content(chunking.chunk_simple(_pages_content(spark, sf_dir), _NO_OVERLAP))


def chunk_hierarchical_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(chunking.chunk_hierarchical(_pages_content(spark, sf_dir), _NO_OVERLAP))


def chunk_dispatch_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(chunking.chunk_documents(_pages_content(spark, sf_dir), _NO_OVERLAP))


def measurement_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as glucose values, by the range they lie in."""
    ranges = spark.createDataFrame(K.NORMAL_RANGES, "kind string, name string, lo double, hi double")
    rows = _t(spark, sf_dir, "events").join(F.broadcast(ranges), F.col("value").between(F.col("lo"), F.col("hi")))  # four ranges
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


_ALL = (
    bm25_topk, bm25_stored_topk, bm25_stored_filtered, hybrid_stored, bm25_maintained, bm25_merged_terms, bm25_minmax, bm25_topk_filtered, bm25_topk_alt, bm25_incremental, term_stats, vector_topk, vector_topk_threshold, vector_batch_topk,
    hybrid_search, hybrid_multi_collection, search_results, clean_text, vi_score, doc_language, content_type, doc_metadata, chunk_language,
    token_estimate, structure_type, text_checks, heading_extract, chunk_semantic, chunk_hierarchical, chunk_simple, chunk_dispatch, chunk_strategy,
    document_index, tokenize_bm25, tokenize_stopwords, html_to_text, collection_stats, upload_check, file_info, object_keys, embedding_stats,
    store_stats, known_ids, dictionary_union, kb_catalog, pipeline_stats, collection_info, delete_by_ids, delete_by_filter, missing_collections,
    paginate_templates, chat_history_prompt, chat_history_template, chat_prompt, response_guard, patient_ids, template_format, careplan_prompt,
    measurement_prompt, clean_llm_response, json_arrays, extract_json_rows, careplan_lists, careplan_validate, prompt_variables, sanitize_text,
    embed_inputs, hash_embed_topk, measurement_ranges, vector_lists_topk, collection_upsert, page_keyset, field_search, history_stream, ingest_stats,
    embed_once, word_costs, chunk_simple_content, chunk_hierarchical_content, chunk_dispatch_content,
)
QUERIES = {f.__name__: f for f in _ALL}


def _sql() -> dict[str, str]:
    """DuckDB SQL for the queries. Regular expressions there know no look-around and ASCII classes only."""
    vi = K.VI_LETTERS
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    text = lambda s: "'" + s.replace("'", "''") + "'"

    def index(where: str = "true") -> str:
        return rf"""
            c AS (SELECT doc_id AS chunk_id, {words} AS toks, lang, source FROM documents WHERE {where}),
            st AS (SELECT chunk_id, len(toks) AS dl FROM c),
            post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM c) GROUP BY 1, 2),
            nn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM st),
            dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
            raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, nn),
            ts AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws),
            asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}_]+')) AS term FROM (VALUES {", ".join(f"({i}, {text(q)})" for i, q in QUERIES_TEXT)}) v(query_id, q)) GROUP BY 1, 2),
            sc AS (SELECT query_id, post.chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS raw
                   FROM post JOIN asked USING (term) JOIN ts USING (term) JOIN st ON st.chunk_id = post.chunk_id, nn GROUP BY 1, 2),
            ends AS (SELECT query_id, CASE WHEN count(*) < (SELECT n FROM nn) THEN least(min(raw), 0) ELSE min(raw) END AS lo, CASE WHEN count(*) < (SELECT n FROM nn) THEN greatest(max(raw), 0) ELSE max(raw) END AS hi FROM sc GROUP BY 1),
            norm AS (SELECT query_id, chunk_id, CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE raw END AS score FROM sc JOIN ends USING (query_id))"""

    kept = rf"""
        kc AS (SELECT chunk_id, regexp_extract_all(lower(part), '[\p{{L}}\p{{N}}_]+') AS toks FROM (
            SELECT doc_id * 2 + h AS chunk_id, CASE WHEN h = 0 THEN left(text, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END AS part
            FROM documents, (VALUES (0), (1)) v(h) WHERE lang <> 'fr' AND NOT (doc_id % 10 = 0 AND h = 1)))"""
    ranked = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({0}, 9) DESC, chunk_id) AS INTEGER) AS rank"
    cos = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
    history = """
        SELECT conv_id, string_agg(CASE role {roles} END || ': ' || text, chr(10) ORDER BY turn) AS history
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
        WHERE n BETWEEN 2 AND {last} AND role IN ('user', 'assistant') GROUP BY conv_id"""
    past = history.format(last=6, roles="".join(f" WHEN '{k}' THEN '{v}'" for k, v in K.HISTORY_ROLES.items()))
    strip = r"regexp_replace({0}, '\A[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+\z', '', 'g')"
    blank = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    n_words = rf"len(regexp_extract_all(text, '[^{blank[1:-1]}]+'))"
    n_vi, n_letters = f"len(regexp_extract_all(text, '(?i)[{vi}]'))", f"len(regexp_extract_all(text, '[a-zA-Z{vi}]'))"
    ratio = f"CASE WHEN {n_letters} = 0 THEN 0.0 ELSE CAST({n_vi} AS DOUBLE) / {n_letters} END"
    chunk = f"SELECT doc_id, length(text) AS n, {n_letters} AS letters, {ratio} AS r FROM documents"
    lang = "CASE WHEN letters = 0 THEN 'unknown' WHEN r > 0.20 THEN 'vietnamese' WHEN r > 0.05 THEN 'mixed' ELSE 'english' END"
    toks = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}\p{Pc}]+')"
    vi_score = f"""(len(list_filter({toks}, lambda w: w IN ({quoted(K.VI_WORDS)}))) + CASE WHEN len({toks}) > 2 THEN 0.5 * len(list_filter({toks}, lambda w: w IN ({quoted([a for a in K.VI_ABBREVIATIONS if a not in K.VI_WORDS])}))) ELSE 0 END) / len({toks})"""
    score = f"CASE WHEN len({toks}) = 0 THEN 0.0 ELSE least(1.0, {vi_score} * 0.7 + CASE WHEN {n_letters} > 0 THEN CAST({n_vi} AS DOUBLE) / {n_letters} ELSE 0 END * 0.3) END"
    marked = f"regexp_matches(text, '(?i)[{vi}]')"
    markers = rf"len(regexp_extract_all(lower(text), '(?:^|[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}])({'|'.join(K.ENGLISH_MARKERS)})\b'))"
    fused = """SELECT coalesce(w.query_id, v.query_id) AS query_id, coalesce(w.chunk_id, v.chunk_id) AS chunk_id, coalesce(w.score, 0) AS bm25_score, coalesce(v.score, 0) AS vector_score,
               0.3 * coalesce(w.score, 0) + 0.7 * coalesce(v.score, 0) AS hybrid_score FROM w FULL JOIN v ON w.query_id = v.query_id AND w.chunk_id = v.chunk_id"""
    inner = blank[1:-1]
    java = lambda p: p.replace(r"\s+", blank + "+").replace(r"\s", inner).replace(r"\d", r"\p{Nd}")  # noqa: E731  Unicode's blanks and digits
    headings = "(?i)" + "|".join(f"(?:{java(p)})" for p in K.HEADING_PATTERNS)
    is_title = r"regexp_matches(text, '\p{Lu}|\p{Lt}') AND NOT regexp_matches(text, '(?:^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]')"
    is_upper = r"regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '\p{Ll}|\p{Lt}')"
    all_lines = "string_split(text, chr(10))"
    checks = {
        "is_table": f"len({all_lines}) >= 2 AND len(list_filter({all_lines}, lambda l: regexp_matches(l, '{blank}{{2,}}|\t|[|]'))) >= len({all_lines}) * 0.5",
        "is_image": f"regexp_matches(lower(text), '{'|'.join(K.IMAGE_WORDS)}')",
        "is_header": rf"NOT regexp_matches(text, '(?:^|\n){blank}*(?:-|\p{{Nd}}+\.|[a-zA-Z]\.)') AND {n_words} <= 15 AND (({is_upper}) OR ({is_title}))",
        "is_list": rf"len(list_filter({all_lines}, lambda l: regexp_matches(l, '^{blank}*(?:-|\p{{Nd}}+\.|[a-zA-Z]\.)'))) >= len({all_lines}) * 0.5",
    }
    kind_of_text = f"CASE WHEN {checks['is_table']} THEN 'table' WHEN {checks['is_image']} THEN 'image' WHEN {checks['is_header']} THEN 'header' WHEN {checks['is_list']} THEN 'list' ELSE 'text' END"
    code = "|".join("^" + c.replace(" ", "[ ]") for c in K.CODE_STARTS)
    structure = rf"""
        ln AS (SELECT doc_id, l, s FROM (SELECT doc_id, l, {strip.format("l")} AS s FROM (SELECT doc_id, unnest({all_lines}) AS l FROM documents)) WHERE s <> ''),
        cn AS (SELECT doc_id, sum(CASE WHEN regexp_matches(s, '{headings}') THEN 1 ELSE 0 END) AS headings, bool_or(regexp_matches(s, '{"|".join(f"(?:{java(p)})" for p in K.LIST_PATTERNS)}')) AS lists,
                      bool_or(regexp_matches(l, '\|[^|]*\|')) AS tables, bool_or(regexp_matches(s, '{code}')) AS code, sum(CASE WHEN length(s) > 10 THEN 1 ELSE 0 END) AS paragraphs FROM ln GROUP BY 1),
        sx AS (SELECT d.doc_id, coalesce(headings, 0) > 0 AS has_headings, coalesce(lists, false) AS has_lists, coalesce(tables, false) AS has_tables, coalesce(code, false) AS has_code, CAST(coalesce(paragraphs, 0) AS BIGINT) AS paragraph_count,
                      CASE WHEN code THEN 'code' WHEN headings > paragraphs * 0.2 THEN 'hierarchical' WHEN tables THEN 'tabular' WHEN length(text) > 5000 AND paragraphs > 10 THEN 'complex' ELSE 'simple' END AS structure_type
               FROM documents d LEFT JOIN cn USING (doc_id))"""
    estimate_p = f"CASE {lang} WHEN 'vietnamese' THEN floor(n / 3.0) WHEN 'english' THEN floor(n / 4.0) ELSE floor(n / 3.5) END"
    of_p = lambda sql: sql.replace("(text,", "(p,").replace("length(text)", "length(p)")
    rows_of_plan = """
        pl AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Weight' ELSE 'BloodGlucose' END AS r1, CASE WHEN c_custkey % 7 = 0 THEN 'midnight' ELSE 'noon' END AS p1, CASE WHEN c_custkey % 11 = 0 THEN 'sitting' ELSE 'fasting' END AS s1, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE ' b ' END AS reason2 FROM customer),
        rs AS (SELECT id, 0 AS item, r1 AS "recordType", p1 AS period, s1 AS subtype, 'r' || id AS reason FROM pl WHERE id % 4 > 0 UNION ALL SELECT id, 1, 'BloodPressure', 'morning', NULL, reason2 FROM pl WHERE id % 4 > 0 UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL FROM pl WHERE id % 4 = 0),
        er AS (SELECT id, CAST(item AS INTEGER) AS item, "recordType", period, subtype, trim(reason) AS reason, CASE WHEN item IS NULL THEN 'no JSON array in the response' WHEN "recordType" = 'Weight' THEN 'unknown recordType' WHEN period = 'midnight' THEN 'unknown period' WHEN subtype = 'sitting' THEN 'unknown subtype' WHEN reason = '' THEN 'reason is missing' END AS error FROM rs)"""
    undone = "text"
    for a, b in (("'\\n'", "chr(10)"), ("'\\t'", "chr(9)"), ("'\\\"'", "'\"'"), ("'\\'" + "''", "''" + "''")):
        undone = f"replace({undone}, {a}, {b})"
    for pattern, to in ((r"(?s)```.*?```", ""), ("`([^`]*)`", r"\1"), ("<[^>]+>", ""), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{7F}-\x{9F}]", ""), (blank + "+", " ")):
        undone = f"regexp_replace({undone}, '{pattern}', '{to}', 'g')"
    undone = strip.format(undone)
    uploads = """up AS (SELECT doc_id, source AS collection, CASE WHEN doc_id % 11 > 0 THEN 'f' || doc_id || '.' || (['txt', 'PDF', 'exe', 'docx', 'tar.gz', 'md'])[doc_id % 6 + 1] END AS filename, n_chars * 20000 AS size, CASE WHEN doc_id % 3 = 0 THEN 'text/plain' END AS content_type, doc_id * 61 AS secs FROM documents)"""
    near = f"nv AS (SELECT CAST(b.vec_id + 1 AS INTEGER) AS query_id, a.vec_id AS chunk_id, {cos} AS score FROM embeddings a, embeddings b WHERE b.vec_id < 3)"

    def collection(name: str) -> str:
        return rf"""(WITH {index(f"lang = '{name}'")}, {near},
            v0 AS (SELECT nv.*, {ranked.format("score")} FROM nv JOIN c USING (chunk_id)), v AS (SELECT * FROM v0 WHERE rank <= 20),
            w0 AS (SELECT *, {ranked.format("score")} FROM norm), w AS (SELECT * FROM w0 WHERE rank <= 20), f AS ({fused}),
            r AS (SELECT *, {ranked.format("hybrid_score")} FROM f WHERE hybrid_score >= 0.05)
            SELECT query_id, chunk_id, '{name}' AS collection, hybrid_score * {0.5 if name == "de" else 1.0} AS weighted FROM r WHERE rank <= 10)"""

    multi = f"""u AS ({" UNION ALL ".join(f"SELECT * FROM {collection(x)}" for x in LANGUAGES)}),
            m AS (SELECT *, min(weighted) OVER (PARTITION BY query_id) AS lo, max(weighted) OVER (PARTITION BY query_id) AS hi FROM u),
            s AS (SELECT *, CASE WHEN hi > lo THEN (weighted - lo) / (hi - lo) ELSE weighted END AS score FROM m),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, collection, chunk_id) AS INTEGER) AS rank FROM s WHERE score >= 0.05)"""
    clean = "coalesce(text, '')"
    class_ = r"[^\p{L}\p{N}\p{M}\p{Pc}\s\x0B\x{85}\x{A0}\x{2028}\x{2029}À-ɏḀ-ỿ.,!?;:()\[\]\"''\n-]"
    for pattern, to in ((r"[ \t]+", " "), (r"\n{3,}", r"\n\n"), (class_, " "), (rf"(?i)([.!?])\s*([{K.SENTENCE_STARTS}])", r"\1 \2"), (" +", " ")):
        clean = f"regexp_replace({clean}, '{pattern}', {text(to) if to != chr(92) + 'n' + chr(92) + 'n' else 'chr(10) || chr(10)'}, 'g')"
    heading = "CASE " + " ".join(f"WHEN regexp_matches(s, '(?i){p}') THEN {i % 4 + 1}" for i, p in enumerate(K.HEADING_PATTERNS)) + " END"
    lines = rf"SELECT doc_id, i - 1 AS line_no, l AS line, {strip.format('l')} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"
    html = "html"
    for pattern, to in ((r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", ""), (r"(?s)<!--.*?-->|<![^>]*>", ""), ("<[^>]+>", "")):
        html = f"regexp_replace({html}, '{pattern}', '{to}', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        html = f"replace({html}, '{entity}', '{char}')"
    prompt = {k: f"{text(a)} || query || {text(b)} || context || {text(c)} || {text(K.CLEAN_OUTPUT[k])} || CASE WHEN length(past) > 0 THEN chr(10) || chr(10) || '{K.HISTORY_TITLE[k]}' || chr(10) || past || chr(10) ELSE '' END" for k, (a, b, c) in K.DEFAULT_PROMPT.items()}
    return {
        "bm25_topk": rf"WITH {index()}, r AS (SELECT query_id, chunk_id, raw, {ranked.format('raw')} FROM sc) SELECT query_id, rank, chunk_id, round(raw, 6) AS score FROM r WHERE rank <= 10",
        "bm25_minmax": f"WITH {index()} SELECT query_id, chunk_id, round(score, 6) AS score FROM norm",
        "bm25_topk_filtered": rf"WITH {index()}, r AS (SELECT query_id, norm.chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, norm.chunk_id) AS INTEGER) AS rank FROM norm JOIN c ON c.chunk_id = norm.chunk_id WHERE score >= 0.2 AND source IN ('src1', 'src2', 'src3')) SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 10",
        "term_stats": f"WITH {index()} SELECT term, df, round(idf, 6) AS idf FROM ts",
        "bm25_maintained": f"""WITH {kept}, t AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM kc) GROUP BY 1, 2), s AS (SELECT chunk_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens FROM t GROUP BY 1)
            SELECT kc.chunk_id, len(toks) AS dl, coalesce(terms, 0) AS terms, coalesce(tokens, 0) AS tokens FROM kc LEFT JOIN s USING (chunk_id)""",
        "bm25_merged_terms": f"""WITH {kept}, d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM kc) GROUP BY 1), r AS (SELECT df, ln((SELECT count(*) FROM kc) - df + 0.5) - ln(df + 0.5) AS raw FROM d)
            SELECT df, count(*) AS terms, round(max(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END), 6) AS idf FROM r GROUP BY df""",
        "vector_topk": f"SELECT a.vec_id AS chunk_id, round({cos}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY round({cos}, 9) DESC, a.vec_id LIMIT 10",
        "vector_topk_threshold": f"SELECT a.vec_id AS chunk_id, round({cos}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.label IN (0, 1, 2, 3) AND {cos} >= 0.1 ORDER BY round({cos}, 9) DESC, a.vec_id LIMIT 50",
        "vector_batch_topk": f"WITH {near}, r AS (SELECT *, {ranked.format('score')} FROM nv) SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 10",
        "hybrid_search": rf"""WITH {index()}, {near}, v0 AS (SELECT *, {ranked.format("score")} FROM nv), v AS (SELECT * FROM v0 WHERE rank <= 200), w0 AS (SELECT *, {ranked.format("score")} FROM norm), w AS (SELECT * FROM w0 WHERE rank <= 200),
            f AS ({fused}), r AS (SELECT *, {ranked.format("hybrid_score")} FROM f WHERE hybrid_score >= 0.1)
            SELECT query_id, rank, chunk_id, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score, round(hybrid_score, 6) AS hybrid_score FROM r WHERE rank <= 20""",
        "hybrid_multi_collection": f"WITH {multi} SELECT query_id, rank, collection, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 10",
        "search_results": f"WITH {multi} SELECT query_id, rank, md5(text) AS content_md5, source, round(score, 6) AS score, collection AS collection_name FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 10",
        "bm25_topk_alt": f"""WITH {index()}, e AS (SELECT query_id, norm.chunk_id, CASE WHEN hi > lo THEN score ELSE 1.0 END AS score FROM norm JOIN ends USING (query_id)),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id DESC) AS INTEGER) AS rank FROM e) SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 10 AND score >= 0.3""",
        "bm25_incremental": f"SELECT doc_id AS chunk_id, len({words}) AS dl, len(list_distinct({words})) AS terms, CAST(len({words}) AS BIGINT) AS tokens FROM documents",
        "content_type": f"SELECT doc_id, {kind_of_text} AS content_type FROM documents",
        "text_checks": f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in checks.items())} FROM documents",
        "structure_type": f"WITH {structure} SELECT sx.*, CASE WHEN letters = 0 THEN 'unknown' WHEN r > 0.20 THEN 'vietnamese' WHEN r > 0.05 THEN 'mixed' ELSE 'english' END AS language FROM sx JOIN ({chunk}) USING (doc_id)",
        "chunk_strategy": f"WITH {structure} SELECT sx.doc_id, CASE structure_type WHEN 'hierarchical' THEN 'hierarchical' WHEN 'complex' THEN 'semantic' WHEN 'tabular' THEN 'semantic' ELSE 'simple' END AS strategy, length(text) AS original_length FROM sx JOIN documents USING (doc_id) WHERE {strip.format('text')} <> ''",
        "chunk_semantic": rf"""WITH ps AS (SELECT doc_id, i, {strip.format("p")} AS p FROM (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n{blank}*\n') AS x FROM documents))),
            es AS (SELECT doc_id, i, p, {estimate_p} AS t FROM (SELECT *, length(p) AS n, {of_p(n_letters)} AS letters, {of_p(ratio)} AS r FROM ps WHERE p <> '')),
            fs AS (SELECT doc_id, list_reduce(list({{'done': CAST([] AS VARCHAR[]), 'open': p, 'size': CAST(t AS BIGINT)}} ORDER BY i), lambda a, x: CASE WHEN a.size + x.size > 256 THEN {{'done': list_append(a.done, a.open), 'open': x.open, 'size': x.size}}
                ELSE {{'done': a.done, 'open': a.open || chr(10) || chr(10) || x.open, 'size': a.size + x.size}} END) AS f FROM es GROUP BY 1)
            SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS chunk_index, unnest(cs) AS page_content FROM (SELECT doc_id, list_append(f.done, f.open) AS cs FROM fs)""",
        "chunk_hierarchical": rf"""WITH l0 AS (SELECT doc_id, line_no, line, s, CASE WHEN s <> '' THEN {heading} END AS level FROM ({lines})),
            l1 AS (SELECT *, min(level) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowest, bool_or(s <> '') OVER (PARTITION BY doc_id ORDER BY line_no) AS filled FROM l0),
            l2 AS (SELECT *, level IS NOT NULL AND (lowest IS NULL OR level <= lowest) AS opens FROM l1 WHERE filled),
            l3 AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER w - CAST(first_value(opens) OVER w AS INTEGER) AS section FROM l2 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
            g AS (SELECT doc_id, CAST(section AS INTEGER) AS section, CAST(min(CASE WHEN opens THEN level END) AS INTEGER) AS section_level, string_agg(line, chr(10) ORDER BY line_no) AS content FROM l3 GROUP BY 1, 2)
            SELECT doc_id, section, section_level, CAST(length(content) AS INTEGER) AS n, md5(content) AS md5 FROM g""",
        "document_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS document_index FROM documents",
        "upload_check": f"""WITH {uploads} SELECT doc_id, CASE WHEN filename IS NULL THEN 'a name is needed' WHEN lower(regexp_extract(filename, '[.][^.]+$')) NOT IN ({quoted(K.ALLOWED_EXTENSIONS)}) THEN 'unsupported extension' WHEN size > {K.MAX_UPLOAD_BYTES} THEN 'too large' END AS error FROM up""",
        "file_info": f"WITH {uploads} SELECT filename, size AS file_size, lower(regexp_extract(filename, '[.][^.]+$')) AS file_extension, coalesce(content_type, 'application/octet-stream') AS content_type FROM up WHERE filename IS NOT NULL",
        "object_keys": f"WITH {uploads} SELECT doc_id, collection || '/' || strftime(make_timestamp(secs * 1000000), '%Y%m%d_%H%M%S') || '_' || filename AS object_key FROM up",
        "embedding_stats": f"SELECT count(*) AS total_texts_embedded, CAST(sum({n_words}) AS BIGINT) AS total_tokens_processed, CAST(ceil(count(*) / 16.0) AS BIGINT) AS batch_count, round(sum({n_words}) / CAST(count(*) AS DOUBLE), 6) AS avg_tokens_per_text FROM documents",
        "store_stats": """WITH g AS (SELECT value > 50 AS i, CAST(round(value, 2) AS DECIMAL(18, 2)) AS s FROM events), t AS (SELECT 3 * count(*) FILTER (i) AS ni, 3 * count(*) FILTER (NOT coalesce(i, false)) AS ns, CAST(coalesce(sum(s) FILTER (i), 0) AS DOUBLE) AS ti, CAST(coalesce(sum(s) FILTER (NOT coalesce(i, false)), 0) AS DOUBLE) AS ts FROM g)
            SELECT ni AS total_documents_indexed, ns AS total_searches_performed, round(ti, 4) AS total_indexing_time, round(ts, 4) AS total_search_time, round(CASE WHEN ns > 0 THEN ts / ns END, 4) AS avg_search_time_per_search, round(CASE WHEN ni > 0 THEN ti / ni END, 4) AS avg_indexing_time_per_doc FROM t""",
        "known_ids": "SELECT DISTINCT 3 * doc_id AS doc_id FROM labels WHERE 3 * doc_id IN (SELECT doc_id FROM documents)",
        "dictionary_union": "SELECT doc_id, array_to_string(list_sort(list_distinct(['x', source, lang])), ',') AS words FROM documents",
        "doc_metadata": f"""SELECT doc_id, length(text) AS length, CAST({n_words} AS BIGINT) AS words, {kind_of_text} AS content_type, CASE WHEN {n_words} = 0 OR {n_letters} = 0 THEN 'unknown' WHEN {marked} AND CAST({markers} AS DOUBLE) / {n_words} > 0.2 THEN 'mixed' WHEN {marked} AND {score} > 0.1 THEN 'vi'
            WHEN CAST(len(regexp_extract_all(text, '[a-zA-Z]')) AS DOUBLE) / {n_letters} > 0.9 AND NOT {marked} THEN 'en' ELSE 'unknown' END AS language, language AS detected, round({score}, 9) AS score FROM documents""",
        "clean_llm_response": f"""SELECT conv_id, turn, {undone} AS cleaned FROM (SELECT conv_id, turn, '<p>"' || text || '\n</p> `x` ```code```\t \"end\"' AS text FROM conversations)""",
        "response_guard": f"""WITH g AS (SELECT conv_id, turn, {undone} AS cleaned FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '`' || substr(text, 1, 3) || '`' ELSE text END AS text FROM conversations))
            SELECT conv_id, turn, CASE WHEN coalesce(length(cleaned), 0) < 5 THEN CASE WHEN conv_id % 2 = 0 THEN {text(K.APOLOGY["vi"])} ELSE {text(K.APOLOGY["en"])} END ELSE cleaned END AS answer FROM g""",
        "patient_ids": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN false ELSE regexp_full_match(trim(' ' || substr(c_name, 1, 2) || CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '' END || (c_custkey % 100) || ' '), '[\\p{L}\\p{N}]{3,}') END AS valid FROM customer",
        "template_format": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ' and {b} of ' || source END AS filled FROM documents",
        "json_arrays": """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN format('[{{"recordType":"{}","period":"{}","subtype":"{}","reason":"r{}"}}, {{"recordType":"BloodPressure","period":"morning","subtype":null,"reason":"{}"}} ]', CASE WHEN c_custkey % 5 = 0 THEN 'Weight' ELSE 'BloodGlucose' END,
            CASE WHEN c_custkey % 7 = 0 THEN 'midnight' ELSE 'noon' END, CASE WHEN c_custkey % 11 = 0 THEN 'sitting' ELSE 'fasting' END, c_custkey, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE ' b ' END) END AS found FROM customer""",
        "extract_json_rows": f'WITH {rows_of_plan} SELECT id, item, "recordType", period, subtype, reason, error FROM er',
        "careplan_lists": f"""WITH {rows_of_plan}, b AS (SELECT id, count(*) AS n, min(CASE WHEN error IS NOT NULL THEN coalesce(item, 0) END) AS first FROM er GROUP BY 1)
            SELECT b.id, CAST(CASE WHEN first IS NULL THEN n END AS INTEGER) AS rows, CASE WHEN first IS NOT NULL THEN 'item ' || first || ': ' || er.error END AS error FROM b LEFT JOIN er ON er.id = b.id AND coalesce(er.item, 0) = b.first""",
        "careplan_prompt": rf"""SELECT c_custkey, {text(P.CARE_PLAN_HEAD)} || '- ID: ' || c_name || chr(10) || '- Age: ' || (c_custkey % 100) || chr(10) || '- Gender: Nam' || chr(10) || '- BMI: ' || (c_custkey % 40) || chr(10) || '- Diabetes type: Type 1' || chr(10) || '- Insulin schedule: ' || chr(10) || '- Treatment method: diet' || chr(10)
            || '- Complications: x, y' || chr(10) || '- Past diseases: ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'None' END || chr(10) || '- Lifestyle: calm' AS prompt FROM customer""",
        "measurement_prompt": f"""SELECT c_custkey, 'Loại đo: Blood Glucose' || chr(10) || 'Giá trị: ' || (c_custkey % 15) || chr(10) || 'Thời điểm: noon' || chr(10) || 'Bối cảnh: ' || CASE WHEN c_custkey % 2 = 0 THEN 'after a meal' ELSE '{K.NO_CONTEXT}' END || chr(10) || 'Ghi chú: ' || CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '{K.NO_NOTE}' END AS prompt FROM customer""",
        "clean_text": f"SELECT doc_id, {strip.format(clean)} AS cleaned FROM documents",
        "vi_score": f"SELECT doc_id, round({score}, 9) AS score, {marked} AS marked FROM documents",
        "doc_language": f"""SELECT doc_id, CASE WHEN {n_words} = 0 OR {n_letters} = 0 THEN 'unknown' WHEN {marked} AND CAST({markers} AS DOUBLE) / {n_words} > 0.2 THEN 'mixed' WHEN {marked} AND {score} > 0.1 THEN 'vi'
            WHEN CAST(len(regexp_extract_all(text, '[a-zA-Z]')) AS DOUBLE) / {n_letters} > 0.9 AND NOT {marked} THEN 'en' ELSE 'unknown' END AS language FROM documents""",
        "chunk_language": f"SELECT doc_id, {lang} AS language, round(r, 6) AS ratio, round(CASE WHEN letters = 0 THEN 0 WHEN r > 0.20 THEN least(r * 2, 1.0) WHEN r > 0.05 THEN 0.7 ELSE 1.0 - r END, 6) AS confidence FROM ({chunk})",
        "token_estimate": f"SELECT doc_id, CAST(CASE {lang} WHEN 'vietnamese' THEN floor(n / 3.0) WHEN 'english' THEN floor(n / 4.0) ELSE floor(n / 3.5) END AS BIGINT) AS tokens FROM ({chunk})",
        "heading_extract": f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_number, CAST({heading} AS INTEGER) AS level, s AS text FROM ({lines}) WHERE {heading} IS NOT NULL",
        "tokenize_bm25": f"SELECT doc_id, len({words}) AS n, md5(array_to_string({words}, ' ')) AS md5 FROM documents",
        "tokenize_stopwords": rf"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS md5 FROM (SELECT doc_id, CASE WHEN r > 0.20 THEN list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w) NOT IN ({quoted(K.VI_STOPWORDS)}))
            ELSE list_filter({words}, lambda w: w NOT IN ({quoted(K.EN_STOPWORDS)})) END AS t FROM documents JOIN ({chunk}) c USING (doc_id))""",
        "html_to_text": rf"SELECT page_id, trim(regexp_replace({html}, '[ \t\r\n]+', ' ', 'g')) AS content FROM pages",
        "collection_stats": "SELECT source AS collection, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS total_size, round_even(sum(n_chars) / 1048576.0, 2) AS size_mb, CAST(sum(CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END) AS BIGINT) AS txt, CAST(sum(CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS md FROM documents GROUP BY 1",
        "kb_catalog": """WITH m AS (SELECT source AS name, 'about ' || min(lang) AS description, '2024-01-01' AS created_at, CASE WHEN min(doc_id) % 2 = 0 THEN '2024-02-02' END AS updated_at FROM documents GROUP BY 1),
            s AS (SELECT source AS name, count(*) AS documents, sum(n_chars) AS total_size, CASE WHEN max(doc_id) % 2 = 0 THEN '2024-03-03' END AS updated_at FROM documents GROUP BY 1)
            SELECT n.name, description, coalesce(documents, 0) AS documents, CAST(coalesce(total_size, 0) AS BIGINT) AS total_size, coalesce(s.updated_at, m.updated_at, created_at) AS updated_at
            FROM (SELECT DISTINCT source AS name FROM documents) n LEFT JOIN m USING (name) LEFT JOIN s USING (name)""",
        "pipeline_stats": """SELECT count(*) AS files, CAST(sum(doc_id % 3) AS BIGINT) AS documents, CAST(sum(doc_id % 7) AS BIGINT) AS chunks, CAST(sum(doc_id % 7) AS BIGINT) AS vectors, round(sum(doc_id % 3) / CAST(count(*) AS DOUBLE), 6) AS documents_per_file,
            round(sum(doc_id % 7) / CAST(count(*) AS DOUBLE), 6) AS chunks_per_file, round(sum(doc_id % 7) / CAST(count(*) AS DOUBLE), 6) AS vectors_per_file, round(sum(doc_id % 7) / CAST(sum(doc_id % 3) AS DOUBLE), 6) AS chunks_per_document,
            round((count(*) - sum(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END)) / CAST(count(*) AS DOUBLE) * 100, 6) AS success_rate FROM documents""",
        "collection_info": "SELECT 'label' || label AS collection, count(*) AS points_count, CAST(max(len(embedding)) AS INTEGER) AS vector_size, 'cosine' AS distance, 'ready' AS status FROM embeddings GROUP BY 1",
        "delete_by_ids": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
        "delete_by_filter": "SELECT doc_id, lang, source FROM documents WHERE NOT (lang = 'en' AND source IN ('src0', 'src1'))",
        "missing_collections": "SELECT name FROM (SELECT source AS name FROM documents UNION SELECT lang FROM documents) WHERE name NOT IN (SELECT source FROM documents WHERE lang = 'en')",
        "collection_upsert": """
            WITH first AS (SELECT doc_id AS chunk_id, source AS source_file, lang AS file_extension, n_chars, md5(text) AS digest, NULL AS note FROM documents WHERE doc_id % 5 > 0),
            again AS (SELECT doc_id AS chunk_id, source AS source_file, lang AS file_extension, -n_chars AS n_chars, md5(text) AS digest, 'again' AS note FROM documents WHERE doc_id % 3 = 0),
            merged AS (SELECT * FROM again UNION ALL SELECT * FROM first WHERE chunk_id NOT IN (SELECT chunk_id FROM again))
            SELECT *, 'kb' AS collection FROM merged WHERE chunk_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND NOT (source_file = 'src1' AND file_extension = 'en')""",
        "page_keyset": "SELECT lang, doc_id, source FROM documents WHERE (lang = 'de' AND doc_id > 0) OR lang > 'de' ORDER BY lang, doc_id LIMIT 20 OFFSET 20",
        "field_search": rf"""
            WITH f AS (SELECT doc_id, unnest([{{'field': 'text', 'w': 1.0, 't': {words}}}, {{'field': 'lang', 'w': 2.0, 't': [lang]}}, {{'field': 'source', 'w': 0.5, 't': [source]}}]) AS x FROM documents),
            m AS (SELECT x.field AS field, avg(len(x.t)) AS mean FROM f GROUP BY 1),
            q(query_id, term) AS (VALUES (1, 'de'), (1, 'und'), (1, 'src3'), (1, 'the'), (2, 'es'), (2, 'la'), (2, 'que')),
            h AS (SELECT doc_id, field, w, len, term, count(*) AS tf FROM (SELECT doc_id, x.field AS field, x.w AS w, len(x.t) AS len, unnest(x.t) AS term FROM f) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
            g AS (SELECT doc_id, term, sum(w * tf / (0.25 + 0.75 * len / mean)) AS f FROM h JOIN m USING (field) GROUP BY 1, 2),
            d AS (SELECT term, count(*) AS df FROM g GROUP BY 1),
            s AS (SELECT query_id, doc_id, sum(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * f / (1.2 + f)) AS score FROM g JOIN d USING (term) JOIN q USING (term) GROUP BY 1, 2),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
        "history_stream": past,
        "word_costs": r"""
            WITH p AS (SELECT regexp_extract_all(p, '\p{L}+') AS s FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\s]+')) AS p FROM documents)),
            w AS (SELECT unnest(s) AS w FROM p UNION ALL SELECT unnest(list_transform(list_zip(s, s[2:], true), lambda x: x[1] || ' ' || x[2])) FROM p WHERE len(s) > 1),
            c AS (SELECT w, count(*) AS c FROM w GROUP BY 1 HAVING count(*) >= 5),
            t AS (SELECT sum(c) AS total FROM c WHERE w NOT LIKE '% %'),
            k AS (SELECT c.w, c.c FROM c LEFT JOIN c a ON a.w = split_part(c.w, ' ', 1) LEFT JOIN c b ON b.w = split_part(c.w, ' ', 2), t WHERE c.w NOT LIKE '% %' OR ln(c.c * total / (a.c * b.c)) >= 2.0)
            SELECT w AS word, round(ln(total) - ln(c), 6) AS cost FROM k, t""",
        "ingest_stats": f"""
            WITH c AS (SELECT text, {n_words} AS n, vec_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
            t AS (SELECT count(*) AS rows, count(*) AS texts, sum(n) AS tokens, count(vec_id) AS vectors, max(length(text)) AS longest FROM c)
            SELECT 'index' AS operation, metric, CAST(total AS BIGINT) AS total FROM (UNPIVOT t ON COLUMNS(*) INTO NAME metric VALUE total)""",
        "embed_once": "SELECT count(*) AS rows, count(*) AS embedded, count(DISTINCT substr(text, 1, 2048)) AS distinct_inputs, count(DISTINCT substr(text, 1, 2048)) AS encoded FROM documents",
        "hash_embed_topk": rf"""
            WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower('passage: ' || substr(text, 1, 2048)), '[^{inner}]+')) AS w FROM documents UNION ALL SELECT NULL, unnest(string_split(lower({text("query: " + QUERY)}), ' '))),
            h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM w),
            v AS (SELECT doc_id, h % 64 AS i, sum(CASE WHEN h >= 2147483648 THEN 1.0 ELSE -1.0 END) AS x FROM h GROUP BY 1, 2),
            n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1),
            s AS (SELECT a.doc_id AS chunk_id, sum(a.x * b.x) AS dot FROM v a JOIN v b ON a.i = b.i AND b.doc_id IS NULL WHERE a.doc_id IS NOT NULL GROUP BY 1)
            SELECT chunk_id, round(score, 4) AS score FROM (SELECT chunk_id, dot / n / (SELECT n FROM n WHERE doc_id IS NULL) AS score FROM s JOIN n ON n.doc_id = chunk_id) ORDER BY round(score, 6) DESC, chunk_id LIMIT 10""",
        **dict.fromkeys(("chunk_simple_content", "chunk_hierarchical_content", "chunk_dispatch_content"), f"SELECT doc_id, length(t) AS n, md5(array_to_string(list_sort(string_split(t, '')), '')) AS md5 FROM (SELECT doc_id, regexp_replace(text, '{blank}+', '', 'g') AS t FROM documents) WHERE t <> ''"),
        "paginate_templates": "SELECT item_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM benchmark ORDER BY item_id LIMIT 15 OFFSET 10",
        "chat_history_prompt": past,
        "chat_history_template": history.format(last=4, roles="".join(f" WHEN '{k}' THEN '{v}'" for k, v in K.TEMPLATE_ROLES.items())),
        "chat_prompt": f"""WITH h AS ({past}), q AS (SELECT conv_id, arg_max(text, turn) AS query FROM conversations GROUP BY 1),
            k AS (SELECT max(conv_id) + 1 AS n FROM conversations),
            f AS (SELECT doc_id % n AS conv_id, string_agg('- ' || text, chr(10) ORDER BY doc_id) AS context FROM documents, k WHERE doc_id // n < 3 GROUP BY 1),
            j AS (SELECT q.conv_id, query, coalesce(context, '') AS context, coalesce(history, '') AS past FROM q LEFT JOIN f ON f.conv_id = q.conv_id LEFT JOIN h ON h.conv_id = q.conv_id)
            SELECT conv_id, (CASE WHEN conv_id % 2 = 0 THEN {prompt["vi"]} ELSE {prompt["en"]} END) || chr(10) || chr(10) || 'User: ' || query AS prompt FROM j""",
        "careplan_validate": """SELECT c_custkey, CASE WHEN NOT (c_custkey % 150 BETWEEN 1 AND 120) THEN 'age must be from 1 to 120' WHEN NOT (c_custkey % 60 BETWEEN 10 AND 50) THEN 'bmi must be from 10.0 to 50.0'
            WHEN c_custkey % 4 = 0 THEN 'unknown gender' WHEN c_custkey % 5 = 0 THEN 'unknown diabetes type' END AS error FROM customer""",
        "prompt_variables": "SELECT doc_id, array_to_string(list_sort(list_distinct(['query', lang, 'source'])), ',') AS variables, '{{ query }} in {{' || lang || '}} by Q and ' || source AS filled FROM documents",
        "sanitize_text": rf"SELECT doc_id, substr(regexp_replace({strip.format('text')}, '{blank}+', ' ', 'g'), 1, 200) AS sanitized FROM documents",
        "embed_inputs": f"SELECT doc_id, md5('passage: ' || substr(text, 1, 2048)) AS md5, CAST({n_words} AS BIGINT) AS tokens FROM documents",
        "measurement_ranges": f"""SELECT kind, name, count(*) AS n FROM events JOIN (VALUES {", ".join(str(r) for r in K.NORMAL_RANGES)}) r(kind, name, lo, hi) ON value BETWEEN lo AND hi GROUP BY 1, 2""",
    }


ORACLES = _sql()
# the same results from a stored index
ORACLES |= {stored: ORACLES[plain] for stored, plain in (("bm25_stored_topk", "bm25_topk"), ("bm25_stored_filtered", "bm25_topk_filtered"), ("hybrid_stored", "hybrid_multi_collection"), ("vector_lists_topk", "vector_batch_topk"))}

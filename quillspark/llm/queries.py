"""The registered queries of this package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import conversations, merkle, ngram_jaccard, packing, quality_knn, quality_rules, sentencepiece_scan, sharding, simhash, suffix_tree, token_binary, token_counts, warc
from quillspark.llm.common import scratch, table
from quillspark.llm.oracles import ORACLES
from quillspark.llm.tokens import default_path


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(spark, path)
    block, about, first = F.col("record.block"), F.get("metadata", F.lit(0))["block"], F.col("record.warc_type") == "response"
    return captures.select(
        warc.field(about, "page-id").cast("long").alias("page_id"),
        F.when(first, F.octet_length(block) - warc.http_header_bytes(F.col("record.headers"))).otherwise(warc.field(block, "Content-Length")).cast("long").alias("payload_bytes"),
        F.when(first, F.sha1(warc.http_body(F.col("record")))).otherwise(F.col("record.headers")["payload-sha1"]).alias("payload_digest"),
        F.col("record.warc_type").alias("record_type"),
        warc.field(about, "refers-to-page-id").cast("long").alias("refers_to"),
        F.size("requests").alias("n_requests"),
    )


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_digests(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), default_path("word_bpe_49k.json"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.linked(table(spark, sf_dir, "documents"), ngram_jaccard.Alike(k=4, percent=85))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cache, tokenizer = table(spark, sf_dir, "documents"), scratch(spark, "token-cache"), default_path("piece_bpe_32k.model")
    token_counts.count_tokens(docs.where("lang = 'en'"), cache, tokenizer)  # an earlier delivery: the whole table then finds its counts in the cache
    counts = token_counts.count_tokens(docs, cache, tokenizer)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_knn.train(docs, table(spark, sf_dir, "labels"), ~quality_knn.held_out())
    scored = quality_knn.score(docs, model)
    return scored.select("doc_id", quality_knn.held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op7_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = sentencepiece_scan.encode(docs, default_path("piece_bpe_32k.model"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "score", F.md5("decoded").alias("decoded_md5"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first quarter of a document is its prompt and bears no loss
    limits = packing.Limits(tokens=2048, segments=64, loss_tokens=1792)
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"), end_id=1, limits=limits, lead_share=0.25)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report = conversations.repair_report(conversations.damaged(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op12_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shards(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, docs = ["doc_id", "source", "lang", "n_chars", "text"], table(spark, sf_dir, "documents")
    upper = "".join(map(chr, range(65, 91)))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    rows = merkle.proofs(docs, fields, claimed=merkle.leaf(*[F.col(f) for f in fields[:-1]], tampered))
    folded = merkle.fold(F.col("claimed"), F.col("steps"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_warc_transactions, op2_token_binary, op3_ngram_jaccard, op4_token_counts, op5_suffix_tree, op6_quality_knn, op7_sentencepiece_scan, op8_simhash, op9_weak_supervision, op10_packing, op11_conversation_repair, op12_minimax_shards, op13_merkle_manifest)}

"""Fusion of word and vector search, in one collection and over many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def candidates(top_k: int) -> int:
    """How many results of either search are fused."""
    return max(2 * top_k, 10)


def fuse(words: DataFrame, vectors: DataFrame, word_weight: float = 0.3, vector_weight: float = 0.7, threshold: float | None = 0.3, top_k: int | None = 10, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """by, chunk_id, bm25_score, vector_score, hybrid_score, rank: weighted sums of two result lists (score), 0 where one has no row."""
    keys = [*by, "chunk_id"]
    both = words.select(*keys, F.col("score").alias("bm25_score")).join(vectors.select(*keys, F.col("score").alias("vector_score")), keys, "full_outer")
    both = both.fillna(0.0, ["bm25_score", "vector_score"]).withColumn("hybrid_score", word_weight * F.col("bm25_score") + vector_weight * F.col("vector_score"))
    if threshold is not None:
        both = both.where(F.col("hybrid_score") >= threshold)
    if not by:
        raise ValueError("results are fused for each query: by names its columns")
    best = Window.partitionBy(*by).orderBy(F.round("hybrid_score", 9).desc(), "chunk_id")
    both = both.withColumn("rank", F.row_number().over(best))
    return both.where(F.col("rank") <= top_k) if top_k else both


def over_collections(results: DataFrame, weights: dict[str, float] | None = None, threshold: float | None = 0.3, top_k: int = 10) -> DataFrame:
    """One ranking of the fused results of several collections (query_id, collection, chunk_id, hybrid_score).

    Scores are weighted by collection (1 if none is given) and brought to 0..1 over all results of a query, unless they are all equal. Then
    threshold and cut; duplicates over collections stay."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("collection") == name, float(w)).otherwise(weight)
    rows = results.withColumn("weighted", F.col("hybrid_score") * weight)
    every = Window.partitionBy("query_id")
    lo, hi = F.min("weighted").over(every), F.max("weighted").over(every)
    rows = rows.withColumn("score", F.when(hi > lo, (F.col("weighted") - lo) / (hi - lo)).otherwise(F.col("weighted")))
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "collection", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)

"""Ranking over several fields at once, such as a template's name, description and text: BM25F."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.bm25 import top_k
from quillspark.shared import small


def search(rows: DataFrame, queries: DataFrame, weights: dict[str, float], k: int = 20, id_col: str = "id", k1: float = 1.2, b: float | dict[str, float] = 0.75, segment: T.Segment | None = None, most_terms: int = 1000) -> DataFrame:
    """query_id, id, score, rank: the k rows that say most of what is asked (query_id, query_text), over the fields of weights.

    A term's frequency in a row is the weighted sum of its frequencies in the fields, each divided by 1 - b + b * length / mean length of that field; it saturates once, over all fields:
    score = sum of idf * f / (k1 + f), idf = log(1 + (N - df + 0.5) / (df + 0.5)), df counting rows with the term in any field. Null fields are empty, a
    field that is empty everywhere has no part. Of a row's tokens only the asked terms are kept, where they are read if they are at most most_terms, else by a join; repeated query terms count once. Ties go to the smaller id."""
    names = list(weights)
    share = b if isinstance(b, dict) else dict.fromkeys(names, b)
    tokens = rows.select(F.col(id_col).alias("chunk_id"), *[T.bm25_tokens(F.coalesce(F.col(f), F.lit("")), segment).alias(f) for f in names])
    means = tokens.agg(F.count("*").alias("rows"), *[F.avg(F.size(f)).alias(f"mean_{f}") for f in names])
    asked = small(queries.select("query_id", F.explode(F.array_distinct(T.bm25_tokens(F.col("query_text"), segment))).alias("term")))
    some = [r[0] for r in asked.select("term").distinct().limit(most_terms + 1).collect()]
    kept = lambda f: F.filter(f, lambda t: t.isin(some)) if len(some) <= most_terms else F.col(f)
    each = tokens.select("chunk_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.size(f).alias("length"), kept(f).alias("t")) for f in names])))
    hits = each.select("chunk_id", "field", "length", F.explode("t").alias("term"))
    if len(some) > most_terms:
        hits = hits.join(small(asked.select("term").distinct()), "term", "left_semi")
    counts = hits.groupBy("chunk_id", "term", "field", "length").agg(F.count("*").alias("tf")).crossJoin(F.broadcast(means))  # one row
    part = F.lit(None).cast("double")
    for f in names:
        norm = 1 - share[f] + share[f] * F.col("length") / F.col(f"mean_{f}")
        part = F.when(F.col("field") == f, weights[f] * F.col("tf") / norm).otherwise(part)
    whole = counts.groupBy("chunk_id", "term", "rows").agg(F.sum(part).alias("f"))
    df = whole.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = whole.join(df, "term").withColumn("s", idf * F.col("f") / (k1 + F.col("f"))).join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"))
    return top_k(scored, k).withColumnRenamed("chunk_id", id_col)

"""Embeddings and exact cosine search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.shared import small_batches

DEFAULT_THRESHOLD = 0.7
#: Rows of which a worker holds the vectors at once.
HELD = 256


class Embedder(Protocol):
    """dimension, and encode(texts) -> one vector per text."""

    dimension: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic stand-in for a model: words to signed dimensions by the first 32 bits of their MD5, to unit length."""

    def __init__(self, dimension: int = 768):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                out[i, h % self.dimension] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).astype("float32").tolist()


def embed(rows: DataFrame, embedder: Embedder, text_col: str = "page_content", is_query: bool = False, batch: int = 16) -> DataFrame:
    """rows with `embedding`; the embedder is loaded once per task and gets prefixed, cut texts in batches. Of its vectors a worker holds those of some batches, as 32-bit floats."""
    small_batches(rows.sparkSession)
    held = max(1, HELD // batch) * batch

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            values = s.tolist()
            for at in range(0, len(values), held) or [0]:
                some = values[at : at + held]
                yield pd.Series([np.asarray(v, np.float32) for i in range(0, len(some), batch) for v in embedder.encode(some[i : i + batch])], dtype=object)

    return rows.withColumn("embedding", run(T.embedding_input(F.coalesce(F.col(text_col), F.lit("")), is_query)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _real(norm: Column) -> Column:
    """Whether a length is one: above 0 and finite. NaN is above all numbers in Spark, null is null."""
    return (norm > 0) & (norm < F.lit(float("inf")))


def cosine(a: Column, b: Column) -> Column:
    """null for vectors without length and for those with null, NaN or an infinite value in them."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(_real(norm), dot(a, b) / norm)


def search_one(vectors: DataFrame, query: list[float], k: int = 10, threshold: float | None = DEFAULT_THRESHOLD, where: Column | None = None, id_col: str = "chunk_id") -> DataFrame:
    """The k nearest to one vector: a scan with the vector as a literal, and a top-k without a full sort. What has no score in search() has none here."""
    size = math.sqrt(sum(x * x for x in query)) if all(x is not None and math.isfinite(x) for x in query) else 0.0
    unit = F.array(*[F.lit(float(x) / size) for x in query]) if size else F.lit(None).cast("array<double>")
    own = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    rows = vectors if where is None else vectors.where(where)
    rows = rows.select(id_col, F.when(_real(own) & (F.size("embedding") == len(query)), dot(F.col("embedding"), unit) / own).alias("score"))
    rows = rows.where("score is not null" if threshold is None else F.col("score") >= threshold)
    return rows.orderBy(F.round("score", 9).desc(), id_col).limit(k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = DEFAULT_THRESHOLD, id_col: str = "chunk_id", by: tuple[str, ...] = (), most_bytes: int = 64 << 20) -> DataFrame:
    """query_id, by, id, score, rank: the k nearest of all vectors (of each value of by) for each query (query_id, query_embedding).

    Queries are broadcast as matrices of at most most_bytes, and blocks of vectors are multiplied with them; more queries are dealt by their ids to
    several matrices, each of which sees all vectors. Vectors and queries without length, of another length than the other, or with null, NaN or infinite
    values in them have no score. Ties go to the smaller id."""
    long = queries.select("query_id", F.col("query_embedding").cast("array<double>").alias("v")).where(F.size("v") > 0)
    parts = []
    for length, count in long.groupBy(F.size("v")).count().collect():  # one row for each length of vectors
        own, n = long.where(F.size("v") == length), max(1, -(-count * length * 8 // max(most_bytes, length * 8)))
        parts += [_blocked(vectors, own.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i), k, threshold, id_col, by) for i in range(n)]
    scored = reduce(DataFrame.unionByName, parts) if parts else _nothing(vectors, queries, id_col, by)
    return best(scored.where("score is not null" if threshold is None else F.col("score") >= threshold), k, id_col, by)


def best(scored: DataFrame, k: int, id_col: str = "chunk_id", by: tuple[str, ...] = ()) -> DataFrame:
    order = Window.partitionBy("query_id", *by).orderBy(F.round("score", 9).desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nothing(vectors: DataFrame, queries: DataFrame, id_col: str, by: tuple[str, ...]) -> DataFrame:
    return vectors.where("false").select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *by, id_col, F.lit(None).cast("double").alias("score"))


def _blocked(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None, id_col: str, by: tuple[str, ...]) -> DataFrame:
    """query_id, by, id, score: of each Arrow batch at least the k best for each query and value of by, ties with the last of them included."""
    asked = queries.collect()  # about most_bytes at most
    if not asked:
        return _nothing(vectors, queries, id_col, by)
    matrix = np.array([r[1] for r in asked], np.float64)
    matrix[~np.isfinite(matrix).all(axis=1)] = 0  # null in a query: no score
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit, silent = matrix / np.where(norms > 0, norms, 1), norms[:, 0] == 0
    shared = vectors.sparkSession.sparkContext.broadcast((pa.array([r[0] for r in asked], to_arrow_type(queries.schema["query_id"].dataType)), unit, silent))
    keys = [queries.schema["query_id"], *[vectors.schema[c] for c in (*by, id_col)]]
    out = ty.StructType([*keys, ty.StructField("score", ty.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, silent = shared.value
        for b in batches:
            lists = b.column("embedding")
            fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), unit.shape[1]), False))
            rows = np.flatnonzero(fits)
            if not len(rows):
                continue
            x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
            norms = np.linalg.norm(x, axis=1)  # NaN where a value is null
            real = (norms > 0) & np.isfinite(norms)
            scores = (np.where(real[:, None], x, 0) @ unit.T) / np.where(real, norms, np.nan)[:, None]
            scores[:, silent] = np.nan
            groups = _numbers([b.column(c).take(pa.array(rows)) for c in by]) if by else np.zeros(len(rows), np.int64)
            for g in np.unique(groups):
                own = np.flatnonzero(groups == g)
                part = np.nan_to_num(np.round(scores[own], 9), nan=-np.inf)
                if threshold is not None:
                    part[part < threshold - 1e-9] = -np.inf
                least = np.partition(part, len(own) - k, axis=0)[len(own) - k] if len(own) > k else np.full(part.shape[1], -np.inf)
                hit, q = np.nonzero((part >= least) & (part > -np.inf))
                if len(hit):
                    at = pa.array(rows[own[hit]])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), *(b.column(c).take(at) for c in (*by, id_col)), pa.array(scores[own[hit], q])], names=[f.name for f in out])

    return vectors.select(*by, id_col, "embedding").mapInArrow(run, out)


def _numbers(columns: list[pa.Array]) -> np.ndarray:
    """A number for each distinct row of values, nulls included."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        codes = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        out = np.unique(out * (codes.max() + 1) + codes, return_inverse=True)[1]
    return out


def embedding_stats(rows: DataFrame, text_col: str = "page_content", batch: int = 16) -> DataFrame:
    """One row: texts, tokens (words), batches and tokens a text of what embed() takes in."""
    n = F.count("*")
    tokens = F.coalesce(F.sum(T.count_words(F.coalesce(F.col(text_col), F.lit("")))), F.lit(0))
    return rows.agg(n.alias("total_texts_embedded"), tokens.alias("total_tokens_processed"), F.ceil(n / batch).alias("batch_count"), (tokens / F.greatest(n, F.lit(1))).alias("avg_tokens_per_text"))


def about(embedder: Embedder, batch: int = 16) -> dict[str, object]:
    return {"model_name": type(embedder).__name__, "dimension": getattr(embedder, "dimension", None) or 768, "normalize": True, "batch_size": batch}

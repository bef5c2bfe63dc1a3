"""Exact nearest neighbours over stored lists of vectors: the triangle inequality rules whole lists out.

Angles are a metric, so a vector at angle r of its list's centre is at least |a - r| away from a query at angle a of it. Lists whose
nearest possible vector is farther than the k-th best that is known already are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.operators.vectors import best
from quillspark.shared import small

#: Angles are compared with this much to spare: cosines near 1 lose digits.
SLACK = 1e-6


def _rows(lists: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have the dimension, a length and no null, NaN or infinite value, and these as unit vectors."""
    fits = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), dimension), False)))
    x = lists.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), dimension)
    norms = np.linalg.norm(x, axis=1)
    real = (norms > 0) & np.isfinite(norms)
    return fits[real], x[real] / norms[real, None]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a sample; where the centres lie decides speed alone."""
    rnd = np.random.default_rng(7)
    centres = sample[rnd.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


@dataclass(frozen=True)
class Lists:
    """Vectors below a path, parted by list; a table of the lists: list, centre, n, low and high (the angles of its vectors)."""

    spark: SparkSession
    path: str
    dimension: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, count: int | None = None, most_lists: int = 4096, most_sample: int = 50_000, id_col: str = "chunk_id") -> Lists:
        """Writes the lists of all vectors (id, embedding): about the root of their number, at most most_lists.

        The centres are made of a sample of at most most_sample vectors and broadcast; both bounds are parameters and touch speed, not results. Vectors without length, of
        another dimension than the first, or with null, NaN or infinite values are in no list, as they have no score. A large list is several files."""
        spark = vectors.sparkSession
        n, dimension = vectors.where(F.size("embedding") > 0).agg(F.count("*"), F.max(F.size("embedding"))).head()
        dimension = dimension or 1
        share = min(1.0, most_sample / max(n, 1))
        some = vectors.select("embedding").sample(share, 7).limit(most_sample).toArrow().column("embedding").combine_chunks()
        sample = _rows(some, dimension)[1] if len(some) else np.zeros((0, dimension))
        centres = _centres(sample, count or min(most_lists, max(1, int(n**0.5)))) if len(sample) else np.eye(1, dimension)
        shared = spark.sparkContext.broadcast(centres)
        out = ty.StructType([ty.StructField("list", ty.IntegerType()), ty.StructField("angle", ty.DoubleType()), vectors.schema[id_col], ty.StructField("embedding", ty.ArrayType(ty.FloatType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, unit = _rows(b.column("embedding"), dimension)
                if len(at):
                    near = np.argmax(unit @ shared.value.T, axis=1)
                    angle = np.arccos(np.clip((unit * shared.value[near]).sum(axis=1), -1.0, 1.0))
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(angle), b.column(id_col).take(take), b.column("embedding").take(take).cast(pa.list_(pa.float32()))], names=[f.name for f in out])

        rows = vectors.select(id_col, F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, out)
        # a list is dealt by angle too, so that a hot one is many tasks and each file a ring of it
        rows.repartitionByRange("list", "angle").sortWithinPartitions("list", "angle").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
        stats = spark.read.schema(out).parquet(f"{path}/vectors").groupBy("list").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        found = {r["list"]: r for r in stats.collect()}  # one row a list
        rows_of = [(i, centres[i].tolist(), found[i]["n"], found[i]["low"], found[i]["high"]) for i in sorted(found)]
        spark.createDataFrame(rows_of, "list int, centre array<double>, n long, low double, high double").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
        return cls(spark, path, dimension)

    def search(self, queries: DataFrame, k: int = 10, threshold: float | None = None, id_col: str = "chunk_id", most_bytes: int = 64 << 20) -> DataFrame:
        """query_id, id, score, rank: what vectors.search() finds, from the lists that can hold it. See reads() for which they are."""
        parts = []
        for block in self._blocks(queries, most_bytes) if len(self._lists()[0]) else ():
            plan = self._plan(block, k, threshold, id_col)
            parts.append(self._scores(block, plan[0] | plan[1], k, threshold, id_col) if block[1].shape[0] else None)
        parts = [p for p in parts if p is not None]
        if not parts:
            return self.spark.createDataFrame([], ty.StructType([queries.schema["query_id"], ty.StructField(id_col, ty.LongType()), ty.StructField("score", ty.DoubleType()), ty.StructField("rank", ty.IntegerType())]))
        return best(reduce(DataFrame.unionByName, parts).drop("_q"), k, id_col)

    def reads(self, queries: DataFrame, k: int = 10, threshold: float | None = None, id_col: str = "chunk_id") -> tuple[int, int]:
        """How many (query, list) pairs a search reads, and how many there are."""
        read = every = 0
        n = self._lists()[0].size
        for block in self._blocks(queries, 64 << 20):
            first, second = self._plan(block, k, threshold, id_col)
            read, every = read + int((first | second).sum()), every + n * len(block[0])
        return read, every

    def _lists(self) -> tuple[np.ndarray, ...]:
        t = self.spark.read.parquet(f"{self.path}/lists").orderBy("list").toArrow()  # at most most_lists rows
        centre = np.array(t.column("centre").to_pylist(), np.float64).reshape(t.num_rows, self.dimension)
        return t.column("list").to_numpy(), centre, t.column("n").to_numpy(), t.column("low").to_numpy(), t.column("high").to_numpy()

    def _blocks(self, queries: DataFrame, most_bytes: int) -> Iterator[tuple[list, np.ndarray, DataFrame]]:
        """Queries (query_id, query_embedding) with a score, in matrices of about most_bytes, each fetched when its turn comes."""
        own = queries.select("query_id", F.col("query_embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") == self.dimension)
        n = max(1, -(-own.count() * self.dimension * 8 // most_bytes))
        for i in range(n):
            t = own.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow()
            if t.num_rows:
                at, unit = _rows(t.column("embedding").combine_chunks(), self.dimension)
                yield [t.column("query_id")[int(j)].as_py() for j in at], unit, queries

    def _plan(self, block: tuple, k: int, threshold: float | None, id_col: str) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) masks: the nearest lists that hold k vectors, and all that can hold one of the k best, given what those have."""
        ids, unit, _ = block
        numbers, centre, n, low, high = self._lists()
        if not len(ids) or not len(numbers):
            return (np.zeros((len(ids), len(numbers)), bool),) * 2
        away = _angles(unit, centre)
        order = np.argsort(away, axis=1)
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros_like(away, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        known = small(self._scores(block, first, k, None, id_col).groupBy("_q").agg(F.sort_array(F.collect_list("score"), False).alias("s")).select("_q", F.get("s", F.lit(k - 1)).alias("kth")))
        floor = np.full(len(ids), -1.0 if threshold is None else threshold)
        for q, kth in known.collect():
            if kth is not None:
                floor[q] = max(floor[q], kth)
        nearest = np.maximum(np.maximum(away - high, low - away), 0)
        return first, nearest <= np.arccos(np.clip(floor, -1.0, 1.0))[:, None] + SLACK

    def _scores(self, block: tuple, wanted: np.ndarray, k: int, threshold: float | None, id_col: str) -> DataFrame:
        """query_id, _q (its place in the block), id, score of the vectors in each query's lists: of each batch and list the k best, ties included."""
        ids, unit, queries = block
        numbers = self._lists()[0]
        asks = {int(numbers[j]): np.flatnonzero(wanted[:, j]) for j in np.flatnonzero(wanted.any(axis=0))}
        held = self.spark.read.parquet(f"{self.path}/vectors").where(F.col("list").isin(list(asks)))
        names = pa.array(ids, to_arrow_type(queries.schema["query_id"].dataType))
        shared, dimension = self.spark.sparkContext.broadcast((names, unit, asks)), self.dimension
        out = ty.StructType([queries.schema["query_id"], ty.StructField("_q", ty.IntegerType()), held.schema[id_col], ty.StructField("score", ty.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, unit, asks = shared.value
            for b in batches:
                at, x = _rows(b.column("embedding"), dimension)
                lists = b.column("list").to_numpy()[at]
                for g in np.unique(lists):
                    own, asking = np.flatnonzero(lists == g), asks[int(g)]
                    scores = x[own] @ unit[asking].T
                    part = np.round(scores, 9)
                    if threshold is not None:
                        part[part < threshold - 1e-9] = -np.inf
                    least = np.partition(part, len(own) - k, axis=0)[len(own) - k] if len(own) > k else np.full(part.shape[1], -np.inf)
                    hit, q = np.nonzero((part >= least) & (part > -np.inf))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(asking[q])), pa.array(asking[q], pa.int32()), b.column(id_col).take(pa.array(at[own[hit]])), pa.array(scores[hit, q])], names=[f.name for f in out])

        rows = held.mapInArrow(run, out)
        return rows if threshold is None else rows.where(F.col("score") >= threshold)

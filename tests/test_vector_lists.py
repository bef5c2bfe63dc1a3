import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import vectors
from quillspark.operators.vector_lists import Lists

ODD = [(900, [1.0, float("nan"), 0.0]), (901, [float("inf"), 1.0, 0.0]), (902, [1.0, None, 0.0]), (903, None), (904, [0.0, 0.0, 0.0]), (905, [1.0, 2.0]), (906, [])]


def found(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("threshold", [None, 0.3])
def test_odd_vectors_have_no_score_in_any_path(spark, threshold):
    """NaN, infinite values, null in vectors and queries, no length, other dimensions: on both sides of the line of bytes, and for one query."""
    v = spark.createDataFrame([(1, [1.0, 0.1, 0.0]), (2, [0.5, 1.0, 0.0]), (3, [-1.0, 0.0, 0.2]), *ODD], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [float("nan"), 1.0, 0.0]), (3, [float("inf"), 0.0, 0.0]), (4, [None, 1.0, 0.0]), (5, [0.0, 0.0, 0.0]), (6, [0.0, 1.0, 0.1])], "query_id int, query_embedding array<double>")
    wide, blocks = (found(vectors.search(v, q, 5, threshold, most_bytes=b)) for b in (64 << 20, 1))
    assert wide == blocks and {r[0] for r in wide} == {1, 6} and not {r[2] for r in wide} & {i for i, _ in ODD}
    one = [(r.chunk_id, round(r.score, 8)) for r in vectors.search_one(v, [1.0, 0.0, 0.0], 5, threshold).collect()]
    assert one == [r[2:] for r in wide if r[0] == 1]
    assert vectors.search_one(v, [float("nan"), 1.0, 0.0], 5, threshold).count() == 0
    by_cosine = v.where("size(embedding) = 3").select("chunk_id", vectors.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("s")).where("s is not null")
    assert {r.chunk_id for r in by_cosine.collect()} == {1, 2, 3}
    assert vectors.search(v, q.limit(0), 5, threshold).count() == 0


def test_lists_against_brute_force(spark, tmp_path):
    rnd = np.random.default_rng(3)
    middles = rnd.normal(size=(12, 8))
    rows = [(i, (middles[i % 12] + 0.15 * rnd.normal(size=8)).tolist()) for i in range(600)] + [(1000 + i, middles[0].tolist()) for i in range(30)]  # ties
    v = spark.createDataFrame([*rows, (2000, [float("nan")] * 8), (2001, None), (2002, [0.0] * 8)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(j, middles[j].tolist()) for j in range(5)] + [(9, rnd.normal(size=8).tolist()), (10, [float("nan")] * 8), (11, [1.0])], "query_id int, query_embedding array<double>")
    lists = Lists.build(v, str(tmp_path / "l"))
    for k, threshold in ((10, None), (40, 0.8)):
        assert found(lists.search(q, k, threshold)) == found(vectors.search(v, q, k, threshold))
    read, every = lists.reads(q, 10)
    assert 0 < read < every / 2
    assert found(lists.search(q, 3, None, most_bytes=64)) == found(vectors.search(v, q, 3, None))
    assert lists.search(q.limit(0), 3).count() == 0
    empty = Lists.build(v.limit(0), str(tmp_path / "e"))
    assert empty.search(q, 3).count() == 0


def test_more_neighbours_than_vectors(spark, tmp_path):
    rnd = random.Random(1)
    v = spark.createDataFrame([(i, [rnd.random(), rnd.random()]) for i in range(7)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, math.pi])], "query_id int, query_embedding array<double>")
    assert len(found(Lists.build(v, str(tmp_path / "l")).search(q, 50))) == 7

import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import sharding as S
from quillspark.llm.order import numbered
from quillspark.llm.queries import op12_minimax_shards


def smallest(sizes, shards):
    """The least possible largest shard, by a table over all cuts."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = sums[:]
    for _ in range(shards - 1):
        best = [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sums))]
    return best[-1]


def groups_of(rows):
    """(smallest id, text, bytes) of each text, in order."""
    first, size = {}, {}
    for i, text in rows:
        t = text or ""
        first[t] = min(first.get(t, i), i)
        size[t] = size.get(t, 0) + len(t.encode()) + 1
    return [(first[t], t, size[t]) for t in sorted(first, key=first.get)]


def check(found, rows, shards):
    """Every row once; groups whole and contiguous; the largest shard minimal; slots gapless; sizes and checksums right."""
    texts = dict(rows)
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert all((r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 1, zlib.crc32((texts[r.doc_id] or "").encode())) for r in found)
    at = {}
    for r in found:
        assert at.setdefault(texts[r.doc_id] or "", r.shard) == r.shard
    groups = groups_of(rows)
    order = [at[t] for _, t, _ in groups]
    assert order == sorted(order) and set(order) <= set(range(shards))
    load = [0] * shards
    for _, t, size in groups:
        load[at[t]] += size
    assert max(load) == smallest([g[2] for g in groups], shards)
    for s in range(shards):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    return load


@pytest.mark.parametrize("seed", range(4))
def test_against_all_cuts(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, "", "copy " * 40, "é" * rnd.randint(0, 30), f"{i} " * rnd.randint(1, 60)])) for i in rnd.sample(range(1000), 120)]
    n = rnd.randint(2, 9)
    load = check(S.shards(spark.createDataFrame(rows, "doc_id long, text string"), n).collect(), rows, n)
    assert sum(load) == sum(g[2] for g in groups_of(rows))


def test_other_shards_are_even_beside_a_large_group(spark):
    rows = [(i, "copy " * 50 if i % 3 == 0 else f"{i:05d} " * 8) for i in range(600)]
    load = check(S.shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect(), rows, 8)
    rest = sorted(load)[:-1]
    assert rest[0] > 0 and max(rest) < 1.1 * min(rest)


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, a very long text, fewer groups than shards, extra columns with names used inside, an empty table."""
    rows = [(None, "a"), (None, None), (1, "a"), (1, "a"), (2, ""), (3, "x" * 2_000_000), (4, None)]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, text string, size string, _text string, upto string")
    found = S.shards(df, 8).collect()
    assert len(found) == len(rows) and len({(r.shard, r.slot) for r in found}) == len(rows)
    assert len({r.shard for r in found if r.size == 2}) == 1 and len({r.shard for r in found if r.size == 1}) == 1
    assert {r.text_crc32 for r in found if r.size == 1} == {0}
    assert S.shards(df.limit(0), 8).collect() == []


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = op12_minimax_shards(spark, sf_dir).collect()
    load = check(found, rows, 8)
    assert min(load) > 0.9 * max(load)
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(2).alias("w"))
    rows = numbered(df, [F.col("v")], "at", "t", {"sum": "w"}).collect()
    assert all(r["at"] == r.v and r["sum"] == 2 * (r.v + 1) for r in rows)

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import bm25, postings
from quillspark.operators.postings import Segments

SCHEMA = "collection string, doc_id long, chunk_id string, page_content string"


def words(rnd, n):
    return " ".join(f"w{min(int(rnd.expovariate(0.3)), 40)}" for _ in range(n))


def as_chunks(spark, docs):
    """docs: {(collection, doc_id): [texts]}; a chunk's id comes from its place."""
    return spark.createDataFrame([(c, d, f"{d}-{i}", t) for (c, d), texts in docs.items() for i, t in enumerate(texts)], SCHEMA)


def ranks(df, by, score="raw"):
    return sorted((r.query_id, *[r[c] for c in by], r["rank"], r.chunk_id, round(r[score], 8)) for r in df.collect())


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w3 w5 w5 nothing"), (2, "w0 w9"), (3, "w30 w1 w2 w12"), (4, "absent")], "query_id int, query_text string")


@pytest.mark.parametrize("by", [(), ("collection",)])
def test_segments_equal_a_fresh_build(spark, tmp_path, monkeypatch, queries, by):
    """Adding, editing, deleting, repeating and merging, against an index made anew of what is left."""
    monkeypatch.setattr(postings, "BLOCK", 4)
    rnd = random.Random(len(by))
    index, docs = Segments(spark, str(tmp_path / "i"), by), {}
    assert index.numbers() == [] and index.top_k(queries).count() == 0
    for step in range(2):
        new = {("ab"[d % 2], d): [words(rnd, rnd.randint(1, 30)) for _ in range(rnd.randint(1, 3))] for d in rnd.sample(range(60), 40 if step == 0 else 15)}
        gone = [] if step == 0 else rnd.sample([k for k in docs if k not in new], 4)
        if step == 1:
            same = next(iter(docs))
            new[same] = docs[same]
        removed = spark.createDataFrame(gone, "collection string, doc_id long") if gone else None
        for _ in range(2 if step == 1 else 1):  # a delivery that comes twice
            assert index.add(as_chunks(spark, new), step, removed) == step
        docs = {k: v for k, v in docs.items() if k not in gone} | new
        fresh = bm25.build(as_chunks(spark, docs), by=by)
        for i in (index, *([index.merge(str(tmp_path / "m"))] if step else [])):
            assert sorted(map(tuple, i.as_index().postings.select(*by, "chunk_id", "term", "tf").collect())) == sorted(map(tuple, fresh.postings.select(*by, "chunk_id", "term", "tf").collect()))
            assert sorted((r.chunk_id, r.dl) for r in i.live().collect()) == sorted((r.chunk_id, r.dl) for r in fresh.stats.collect())
            want = {(*[r[c] for c in by], r.term): (r.df, round(r.idf, 9)) for r in bm25.term_stats(fresh).collect()}
            assert {(*[r[c] for c in by], r.term): (r.df, round(r.idf, 9)) for r in i.term_stats().collect()} == want
            assert ranks(i.top_k(queries, 7), by) == ranks(bm25.top_k(bm25.scores(fresh, queries), 7, score="raw", by=by), by)
    want = ranks(bm25.top_k(bm25.normalised(fresh, queries), 5, 0.2, by=by), by, "score")
    assert ranks(index.normalised_top_k(queries, 5, 0.2), by, "score") == want
    keep = as_chunks(spark, docs).where("doc_id % 3 = 0")
    for way in (lambda: index.top_k(queries, 5, keep=keep), lambda: index.top_k(queries, 5, keep=keep, most_terms=1)):
        assert ranks(way(), by) == ranks(bm25.top_k(bm25.scores(fresh, queries), 5, score="raw", keep=keep, by=by), by)


def test_blocks_are_skipped(spark, tmp_path, sf_dir, monkeypatch):
    """On the test documents fewer blocks are read than the asked terms have, and the result is that of the whole search."""
    monkeypatch.setattr(postings, "BLOCK", 16)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("page_content"))
    index = Segments(spark, str(tmp_path / "i"))
    index.add(docs)
    asked = spark.createDataFrame([(1, "the and thon Heri ation"), (2, "und das achberach")], "query_id int, query_text string")
    reach = index.plan(asked, 10)[0]
    assert 0 < reach.where("read").count() < reach.count()
    assert ranks(index.top_k(asked, 10), ()) == ranks(bm25.top_k(bm25.scores(bm25.build(docs), asked), 10, score="raw"), ())


def test_frequent_terms_and_odd_rows(spark, tmp_path):
    """Terms of over half of all chunks weigh a quarter of the mean, here less than nothing; null texts, empty ones and long ones; an empty delivery."""
    docs = {("a", d): ["x y" + " z" * (d % 4) + (f" r{d}" if d % 9 == 0 else "")] for d in range(40)} | {("a", 40): [None], ("a", 41): [""], ("a", 42): ["x " * 300_000 + "q"]}
    index = Segments(spark, str(tmp_path / "i"))
    index.add(as_chunks(spark, docs))
    index.add(as_chunks(spark, docs).limit(0))
    asked = spark.createDataFrame([(1, "x z r9 r9"), (2, "x"), (3, "q y")], "query_id int, query_text string")
    fresh = bm25.build(as_chunks(spark, docs))
    assert ranks(index.top_k(asked, 6), ()) == ranks(bm25.top_k(bm25.scores(fresh, asked), 6, score="raw"), ())
    assert ranks(index.normalised_top_k(asked, 6), (), "score") == ranks(bm25.top_k(bm25.normalised(fresh, asked), 6), (), "score")


def test_negative_weights(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 2)
    docs = {("a", d): ["x y" + (" z" if d % 5 else "") + " x" * (d % 3)] for d in range(30)}
    index = Segments(spark, str(tmp_path / "i"))
    index.add(as_chunks(spark, docs))
    asked = spark.createDataFrame([(1, "x z"), (2, "y")], "query_id int, query_text string")
    fresh = bm25.build(as_chunks(spark, docs))
    assert min(r.idf for r in bm25.term_stats(fresh).collect()) < 0
    assert ranks(index.top_k(asked, 6), ()) == ranks(bm25.top_k(bm25.scores(fresh, asked), 6, score="raw"), ())


def test_lists_of_any_size(spark, tmp_path, monkeypatch):
    """Postings that leave a map task in many small lists make the same index."""
    monkeypatch.setattr(postings, "HELD", 7)
    monkeypatch.setattr(postings, "BLOCK", 4)
    rnd = random.Random(8)
    chunks = as_chunks(spark, {("ab"[d % 2], d): [words(rnd, 12)] for d in range(40)})
    index = Segments(spark, str(tmp_path / "i"), ("collection",))
    index.add(chunks)
    rows = index.table("blocks").select("collection", "term", F.inline(F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("tfs").alias("tf"))))
    assert sorted(map(tuple, rows.collect())) == sorted((r.collection, r.term, r.chunk_id, r.tf) for r in bm25.build(chunks, by=("collection",)).postings.collect())


def left_over(spark, work):
    """Bytes of shuffle files that work() leaves."""
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark._jvm.System.gc()
    left = lambda: sum(f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(tracker.getAllFiles()) if f.getName().startswith("shuffle_") and f.exists())
    before = left()
    work()
    return max(0, left() - before)


def kept_index(spark, sf_dir, path):
    """All documents with their texts reversed, then as they are but for the seventh part, which stays reversed; then without German ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "doc_id", F.col("doc_id").alias("chunk_id"), F.col("text").alias("page_content"))
    old = docs.withColumn("page_content", F.reverse("page_content"))
    new = docs.withColumn("page_content", F.when(F.col("doc_id") % 7 == 0, F.reverse("page_content")).otherwise(F.col("page_content")))
    index = Segments(spark, path)
    index.add(old)
    index.add(new)
    index.add(docs.limit(0), removed=docs.where("lang = 'de'").select("doc_id"))
    return index, new.where("lang <> 'de'")


def test_a_merge_leaves_no_shuffle_files(spark, tmp_path, sf_dir):
    """what a merge and the deliveries before it shuffle is gone with each step, and the merged index is a fresh one of what is left."""
    made = {}
    assert left_over(spark, lambda: made.update(i=kept_index(spark, sf_dir, str(tmp_path / "i")))) < 100_000
    (index, left) = made["i"]
    assert left_over(spark, lambda: made.update(m=index.merge(str(tmp_path / "m")))) < 100_000
    fresh = bm25.build(left)
    assert sorted(map(tuple, made["m"].term_stats().select("term", "df").collect())) == sorted(map(tuple, bm25.term_stats(fresh).select("term", "df").collect()))


def test_places_of_rows(spark, tmp_path):
    """rows of files are found by their places, in any file, bit and bitmap, and no others."""
    path = str(tmp_path / "t")
    spark.range(0, 100_000, 1, 3).write.parquet(path)
    rows, index = spark.read.parquet(path), Segments(spark, str(tmp_path / "i"))
    asked = Segments._placed(rows).where("id % 7 = 0 or id in (0, 1, 8, 33332, 33333, 32767, 32768, 99999)").select("_file", "_row")
    want = {i for i in range(100_000) if i % 7 == 0 or i in (0, 1, 8, 33332, 33333, 32767, 32768, 99999)}
    assert {r.id for r in index._at(rows, asked).collect()} == want
    assert {r.id for r in index._at(rows, asked, there=False).collect()} == set(range(100_000)) - want
    assert index._at(rows, asked.limit(0)).count() == 0 and index._at(rows, asked.limit(0), there=False).count() == 100_000


def test_parts_of_any_size(spark, tmp_path, monkeypatch):
    """F2: an index in many parts, some of them cut in several goes, has each posting once, and a term's parts by falling score."""
    for name, value in (("HELD", 500), ("PART", 60), ("LEAST", 1), ("BLOCK", 4)):
        monkeypatch.setattr(postings, name, value)
    rnd = random.Random(3)
    chunks = as_chunks(spark, {("ab"[d % 2], d): [words(rnd, 12)] for d in range(300)})
    index = Segments(spark, str(tmp_path / "i"), ("collection",))
    index.add(chunks)
    blocks = index.table("blocks")
    assert blocks.select(F.expr("block >> 33")).distinct().count() > 10
    rows = blocks.select("collection", "term", F.inline(F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("tfs").alias("tf"))))
    assert sorted(map(tuple, rows.collect())) == sorted((r.collection, r.term, r.chunk_id, r.tf) for r in bm25.build(chunks, by=("collection",)).postings.collect())

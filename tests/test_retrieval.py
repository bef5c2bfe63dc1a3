import dataclasses
import math
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspark import queries
from quillspark.operators import bm25, catalog, chunking, hybrid, vectors
from quillspark.plans import retrieval
from quillspark.streaming import ingest


def legs(spark):
    w = spark.createDataFrame([("1", 0.8), ("2", 0.6)], "chunk_id string, score double").withColumn("query_id", F.lit(1))
    v = spark.createDataFrame([("3", 0.9), ("2", 0.7)], "chunk_id string, score double").withColumn("query_id", F.lit(1))
    return w, v


@pytest.mark.parametrize("weights,threshold,want", [((0.3, 0.7), 0.0, {"2": 0.67, "3": 0.63, "1": 0.24}), ((0.7, 0.3), 0.0, {"2": 0.63, "1": 0.56, "3": 0.27}), ((0.3, 0.7), 0.3, {"2": 0.67, "3": 0.63}), ((0.3, 0.7), 0.75, {})])
def test_fusion(spark, weights, threshold, want):
    got = {r.chunk_id: round(r.hybrid_score, 6) for r in hybrid.fuse(*legs(spark), *weights, threshold).collect()}
    assert got == want


def test_fusion_over_collections(spark):
    w, v = legs(spark)
    a = hybrid.fuse(w, v, threshold=0.0).withColumn("collection", F.lit("a"))
    rows = hybrid.over_collections(a.unionByName(a.withColumn("collection", F.lit("b"))), {"b": 2.0}, threshold=0.0, top_k=6).orderBy("rank").collect()
    assert rows[0].collection == "b" and rows[0].score == 1.0 and rows[-1].score == 0.0


def test_bm25_by_hand(spark):
    texts = {1: "a b a", 2: "b c", 3: "d", 4: "a d"}
    index = bm25.build(spark.createDataFrame(list(texts.items()), "chunk_id int, page_content string"))
    got = {r.chunk_id: r.raw for r in bm25.scores(index, spark.createDataFrame([(1, "A c c")], "query_id int, query_text string")).collect()}
    n, avg = 4, 8 / 4
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in {"a": 2, "b": 2, "c": 1, "d": 2}.items()}
    part = lambda t, tf, dl: raw[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = {1: part("a", 2, 3), 2: 2 * part("c", 1, 2), 4: part("a", 1, 2)}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    bigger = bm25.append(index, spark.createDataFrame([(4, "a d"), (5, "e")], "chunk_id int, page_content string"))
    assert bigger.stats.count() == 5


def test_every_term_has_statistics(spark, sf_dir):
    got = queries.term_stats(spark, sf_dir)
    assert set(got.columns) == {"term", "df", "idf"} and got.count() == got.select("term").distinct().count() > 10_000


@pytest.mark.parametrize("by", [(), ("collection",)])
def test_searches_without_an_index_of_all_terms(spark, by):
    """Only asked terms are counted and the others' frequencies summed, with the scores of the stored form; postings of all terms are not made."""
    rng = random.Random(3)
    rows = [("xy"[i % 2], i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    index = bm25.build(spark.createDataFrame(rows, "collection string, chunk_id int, page_content string"), by=by)
    asked = spark.createDataFrame([(1, "a bb a"), (2, "h zz"), (3, "aa b c dd e f g h")], "query_id int, query_text string")
    key = lambda df, c: sorted((r.query_id, r.chunk_id, round(r[c], 9)) for r in df.collect())
    plain = dataclasses.replace(index, texts=None)
    assert key(bm25.scores(index, asked), "raw") == key(bm25.scores(plain, asked), "raw") == key(bm25.scores(index, asked, most_terms=1), "raw")
    assert key(bm25.normalised(index, asked), "score") == key(bm25.normalised(plain, asked), "score")
    assert "MapInArrow" not in bm25.normalised(index, asked)._jdf.queryExecution().toString()
    counts = Counter((r.chunk_id, r.term, r.tf) for r in index.postings.collect())
    assert counts == Counter((i, t, n) for _, i, x in rows for t, n in Counter(x.split()).items())


def test_chunking(spark):
    docs = spark.createDataFrame([(1, ""), (2, "   "), (3, None), (4, "A"), (5, "CHAPTER 1\n\ntext one, here.\n# two\nCHAPTER 2\nlast, words."), (6, "\n\n".join(f"paragraph {i}, " + "word " * 60 for i in range(80))), (7, "word. " * 3000)], "doc_id int, page_content string")
    rows = chunking.with_metadata(chunking.chunk_documents(docs)).orderBy("doc_id", "chunk_index").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {4, 5, 6, 7}
    assert [(r.section_level, r.strategy) for r in by[5]] == [(4, "hierarchical"), (3, "hierarchical")]
    assert all(r.strategy == "semantic" and r.token_count <= 1100 for r in by[6])
    assert all(r.token_count <= 768 for r in by[7]) and len(by[7]) > 5  # pieces are estimated one by one, rounded down


def test_sections_fold(spark):
    text = "intro, text\n\n# a\nx, y\n# b\nCHAPTER 1\nz, z\n# deep\nend, end"
    rows = chunking.sections(spark.createDataFrame([(1, text)], "doc_id int, page_content string")).orderBy("section").collect()
    assert [r.content for r in rows] == ["intro, text\n", "# a\nx, y", "# b\nCHAPTER 1\nz, z", "# deep\nend, end"]
    assert [r.section_level for r in rows] == [None, 3, 3, 3]


def test_vector_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0])], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, query_embedding array<double>")
    got = [(r.chunk_id, round(r.score, 6)) for r in vectors.search(v, q, 2, 0.1).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, 0.707107)]
    assert [r.chunk_id for r in vectors.search_one(v, [2.0, 0.0], 2, 0.1).collect()] == [1, 3]
    assert [(r.chunk_id, round(r.score, 6)) for r in vectors.search(v, q, 2, 0.1, most_bytes=0).orderBy("rank").collect()] == got


@pytest.mark.parametrize("threshold", [None, 0.2])
def test_vector_search_against_brute_force(spark, threshold):
    rng = random.Random(5)
    rows = [(i, "ab"[i % 2] if i % 7 else None, [float(rng.randint(-2, 2)) for _ in range(3)] if i % 9 else None) for i in range(200)]  # many ties
    queries = [(f"q{j}", [float(rng.randint(-2, 2)) for _ in range(3)]) for j in range(6)]
    v = spark.createDataFrame(rows, "chunk_id int, collection string, embedding array<float>").repartition(3)
    q = spark.createDataFrame(queries, "query_id string, query_embedding array<double>")
    norm = lambda x: math.sqrt(sum(a * a for a in x))
    want = set()
    for name, y in queries:
        for g in ("a", "b", None):
            own = [(round(sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y), 9), i) for i, c, x in rows if c == g and x and norm(x) and norm(y)]
            own = sorted([(-s, i) for s, i in own if threshold is None or s >= threshold])[:4]
            want |= {(name, g, i, r + 1) for r, (_, i) in enumerate(own)}
    for most in (64 << 20, 0):
        got = vectors.search(v, q, 4, threshold, by=("collection",), most_bytes=most).collect()
        assert {(r.query_id, r.collection, r.chunk_id, r["rank"]) for r in got} == want


def test_stored_index(spark, tmp_path):
    chunks = spark.createDataFrame([("x", 1, "a b a"), ("x", 2, "b c"), ("y", 1, "a"), ("y", 3, "")], "collection string, chunk_id int, page_content string")
    index = bm25.build(chunks, by=("collection",))
    bm25.save(index, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "a c")], "query_id int, query_text string")
    hits = lambda i: {(r.collection, r.chunk_id, round(r.raw, 9)) for r in bm25.scores(i, asked).collect()}
    loaded = bm25.load(spark, str(tmp_path / "i"), ("collection",))
    assert hits(loaded) == hits(index) and len(hits(index)) == 3
    one = {(c, r.chunk_id, round(r.raw, 9)) for c in "xy" for r in bm25.scores(bm25.build(chunks.where(F.col("collection") == c)), asked).collect()}
    assert hits(index) == one
    changed = bm25.update(index, spark.createDataFrame([("x", 1, "d")], chunks.schema))
    assert {r.term for r in changed.postings.where("collection = 'x'").collect()} == {"b", "c", "d"} and changed.stats.count() == 4


def test_document_index(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, None, 8, 3, 100]], "doc_id long").repartition(3)
    got = sorted((r.document_index, r.doc_id) for r in chunking.with_document_index(df, parts=3).collect())
    assert got == [(0, None), (1, 3), (2, 3), (3, 5), (4, 8), (5, 100)]
    assert chunking.with_document_index(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_recursive_split(seed):
    """Nothing is lost or made up and pieces come in order; with an overlap each piece begins within the one before, or where it ends."""
    rng = random.Random(seed)
    text = "".join(rng.choice(["word", "từ", "x" * 40, " ", " ", ".", "\n", "\n\n", "\n\n\n", "。", ";", "12"]) for _ in range(800))
    plain = lambda t: "".join(t.split())
    none = chunking.ChunkConfig(chunk_size=30, chunk_overlap=0)
    assert "".join(map(plain, chunking.split_recursively(text, none))) == plain(text)
    config = chunking.ChunkConfig(chunk_size=30, chunk_overlap=10)
    at, whole = 0, plain(text)
    for p in map(plain, chunking.split_recursively(text, config)):
        ends = [s + len(p) for s in range(max(0, at - 400), at + 1) if whole.startswith(p, s) and s + len(p) > at]
        assert ends
        at = min(ends)
    assert at == len(whole)


def test_nothing_is_doubled_without_overlap():
    """Marks that count as no tokens before and after a cut."""
    config = chunking.ChunkConfig(chunk_size=12, chunk_overlap=0, min_chunk_size=1)
    text = " ".join(f"{'word' * (i % 5 + 2)}{'!' * (i % 4)}?" for i in range(200))
    for cut in (chunking.split_recursively, chunking.simple_pieces):
        assert "".join("".join(cut(text, config)).split()) == "".join(text.split())


def test_small_pieces_join():
    config = chunking.ChunkConfig(chunk_size=5, chunk_overlap=0, min_chunk_size=12, max_chunk_size=60)
    joined = chunking.simple_pieces("alpha beta gamma delta epsilon zeta\n\nab", config)
    assert joined[-1].endswith("\nab") and len(joined[-1]) > 12
    dropped = chunking.ChunkConfig(min_chunk_size=50, keep_small_chunks=False)
    assert chunking.simple_pieces("short", dropped) == [] and chunking.simple_pieces("short", chunking.ChunkConfig()) == ["short"]


def test_chunk_text():
    rows = chunking.chunk_text("CHAPTER 1\ntext one, here.\nCHAPTER 2\nlast, words.", metadata={"a": 1})
    assert [(r["metadata"]["strategy"], r["metadata"]["chunk_index"], r["metadata"]["a"]) for r in rows] == [("hierarchical", 0, 1), ("hierarchical", 1, 1)]
    assert chunking.chunk_text(" ") == [] and chunking.chunk_text(None) == []


def test_estimate_as_columns(spark):
    texts = ["", "abc", "123", "Xin chào, tôi là trợ lý", "ĐÀ NẴNG đẹp", "naïve café", "mostly plain english with one ạ in it " * 3, "日本", "ÀÁ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from quillspark.functions import text as T

    for t, n, kind in df.select("t", T.estimated_tokens(F.col("t")), T.structure(F.col("t"))["structure_type"]).collect():
        assert (chunking.estimate(t), chunking.structure_type(t)) == (n, kind), t


def test_ingest_and_search(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat, happily"), (2, "dogs bark at night, loudly"), (3, "rain falls softly, again")], "doc_id long, page_content string")
    e = vectors.HashEmbedder(32)
    chunks = retrieval.ingest(docs, "c", e)
    q = spark.createDataFrame([(1, "cat mat", [float(x) for x in e.encode(["query: cat mat"])[0]])], "query_id int, query_text string, query_embedding array<double>")
    rows = retrieval.search(chunks, q, threshold=0.0, vector_threshold=0.0).collect()
    best = min(rows, key=lambda r: r.rank)
    assert best.chunk_id == chunks.where("doc_id = 1").head().chunk_id
    found = retrieval.with_content(retrieval.search(chunks, q, threshold=0.0, vector_threshold=0.0), chunks).orderBy("rank").head()
    assert found.content == "the cat sat on the mat, happily" and found.metadata["doc_id"] == "1" and found.collection_name == "c"
    assert retrieval.check_index(None) == (False, "there is no index") and retrieval.check_index(bm25.build(chunks))[0]


def test_what_an_index_is(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, "1", "x y")], "collection string, doc_id int, chunk_id string, page_content string")
    plain, many, stored_index = bm25.build(chunks), bm25.build(chunks, by=("collection",)), ingest.Segments(spark, str(tmp_path / "i"), ("collection",))
    assert retrieval.check_index(stored_index, ["a"]) == (False, "the index is empty")
    stored_index.add(chunks)
    assert retrieval.check_index(stored_index, ["a"]) == retrieval.check_index(plain) == (True, "")
    assert retrieval.check_index(many) == (False, "no collection is named") and not retrieval.check_index("x")[0]
    assert retrieval.describe_index(stored_index) == {"type": "Segments", "is_stored": True, "is_multi_collection": True, "has_chunks": True}
    assert retrieval.describe_index(plain)["is_multi_collection"] is False and retrieval.describe_index(None) == {"type": "NoneType", "is_stored": False, "is_multi_collection": False, "has_chunks": False}
    c = catalog.Collections(spark, str(tmp_path / "c"))
    assert retrieval.chunks_of(c) is None
    c.add("kb", chunks.drop("collection"))
    assert retrieval.chunks_of(c).count() == retrieval.chunks_of(c, "kb").count() == 1 and retrieval.chunks_of(c, "other") is None


def test_process_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a.txt": "the cat sat on the mat, happily", "b.md": "dogs bark at night, loudly"}.items():
        (tmp_path / "in" / name).write_text(text)
    c = catalog.Collections(spark, str(tmp_path / "c"))
    for _ in range(2):  # again: the same ids, replaced
        ids = retrieval.process_files(spark, str(tmp_path / "in"), c, "kb", vectors.HashEmbedder(8), extra={"source_file": "given"})
        assert ids.count() == 2
    rows = c.read("kb").collect()
    assert len(rows) == 2 and {r.source_file for r in rows} == {"given"} and {r.file_extension for r in rows} == {".txt", ".md"}


def test_stream_takes_each_chunk_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words, here"), (2, "other words, there")], "doc_id long, page_content string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.stream(spark, str(tmp_path / "in"), "doc_id long, page_content string", str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
        ingest.add_batch(docs, str(tmp_path / "index"))
    index = ingest.read_index(spark, str(tmp_path / "index"))
    assert index.stats.count() == 2 and index.postings.count() == 6


def test_stream_forgets_what_a_document_was(spark, tmp_path):
    """An edited text's old chunks go, an emptied document goes, and the index is that of the texts as they are."""
    at = {k: str(tmp_path / k) for k in ("in", "index", "cp")}
    texts = {1: "alpha beta, gamma", 2: "delta, words", 3: "stays, as it is"}
    for step in ({}, {1: "other beta, here", 2: ""}):
        spark.createDataFrame(list((step or texts).items()), "doc_id long, page_content string").coalesce(1).write.mode("append").parquet(at["in"])
        ingest.stream(spark, at["in"], "doc_id long, page_content string", at["index"], at["cp"]).awaitTermination()
        texts |= step
    chunks = ingest.read_chunks(spark, at["index"])
    assert {(r.doc_id, r.page_content) for r in chunks.collect()} == {(1, texts[1]), (3, texts[3])}
    fresh, index = bm25.build(chunks), ingest.read_index(spark, at["index"])
    assert sorted(map(tuple, index.postings.select("chunk_id", "term", "tf").collect())) == sorted(map(tuple, fresh.postings.select("chunk_id", "term", "tf").collect()))
    index = ingest.Segments(spark, at["index"])
    assert len(index.deliveries()) == 2 and index.merge(str(tmp_path / "m")).live().count() == 2
    docs = spark.createDataFrame([(9, "new, words")], "doc_id long, page_content string")
    for _ in range(2):
        ingest.add_batch(docs, at["index"], delivery="by hand")
    assert len(index.numbers()) == 3


def test_changes_leave_other_files_alone(spark, tmp_path):
    """An upsert and deletes rewrite the buckets that they touch; all other files keep their names; new columns are null in old rows."""
    c = catalog.Collections(spark, str(tmp_path / "c"), buckets=8)
    rows = {f"k{i}": i for i in range(200)}
    c.add("a", spark.createDataFrame(list(rows.items()), "chunk_id string, page int"))

    def files():
        return {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet")}

    bucket = {r.chunk_id: r.b for r in spark.createDataFrame([(k,) for k in [*rows, "new"]], "chunk_id string").select("chunk_id", c._bucket("chunk_id").alias("b")).collect()}
    for change, keys in (
        (lambda: c.put("a", spark.createDataFrame([("k3", 1000, "x"), ("new", 7, "y")], "chunk_id string, page int, note string")), ["k3", "new"]),
        (lambda: c.delete("a", spark.createDataFrame([("k5",), ("absent",)], "chunk_id string")), ["k5"]),
        (lambda: c.delete("a", conditions={"page": 11}), ["k11"]),
    ):
        before = files()
        change()
        gone = {f for f in before - files()}
        assert {int(f.split("bucket=")[1].split("/")[0]) for f in gone} == {bucket[k] for k in keys}
    rows |= {"k3": 1000, "new": 7}
    del rows["k5"], rows["k11"]
    assert {r.chunk_id: r.page for r in c.read("a").collect()} == rows
    assert {r.note for r in c.read("a").where("chunk_id in ('k3', 'k4', 'new')").collect()} == {"x", None, "y"}


def test_row_groups_are_skipped_for_every_field(spark, tmp_path):
    """With a Z-order key a filter on the second and on the third field reads fewer row groups than all, also after an upsert."""
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("chunk_id"), *[F.concat(F.lit("v"), F.lpad(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(60)).cast("string"), 2, "0")).alias(f) for i, f in enumerate(catalog.ZORDERED)], F.sha2(F.col("id").cast("string"), 256).alias("page_content"))
    c = catalog.Collections(spark, str(tmp_path / "c"), buckets=1, row_group_bytes=16 << 10)
    c.add("a", rows)
    c.put("a", rows.where("chunk_id < '11'"))

    def groups(field, value):
        hit = every = 0
        for f in tmp_path.rglob("*.parquet"):
            meta = pq.ParquetFile(f).metadata
            at = meta.schema.names.index(field)
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                every, hit = every + 1, hit + (stats.min <= value <= stats.max)
        return hit, every

    for f in catalog.ZORDERED:
        hit, every = groups(f, "v30")
        assert every > 10 and 0 < hit <= 0.6 * every, (f, hit, every)
    assert c.read("a").count() == 20_000


def test_pages_after_a_cursor(spark):
    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, kind long")
    got, at = [], None
    while True:
        part = catalog.page_after(df, ["kind", "id"], at, 9).collect()
        if not part:
            break
        got, at = got + [(r.id, r.kind) for r in part], [part[-1].kind, part[-1].id]
        df = df.union(spark.createDataFrame([(1000 + len(got), None)], df.schema)) if at[0] is not None else df  # a row before the cursor moves nothing
    assert got == sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    with pytest.raises(ValueError):
        catalog.page_after(df, ["id"], limit=101)


def test_collections_and_tables(spark, tmp_path):
    c = catalog.Collections(spark, str(tmp_path / "c"))
    assert c.create("a") and not c.create("a") and c.names() == ["a"] and c.missing(["a", "b"]) == ["b"]
    c.add("a", spark.createDataFrame([("x", 1), ("y", 2)], "chunk_id string, page int"))
    assert c.read("a", "zzz").count() == 2
    assert c.delete("a") and c.delete("a", conditions={"page": 2}) and [r.chunk_id for r in c.read("a").collect()] == ["x"]
    ids = c.put("a", spark.createDataFrame([("x", 7), ("z", 3), ("z", 3)], "chunk_id string, page int"))
    assert sorted(r[0] for r in ids.collect()) == ["x", "z"] and {(r.chunk_id, r.page) for r in c.read("a").collect()} == {("x", 7), ("z", 3)}
    assert [r[0] for r in c.known_ids("a", spark.createDataFrame([("x",), ("q",), ("x",)], "chunk_id string")).collect()] == ["x"]
    assert c._store("a").claim("_writing") and c.read("a").count() == 2  # a writer is at it, or broke off: readers aren't disturbed
    for change in (lambda: c.delete("a", conditions={"page": 3}), lambda: c.put("a", c.read("a").drop("collection")), lambda: c.add("a", c.read("a").drop("collection"))):
        with pytest.raises(catalog.Conflict):
            change()
    c.release("a")
    assert c.delete("a", conditions={"page": 3}) and c.read("a").count() == 1
    assert c.delete("a", conditions={"page": 7}) and c.read("a").count() == 0
    assert c.drop("a") and c.names() == [] and c.read().count() == 0
    assert catalog.bootstrap(spark, str(tmp_path / "c")).names() == ["default"]
    store = catalog.Store(spark, str(tmp_path / "s"))
    store.put("k/x.bin", b"\x00\xffa")
    assert store.get("k/x.bin") == b"\x00\xffa" and store.names("k") == ["x.bin"] and store.remove("k/x.bin") and store.get("k/x.bin") is None
    kv = catalog.KeyValueTable(spark, str(tmp_path / "kv"), "id string, name string, n int", "id")
    kv.put(spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], kv.schema))
    kv.put(spark.createDataFrame([("2", "c", 3)], kv.schema))
    kv.patch("1", name="z", n=None)
    assert {tuple(r) for r in kv.read().collect()} == {("1", "z", 1), ("2", "c", 3)}
    kv.drop(F.col("id") == "1")
    assert kv.get("1").isEmpty() and kv.read().count() == 1


def test_workers_hold_small_batches(spark):
    """Texts go to Python in batches of some MB, whatever the session's default."""
    from quillspark.operators import chunking, vectors

    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
    rows = spark.range(1500).selectExpr("id as doc_id", "concat('text ', id) as page_content").coalesce(1)
    for make in (lambda: chunking.chunk_documents(rows), lambda: vectors.embed(rows, vectors.HashEmbedder(8))):
        for k in keys:
            spark.conf.unset(k)
        found = make()
        assert all(int(spark.conf.get(k).rstrip("b")) <= most for k, most in keys.items())
        assert found.count() == 1500


def test_vectors_are_made_some_at_a_time(spark):
    """No more than HELD vectors are made before the first of them leave; all come, in their order."""
    import os

    from quillspark.operators import vectors

    class Counting:
        dimension = 2

        def encode(self, texts):
            self.made = getattr(self, "made", 0) + len(texts)
            return [[float(self.made), float(os.getpid() > 0)] for _ in texts]

    rows = spark.range(1000).selectExpr("id", "concat('text ', id) as page_content").coalesce(1)
    got = vectors.embed(rows, Counting(), batch=10).orderBy("id").collect()
    assert [r.embedding[0] for r in got] == [10.0 * (i // 10 + 1) for i in range(1000)]
    assert vectors.HELD < 1000 and vectors.embed(rows.limit(0), Counting()).count() == 0

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing, token_binary, token_counts
from quillspark.llm.tokens import default_path, word_ids

PATH = default_path("word_bpe_49k.json")
ODD = ["<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "İstanbul ΣΑΣ ΣΑΣ. a\x1cb \x85 x　y z", "don't DON'T I'LL. 12.5% été, क़ क़.", "a b ́x .́", " ", "", "日本語テキスト。 한국어! naïve-ish", "ẞtraße ǅ Ⅷ ² x².", "x$$$ a.b.c e@f.gh 1.2.3 \"Q\"", "\x0bv\x0cf\r\n", "i̇. İ. İ"]
DOCS = [(3, "Some words, here."), (1, None), (2, ""), (None, "null id"), (5, "same"), (5, "same"), (5, "other"), (4, "long words " * 5000), *((10 + i, t) for i, t in enumerate(ODD))]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in DOCS], "doc_id long, text string, ids string, start double")


def test_words_give_what_whole_texts_give(library, spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300).collect()]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in word_ids(PATH).encode_many(pa.array([*texts, None]))]
        assert got == [library(t) for t in [*texts, None]]


def test_shards_round_trip(spark, docs, library, tmp_path):
    out = token_binary.token_digests(docs, str(tmp_path / "t"), PATH).collect()
    want = {}
    for i, t in DOCS:
        ids = np.array([*library(t), 2], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    start = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ordered = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert ordered[0] is None and ordered[1:] == sorted(ordered[1:])


def test_shards_name_their_dictionary(spark, docs, tmp_path):
    dictionary = token_binary.write_tokens(docs, str(tmp_path / "t"), PATH, shard_bytes=200)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(str(tmp_path / "t/shards")).collect()
    assert len(files) > 1, "a shard is closed when it has enough bytes"
    width, index = token_binary.read_index(bytes(files[0].content), dictionary)
    assert width == 2 and token_binary.read_documents(bytes(files[0].content), index[:1], width, dictionary)
    with pytest.raises(ValueError):
        token_binary.read_index(bytes(files[0].content), dictionary + b"x")


def test_count_cache(spark, docs, tmp_path):
    import sentencepiece

    path, cache = default_path("piece_bpe_32k.model"), str(tmp_path / "cache")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in DOCS), key=str)
    for _ in range(2):
        got = token_counts.count_tokens(docs, cache, path).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in DOCS})
    token_counts.count_tokens(docs.limit(0), cache, PATH).collect()
    assert token_counts.count_tokens(docs.limit(0), str(tmp_path / "new"), path).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64, 8), packing.Limits(100, 50, 30, 1)])
def test_packing(spark, docs, library, limits):
    rows = packing.pack_documents(docs.withColumn("lead", docs.doc_id % 7), PATH, 1, limits, "lead").collect()
    ids = {}
    for r in rows:
        piece = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(piece) == r.length > 0
        ids.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, piece))
    want = sorted((str(i), len(library(t)) + 1) for i, t in DOCS)
    assert sorted({(str(i), n) for i, n in ids}) == sorted(set(want))
    for i, t in DOCS:
        whole = [*library(t), 1]
        copies = sum(1 for j, u in DOCS if j == i and len(library(u)) == len(library(t)))
        parts = sorted(ids[i, len(whole)])
        assert sum(len(p) for _, p in parts) == len(whole) * copies
        if copies == 1:
            assert [x for _, p in parts for x in p] == whole
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for some in by.values():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == list(np.cumsum([0, *(r.length for r in some)])[:-1])
        assert sum(r.length for r in some) <= limits.tokens and len(some) <= limits.segments and sum(r.loss_tokens for r in some) <= limits.loss_tokens


@pytest.mark.parametrize("limits", [packing.Limits(64, 1000, 1000, 1), packing.Limits(100_000, 2, 100_000, 1), packing.Limits(100_000, 1000, 20, 1)])
def test_each_limit_binds_alone(spark, docs, limits):
    rows = packing.pack_documents(docs.coalesce(1), PATH, 1, limits, lead_share=0.5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    used = [(sum(r.length for r in x), len(x), sum(r.loss_tokens for r in x)) for x in by.values()]
    allowed = (limits.tokens, limits.segments, limits.loss_tokens)
    assert all(u <= a for one in used for u, a in zip(one, allowed, strict=True))
    tight = min(range(3), key=lambda i: allowed[i])
    assert max(one[tight] for one in used) == allowed[tight]
    whole = {(r.doc_id, r.doc_tokens) for r in rows}
    assert all(sum(r.loss_tokens for r in rows if (r.doc_id, r.doc_tokens) == k) % (k[1] - k[1] // 2) == 0 for k in whole)


def test_dictionary_at_any_size_and_narrow_ids(spark, docs, tmp_path):
    few = spark.createDataFrame([(i, " ".join(f"word{(i * j) % 97}" for j in range(300))) for i in range(40)], "doc_id long, text string")
    dictionary = token_binary.write_tokens(few, str(tmp_path / "a"), PATH)
    assert dictionary[:4] == b"\x37\xa4\x30\xec", "a trained dictionary, not raw ids"
    long = spark.createDataFrame([(i, " ".join(f"word{(i * j) % 97}" for j in range(9000))) for i in range(40)], "doc_id long, text string")
    assert token_binary.write_tokens(long, str(tmp_path / "b"), PATH)[:4] == b"\x37\xa4\x30\xec"
    with pytest.raises(ValueError, match="fit"):
        token_binary.write_tokens(docs, str(tmp_path / "c"), PATH, width=1)


def test_packing_is_tight(spark, sf_dir):
    rows = packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1), PATH).select("sequence_id", "length").toPandas()
    assert rows.length.sum() / (2048 * rows.sequence_id.nunique()) > 0.99


def test_packing_empty(spark, docs, tmp_path):
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
    assert len(token_binary.token_digests(docs.limit(0), str(tmp_path / "t"), PATH).collect()) == 0


def test_known_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    """A delivery whose texts the cache has shuffles digests and counts alone; new ones among them, and copies, are still found."""
    import random

    rng, path, cache = random.Random(4), default_path("piece_bpe_32k.model"), str(tmp_path / "cache")
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=5000)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:50])]
    written = lambda: sum(e.totalShuffleWrite() for e in (some.apply(i) for some in [spark.sparkContext._jsc.sc().statusStore().executorList(False)] for i in range(some.size())))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), cache, path).collect()}
        before = written()
        more = spark.createDataFrame([*rows, (2000, "new text"), (2001, "new text")], "doc_id long, text string")
        again = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, cache, path).collect()}
        assert written() - before < sum(map(len, texts)) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert first == {i: again[i] for i in first} and again[2000] == again[2001]
    assert spark.read.parquet(cache).count() == len(texts) + 1

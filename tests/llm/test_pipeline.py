import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from quillspark.llm import quality_rules
from quillspark.llm.common import stored, table
from quillspark.llm.tokens import default_path


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, f in P.STAGES:
        docs = stored(f(spark, docs, sf_dir), "test")
        out.append((name, docs))
    return out


def test_stages(spark, sf_dir, stages):
    docs = table(spark, sf_dir, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    before = {r.doc_id for r in docs.collect()}
    for _, df in stages[:-1]:
        assert df.columns == docs.columns
        after = {r.doc_id for r in df.collect()}
        assert after <= before
        before = after
    ruled = {r.doc_id for r in stages[0][1].collect()}
    assert ruled == {r.doc_id for r in quality_rules.quality_rows(docs).where("kept").collect()}
    assert not [i for i in before if labels.get(i) == 0]
    texts = [r.text for r in stages[2][1].collect()]
    assert len(texts) == len(set(texts))


def test_packed_ids_are_the_texts(stages):
    t = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages[2][1].collect()}
    parts = {}
    for r in stages[3][1].collect():
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert set(parts) == set(texts)
    for i, some in parts.items():
        got = b"".join(p for _, p in sorted(some))
        assert zlib.crc32(got) == zlib.crc32(np.array([*t.encode(texts[i], add_special_tokens=False).ids, 1], "<u4").tobytes())


def whole(rows):
    """What is packed of each document, however it was cut: its ids' checksum, and that the pieces follow each other; sequences without gaps."""
    parts, sequences = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 2048
    return {i: zlib.crc32(b"".join(p for _, p in sorted(some))) for i, some in parts.items()}


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert whole(P.run(spark, sf_dir).collect()) == whole(stages[-1][1].collect())


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, empty texts, repeated rows and clashing names go through every stage; an empty table comes out empty."""
    docs = table(spark, sf_dir, "documents")
    more = ["_id", "_tag", "_score", "kept", "n_words", "sig"]
    some = docs.where("doc_id < 40").select("*", *[F.lit("x").alias(c) for c in more])
    odd = some.union(some.where("doc_id < 5")).union(some.limit(1).withColumn("text", F.lit(None).cast("string"))).union(some.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long"))).union(some.limit(1).withColumn("text", F.lit("")))
    for rows in (odd, odd.limit(0)):
        n = rows.count()
        for _, f in P.STAGES[:-1]:
            out = f(spark, rows, sf_dir)
            assert out.columns == odd.columns and out.count() <= n
        assert (P.STAGES[-1][1](spark, rows, sf_dir).count() > 0) == (n > 0)


@pytest.mark.parametrize("kind", ["int", "decimal(20,0)", "string"])
def test_classifier_on_ids_of_other_types(spark, tmp_path, kind):
    """Copies of the tables may have ids of another type; the same rows stay."""
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    kept = {}
    for k in ("long", kind):
        at = str(tmp_path / k[:3])
        docs.withColumn("doc_id", F.col("doc_id").cast(k)).write.parquet(f"{at}/documents.parquet")
        labels.withColumn("doc_id", F.col("doc_id").cast(k)).write.parquet(f"{at}/labels.parquet")
        rows = P.pass_classifier(spark, table(spark, at, "documents"), at)
        assert dict(rows.dtypes)["doc_id"] == k.replace("long", "bigint")
        kept[k] = {int(r.doc_id) for r in rows.collect()}
    assert kept[kind] == kept["long"]

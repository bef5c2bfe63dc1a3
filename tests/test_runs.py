"""Statistics within a job, results by digest, ranking over fields, word segmentation."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import segmentation as S
from quillspark.functions import text as T
from quillspark.operators import bm25, fields, postings, results, runs, vectors


def test_statistics_come_with_the_write(spark, tmp_path):
    """Metrics are observed by the job that writes; a reset of a run, or of all, hides what was before it and nothing later."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        made.add(1)
        return t

    rows = spark.createDataFrame([(1, "a b c", [1.0]), (2, "d", None), (3, None, [2.0])], "doc_id int, page_content string, embedding array<float>").coalesce(1)
    log = runs.Runs(spark, str(tmp_path / "log"))
    assert log.stats().head().total_documents_indexed == 0
    run = log.write(rows.withColumn("page_content", counted("page_content").alias("page_content")), str(tmp_path / "out"))
    assert made.value == 3  # each row was made once
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert {(r.metric, r.total) for r in log.metrics().collect()} == {("rows", 3.0), ("texts", 3.0), ("tokens", 4.0), ("vectors", 2.0), ("longest", 5.0)}
    other = log.write(rows.limit(1), str(tmp_path / "out"))
    log.timed("search", 4, 2.0)
    s = log.stats().head()
    assert (s.total_documents_indexed, s.total_searches_performed, s.avg_search_time_per_search) == (4, 4, 0.5)
    log.reset(run)
    assert log.stats().head().total_documents_indexed == 1 and log.stats(run).head().total_documents_indexed == 0
    log.reset()
    assert log.log().count() == 0 and log.stats(other).head().total_searches_performed == 0
    log.timed("search", 1, 1.0)
    assert log.stats().head().total_searches_performed == 1
    with pytest.raises(Exception, match="boom|raise"):
        log.write(rows.select(F.raise_error(F.lit("boom")).alias("page_content"), "embedding"), str(tmp_path / "bad"))
    assert log.log().count() == 1


def test_equal_texts_are_encoded_once(spark, tmp_path):
    class Slow(vectors.HashEmbedder):
        def encode(self, texts):
            with open(tmp_path / "calls", "a") as f:
                f.writelines(f"{len(t)}\n" for t in texts)
            return super().encode(texts)

    texts = ["one two", "one two", "three", None, "", "long " * 300, "three"] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, page_content string")
    plain = {r.id: [round(x, 6) for x in r.embedding] for r in vectors.embed(rows, vectors.HashEmbedder(16)).collect()}
    calls = lambda: sorted(map(int, open(tmp_path / "calls").read().split()))
    for more in (rows, rows.union(spark.createDataFrame([(99, "new")], rows.schema))):
        got = {r.id: [round(x, 6) for x in r.embedding] for r in results.embed(more, Slow(16), str(tmp_path / "r"), "slow").collect()}
        assert {i: got[i] for i in plain} == plain
    asked = {len(r.t) for r in rows.select(T.embedding_input(F.coalesce("page_content", F.lit(""))).alias("t")).collect()} | {len("passage: new")}
    assert calls() == sorted(asked)  # each text once over both runs
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, prompt string")
    said = {r.id: r.response for r in results.generate(prompts, lambda ps: [p.upper() for p in ps], str(tmp_path / "g"), "m").collect()}
    assert said == {1: "A", 2: "A", 3: None}


def test_ranking_over_fields_by_hand(spark):
    rows = [("t1", "diet plan", None, "a plan for diet and sleep"), ("t2", "sleep", "plan", "nothing of it"), ("t3", "x", "y", "z"), ("t4", "diet plan", None, "a plan for diet and sleep")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "id string, name string, description string, template string, chunk_id string")
    weights = {"name": 3.0, "description": 2.0, "template": 1.0}
    got = {(r.query_id, r.id): (r["rank"], round(r.score, 9)) for r in fields.search(df, spark.createDataFrame([(1, "Plan diet plan"), (2, "absent")], "query_id int, query_text string"), weights).collect()}
    words = lambda t: (t or "").lower().split()
    mean = [sum(len(words(r[i])) for r in rows) / 4 for i in (1, 2, 3)]
    want = {}
    for r in rows:
        score = 0
        for term in ("plan", "diet"):
            df_ = sum(any(term in words(x[i]) for i in (1, 2, 3)) for x in rows)
            f = sum(w * words(r[i]).count(term) / (0.25 + 0.75 * len(words(r[i])) / m) for i, w, m in zip((1, 2, 3), weights.values(), mean, strict=True))
            score += math.log(1 + (4 - df_ + 0.5) / (df_ + 0.5)) * f / (1.2 + f)
        if score:
            want[r[0]] = score
    order = sorted(want, key=lambda i: (-round(want[i], 9), i))
    assert got == {(1, i): (order.index(i) + 1, round(want[i], 9)) for i in want}
    joined = fields.search(df, spark.createDataFrame([(1, "Plan diet plan")], "query_id int, query_text string"), weights, most_terms=1)
    assert {(r.query_id, r.id): (r["rank"], round(r.score, 9)) for r in joined.collect()} == got


def test_cuts_are_the_cheapest():
    """Against all cuts of short runs of syllables, with random costs."""
    rnd = random.Random(5)
    for _ in range(300):
        run = [rnd.choice("abc") for _ in range(rnd.randint(0, 7))]
        cost = {" ".join(w): rnd.randint(1, 60) / 4 for n in (1, 2, 3) for w in itertools.product("abc", repeat=n) if rnd.random() < 0.4}
        price = lambda w: cost.get(" ".join(w), S.UNKNOWN if len(w) == 1 else math.inf)  # noqa: B023, E731
        every = []
        for cuts in itertools.product((0, 1), repeat=max(len(run) - 1, 0)):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)] if run else [0]
            every.append(sum(price(run[a:b]) for a, b in itertools.pairwise(at)))
        got = S.cheapest(run, cost, 3)
        assert [x for w in got for x in w] == run and sum(map(price, got)) == min(every)


def test_words_are_learned_and_cut_alike(spark, tmp_path):
    """Syllables that keep together become words; texts and queries are cut alike; others stay as they are."""
    rnd = random.Random(2)
    words, single = ["sinh viên", "đại học", "bệnh viện", "hợp tác xã"], ["tôi", "là", "ở", "có", "và", "đi"]
    texts = [" ".join(rnd.choice(words if rnd.random() < 0.4 else single) for _ in range(40)) + "." for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cost = S.costs(df)
    learned = {w for w in cost if " " in w}
    assert set(words) <= learned and not learned & {"là ở", "tôi là", "có và"}
    counts = sum(len(re.findall(r"(?<!\w)bệnh viện(?!\w)", t)) for t in texts)
    total = sum(len(t.rstrip(".").split()) for t in texts)
    assert cost["bệnh viện"] == pytest.approx(math.log(total / counts))
    cut = S.segmenter(cost)
    got = spark.createDataFrame([("Tôi là Sinh Viên đại học, 3.5 x.",), ("plain text",), (None,)], "t string").select(T.bm25_tokens(F.col("t"), cut).alias("w")).collect()
    assert got[0].w == ["tôi", "là", "sinh_viên", "đại_học", "3.5", "x"] and got[1].w == ["plain", "text"]
    chunks = df.select("doc_id", F.col("doc_id").alias("chunk_id"), F.col("text").alias("page_content"))
    asked = spark.createDataFrame([(1, "sinh viên bệnh viện")], "query_id int, query_text string")
    index = postings.Segments(spark, str(tmp_path / "i"))
    index.add(chunks, segment=cut)
    fresh = bm25.build(chunks, segment=cut)
    assert fresh.postings.where("term = 'sinh_viên'").count() > 0 and fresh.postings.where("term = 'viên'").count() == 0
    plain = bm25.top_k(bm25.scores(fresh, asked, segment=cut), 5, score="raw")
    key = lambda df: [(r["rank"], r.chunk_id, round(r.raw, 8)) for r in df.orderBy("rank").collect()]
    assert len(key(plain)) == 5 and key(index.top_k(asked, 5, segment=cut)) == key(plain)
    assert S.costs(df.limit(0)) == {} and S.split("", {}) == []


def test_all_words_have_costs(spark):
    """The table has every word, also where the dictionary of a segmenter ends."""
    texts = [" ".join(f"{a}{b}" for b in "abcdefgh" for _ in range(2)) for a in "abcdefgh" for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = {r.word: r.cost for r in S.cost_table(df).collect()}
    assert {w for w in table if " " not in w} == {a + b for a in "abcdefgh" for b in "abcdefgh"}
    assert all(c == pytest.approx(math.log(64)) for w, c in table.items() if " " not in w)
    few = S.costs(df, most_words=10)
    assert len(few) == 10 and all(table[w] == c for w, c in few.items()) and S.costs(df) == table

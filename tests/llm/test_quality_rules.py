import re

import pytest

from quillspark.llm import quality_rules as Q

ROWS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, "a b c d e " * 8), (5, "x# y$ z% " * 30), (5, "x# y$ z% " * 30), (None, "GO!! ON!! " * 40), (7, "same line here\nsame line here\n \nother\n"), (8, "long " + "word " * 50_000)]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    inside = [False] * len(words)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside[i : i + 5] = [True] * 5
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(inside)


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = Q.quality_rows(docs).collect()
    assert len(got) == len(ROWS)
    want = sorted(((i, *brute(t)) for i, t in ROWS), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_junk_goes_and_prose_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "label")
    rows = Q.quality_rows(docs).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.label == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.label == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_keep_good_keeps_all_columns_even_clashing_ones(spark):
    docs = spark.createDataFrame([(i, t, 2.5, True) for i, t in ROWS], "doc_id long, text string, n_words double, kept boolean")
    out = Q.keep_good(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in ROWS}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality_rows(docs).count() == 0 and Q.keep_good(docs).count() == 0


@pytest.mark.parametrize("text,want", [("a a a a a a", 6), ("a b c d", 0), ("a b c d e a b c d e", 10)])
def test_repeat_words(text, want):
    assert Q.repeat_words(text.split()) == want


@pytest.mark.parametrize("n", [4900, 5100, 60_000])
def test_long_salads_get_a_bad_vote_for_variety(spark, n):
    import random

    rng = random.Random(n)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    docs = spark.createDataFrame([(1, " ".join(rng.choices(vocabulary, k=n)))], "doc_id long, text string")
    assert Q.with_counts(docs).select(Q.rules()["variety"].alias("v")).head().v == 0


def test_em_by_hand():
    """The same model, row by row: what each row's votes say of its quality, then how often each rule votes how for either quality."""
    import random

    import numpy as np

    rng = random.Random(3)
    rows = []
    for _ in range(300):
        good = rng.random() < 0.8
        rows.append([2 if rng.random() < 0.5 else int(rng.random() < (0.97 if good else 0.2)) for _ in range(4)])
    patterns = sorted(set(map(tuple, rows)))
    weights = [rows.count(list(p)) for p in patterns]
    model = Q.fit(np.array(patterns), np.array(weights, dtype=float), rounds=40, tolerance=0)
    belief = {0: [0.30, 0.30, 0.40], 1: [0.001, 0.50, 0.499]}
    strength = {0: 1.0, 1: max(10.0, 0.1 * len(rows))}
    acc, prior = {(r, y): belief[y] for r in range(4) for y in (0, 1)}, 0.8

    def quality(votes):
        p = {0: 1 - prior, 1: prior}
        for r, v in enumerate(votes):
            for y in (0, 1):
                p[y] *= acc[r, y][v]
        return p[1] / (p[0] + p[1])

    for _ in range(40):
        q = [quality(v) for v in rows]
        new = {}
        for r in range(4):
            for y in (0, 1):
                seen = [sum((x if y else 1 - x) for x, v in zip(q, rows, strict=True) if v[r] == k) + belief[y][k] * strength[y] for k in range(3)]
                new[r, y] = [s / sum(seen) for s in seen]
        acc, prior = new, (sum(q) + 8) / (len(rows) + 10)
    assert abs(model.prior - prior) < 1e-9
    assert all(abs(model.posterior(np.array([p]))[0] - quality(p)) < 1e-9 for p in patterns)


def test_kept_is_what_the_posterior_says(spark, sf_dir):
    counts = Q.with_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 300"), keep=["doc_id"]).cache()
    model = Q.vote_model(counts)
    import numpy as np

    votes = {r.doc_id: [r[k] for k in Q.rules()] for r in counts.select("doc_id", *[v.alias(k) for k, v in Q.rules().items()]).collect()}
    for r in Q.judge(counts, model).collect():
        odds = np.prod([model.accuracy[i, 1, v] / model.accuracy[i, 0, v] for i, v in enumerate(votes[r.doc_id])]) * model.prior / (1 - model.prior)
        assert abs(r.quality - odds / (1 + odds)) < 1e-9 and r.kept == (not r.base_failed and r.quality >= 0.5)


def test_kept_columns_have_names_of_their_own(spark):
    df = spark.createDataFrame([(1, "some words", 7)], "doc_id long, text string, n_words int")
    assert Q.quality_rows(df).head().n_words == 2
    with pytest.raises(ValueError, match="n_words"):
        Q.quality_rows(df, keep=["doc_id", "n_words"])

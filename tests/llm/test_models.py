import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import quality_knn, queries, simhash, suffix_tree

ROWS = [(1, "The cat sat on the mat, the end."), (2, None), (3, ""), (4, "the cat sat on the mat"), (5, "The Cat sat"), (5, "other words here"), (None, "no id"), (6, "word " * 3000), (6, "word " * 3000), *((i, f"row {i} has the cat sat on the mat") for i in range(20, 40))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, trains int, score string")


def test_base_score_by_hand(docs):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\n"] for _, t in ROWS]
    learns = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in ROWS]
    c = Counter(w for ws, ok in zip(tokens, learns, strict=True) if ok for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), not ok, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (i, _), ws, ok in zip(ROWS, tokens, learns, strict=True))
    got = suffix_tree.score_texts(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    again = suffix_tree.score_texts(docs, suffix_tree.Settings(parts=3, block_bytes=50)).collect()
    assert sorted((str(r.doc_id), round(r.score, 3)) for r in again) == sorted((str(r.doc_id), round(r.score, 3)) for r in got)


def test_held_out_texts_are_better_foretold(spark, sf_dir):
    rows = queries.op5_suffix_tree(spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert rows[0] > 0.95 * rows[1]


def tree_by_hand(rows, gain=2.0, least=2):
    """The scores by dictionaries: levels of contexts, kept where leaving each occurrence out in turn they save over `gain` nats."""
    texts = [(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\n"], zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1) for i, t in rows]
    c = Counter(w for ws, ok in texts if ok for w in ws)
    n, v = sum(c.values()), len(c)
    levels = []  # (followers of each context, states)

    def prob(ws, j, depth):
        p = (c[ws[j]] + 0.5) / (n + 0.5 * (v + 1))
        for k, (follow, states) in enumerate(levels[:depth], 1):
            ctx = tuple(ws[j - k : j]) if j >= k else None
            if ctx in states:
                f = follow[ctx]
                p = (f[ws[j]] + len(f) * p) / (sum(f.values()) + len(f))
        return p

    for k in (1, 2):
        follow, under = {}, {}
        for ws, ok in texts:
            for j in range(k, len(ws)):
                ctx = tuple(ws[j - k : j])
                under.setdefault((ctx, ws[j]), 2.0 ** (-round(-8 * math.log2(prob(ws, j, k - 1))) / 8))
                if ok:
                    follow.setdefault(ctx, Counter())[ws[j]] += 1
        states = set()
        for ctx, f in follow.items():
            total, t = sum(f.values()), len(f)
            saved = sum(m * math.log((m - 1 + t * under[ctx, w]) / (total - 1 + t) / under[ctx, w]) for w, m in f.items())
            if total >= least and saved > gain:
                states.add(ctx)
        levels.append((follow, states))
    for k, (_, states) in enumerate(levels, 1):  # each state's distribution, one word standing for all unknown ones, adds up to 1
        for ctx in states:
            assert sum(prob([*ctx, w], k, k) for w in [*c, "unseen"]) == pytest.approx(1)
    return [(str(i), sum(math.log10(prob(ws, j, 2)) for j in range(len(ws)))) for (i, _), (ws, _) in zip(rows, texts, strict=True)]


def test_scores_equal_a_tree_by_hand(spark):
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = [*ROWS, *zip(held, ("The cat sat on zyx the qwv", "unseen", "has the unseen cat sat on the the mat zyx"), strict=True)]
    got = suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert min(r.n_tokens - r.n_known for r in got if r.doc_id in held) > 0
    assert sorted((str(r.doc_id), round(r.score, 4)) for r in got) == sorted((i, round(x, 4)) for i, x in tree_by_hand(rows))


def test_unknown_words_are_smoothed_like_any_other(spark):
    """After `cat`, a state with N occurrences and T next words, an unknown word has P * T / (N + T)."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1][:60]
    new = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1)
    texts = [("cat sat " if k % 2 else "cat lay ") + " ".join(f"x{k}y{j}" for j in range(5)) for k in range(60)]
    df = spark.createDataFrame([*zip(ids, texts, strict=True), (new, "cat zyx")], "doc_id long, text string")
    r = suffix_tree.score_texts(df).where(f"doc_id = {new}").head()
    n, v = 60 * 8, 4 + 60 * 5
    base = [math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in (60, 0, 60)]
    assert abs(r.base_score - sum(base)) < 1e-9
    assert abs(r.score - (sum(base) + math.log10(2 / 62))) < 1e-9


def test_words_alike_in_24_bits_of_hash_stay_apart():
    import numpy as np
    import pyarrow as pa

    words = {"ctx": np.array([7, 0, 0, 0], np.uint64), "word": np.array([5, 5, 5, 6], np.uint32), "more": np.array([1, 2, 1, 1], np.uint8), "n": np.array([4, 3, 2, 1], np.uint32), "q": np.array([80] * 4, np.uint8)}
    t = pa.table({"block": [0], "part": [0], "data": [suffix_tree._pack(**words)]})
    ((*_, data),) = suffix_tree.count_entries(t, 1, 0.0)
    found = suffix_tree._unpack(pa.scalar(data))
    assert found["n"].tolist() == [6, 3, 6, 1] and set(found["states"].tolist()) == {3}


def test_empty_tables(docs):
    assert suffix_tree.score_texts(docs.limit(0)).count() == 0
    assert simhash.edited_fingerprints(docs.limit(0)).count() == 0


def test_edited_texts(docs):
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, __import__("hashlib").sha1((r[1] or "").encode()).digest()))
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((str(i), len(t), __import__("hashlib").sha256(e.encode()).hexdigest()))
    got = simhash.edited_fingerprints(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = {}
    for r in got:
        prints.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert len(prints[0]) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 6}) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 10, 101])
def test_places_among_cuts(spark, n):
    import bisect

    cuts = [3 * i - 20 for i in range(n)]
    rows = spark.createDataFrame([(x,) for x in range(-30, 320, 7)], "v long").select("v", simhash._place(cuts, F.col("v")).alias("p")).collect()
    assert all(r.p == bisect.bisect_right(cuts, r.v) for r in rows)


def test_fingerprints_are_votes(spark):
    """Each bit by counting, over hashes of the terms that Spark gives one by one."""
    texts = ["the cat sat on The mat", "a", "a b", "", "x y z " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.hi, r.lo) for r in simhash.fingerprints(df, ["doc_id"], "text").collect()}
    for i, t in enumerate(texts):
        ws = t.lower().split()
        terms = [(ws[j], *(ws[j + k] if j + k < len(ws) else None for k in (1, 2))) for j in range(len(ws))]
        h = spark.createDataFrame(terms, "t0 string, t1 string, t2 string").select(F.xxhash64("t0", "t1", "t2"), F.xxhash64(F.lit(1), "t0", "t1", "t2")).collect() if terms else []
        for w in (0, 1):
            bits = sum(1 << b for b in range(64) if 2 * sum((x[w] >> b) & 1 for x in h) > len(h))
            assert got[i][w] & (2**64 - 1) == bits


@pytest.mark.parametrize("radius,blocks", [(0, 2), (3, 4), (5, 8)])
def test_radius_search_equals_brute_force(spark, radius, blocks):
    import random

    rng = random.Random(radius)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(128)
        for _ in range(5):
            y = x
            for _ in range(rng.randrange(8)):
                y ^= 1 << rng.randrange(128)
            prints.append(y)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(x >> 64), signed(x & (2**64 - 1))) for i, x in enumerate(prints)], "doc_id long, hi long, lo long")
    got = {(r.hi, r.lo): r.n_near for r in simhash.near_rows(df, F.col("doc_id") % 20 == 0, radius, blocks).collect()}
    want = {(signed(x >> 64), signed(x & (2**64 - 1))): sum((x ^ y).bit_count() <= radius for y in prints) for x in prints[::20]}
    assert got == want


def test_near_copies_of_texts_are_found(spark):
    import random

    rng = random.Random(8)
    texts, want, shingles = {}, {}, lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    for i in range(0, 600, 20):
        ws = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts[i], want[i] = ws, 1
        for k, changed in enumerate((1, 2, 3, 4), 1):
            ws2 = list(ws)
            for at in rng.sample(range(200), changed):
                ws2[at] = f"new{rng.randrange(3000)}"
            texts[i + k] = ws2
            want[i] += len(shingles(ws) & shingles(ws2)) >= 0.8 * len(shingles(ws) | shingles(ws2))
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in texts.items()], "doc_id long, text string")
    rows = simhash.edited_fingerprints(df).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for r in rows:
        if r.doc_id % 20 == 0:
            assert r.n_near == sum((prints[r.doc_id] ^ y).bit_count() <= simhash.RADIUS for y in prints.values())
    assert sum(min(r.n_near, want[r.doc_id]) for r in rows if r.doc_id % 20 == 0) >= 0.98 * sum(want.values())


def test_repeated_words_count_at_every_length():
    import numpy as np

    def share(n):
        x = quality_knn.term_counts(" ".join(f"w{i * i % 300}" for i in range(n)))
        return x[quality_knn.PAIRS + 1] / np.linalg.norm(x[: quality_knn.PAIRS])

    assert abs(share(1999) - share(2000)) < 0.01 and share(1999) > 0.4
    assert all(share(n) > 0.3 for n in (2500, 6000, 30_000))


def test_neighbours_vote(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op6_quality_knn(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "text", "c"), (2, "long " * 90_000, "d")], "doc_id long, text string, _score string")
    model = quality_knn.train(docs, labels, ~quality_knn.held_out())
    assert all(0 <= r._score <= 1 for r in quality_knn.score(odd, model).collect())
    assert quality_knn.keep_good(odd, labels.limit(0), docs).count() == 4  # without labels all score 0.5
    assert quality_knn.keep_good(odd.limit(0), labels, docs).columns == odd.columns


def test_votes_equal_brute_force(spark):
    """Cosines and votes one by one, in the space that an SVD of the same weighted counts gives."""
    rng = np.random.default_rng(1)
    counts = np.abs(rng.normal(size=(60, quality_knn.TERMS))).astype(np.float32) * (rng.random((60, quality_knn.TERMS)) < 0.05)
    labels, weights = (np.arange(60) % 3 == 0).astype(float), np.where(np.arange(60) % 2, 1.0, 2.0)
    counts[7] = counts[8]  # a tie
    model = quality_knn.fit(counts, labels, weights, dims=10, k=5)
    asked = np.vstack([counts[:4], np.abs(rng.normal(size=(6, quality_knn.TERMS))).astype(np.float32)])
    x = counts * model.idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, _, vt = np.linalg.svd(x.astype(np.float64), full_matrices=False)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    ours, theirs = unit(model.project(counts)), unit(x @ vt[:10].T)
    assert np.allclose(ours @ ours.T, theirs @ theirs.T, atol=1e-3), "the same space but for a rotation"
    for row, got in zip(asked, model.scores(asked), strict=True):
        q = model.project(row[None])[0]
        sims = model.vectors @ q
        least = sorted(sims)[-5]
        near = [i for i in range(60) if sims[i] >= least]
        votes = [max(0.0, float(sims[i])) ** 8 * weights[i] for i in near]
        assert got == pytest.approx(sum(v * labels[i] for v, i in zip(votes, near, strict=True)) / sum(votes), abs=1e-4)


def test_held_out_is_boolean(spark):
    rows = spark.createDataFrame([(None,), (1,)], "doc_id long").select(quality_knn.held_out().alias("h")).collect()
    assert all(isinstance(r.h, bool) for r in rows)

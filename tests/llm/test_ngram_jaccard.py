import random
import re

import numpy as np
import pytest

from quillspark.llm import ngram_jaccard as J
from quillspark.llm.components import components


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            low[find(i)] = min(x for x in (low.get(find(i)), d) if x is not None) if (low.get(find(i)), d) != (None, None) else None
    return sorted(((d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 12, 40, 120]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 3, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((n, " ".join(w)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[0][1]), (n + 4, rows[0][1].upper()), (n + 5, "one two"), (n + 6, "One  TWO"), (n + 6, "x y z"), (n + 7, "big " * 20_000)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 60)])
def test_equals_brute_force(spark, k, percent):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n string")
    got = J.linked(docs, J.Alike(k, percent)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, percent)


def test_keep_one(spark):
    rows = corpus(2)
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, root string")
    kept = J.keep_one(docs)
    want = {(d, c) for d, n, c in brute(rows, 5, 80) if d == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in want}
    assert J.keep_one(docs.limit(0)).count() == 0


def test_large_group_about_the_threshold(spark):
    """400 texts with up to 6 of 100 words changed: some pairs link, most are just below."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for n in range(400):
        w = list(base)
        for i in rng.sample(range(100), rng.choice([1, 2, 3, 4, 6])):
            w[i] = f"w{rng.randrange(10_000)}"
        rows.append((n, " ".join(w)))
    got = J.linked(spark.createDataFrame(rows, "doc_id long, text string"), J.Alike(4, 85)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, 85)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "A b c", 1, 2, 3), (3, None, None, None, None)], "doc_id long, text string, _id int, _tag int, _row int")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_long_chain_and_hot_node(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in range(60)}}


def test_images_tell_what_sets_tell():
    """Sets of 1 to 3,000 tokens about the threshold: an image's yes and no are those of the sets, and few stay open."""
    rng, alike, n_open = np.random.default_rng(3), J.Alike(4, 85), 0
    for _ in range(600):
        n = int(rng.integers(1, 3000))
        both, rest = rng.integers(0, 1 << 64, n, np.uint64), int(n * rng.uniform(0, 0.12))
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 64, rest, np.uint64)])) for _ in "ab")
        x, y = J.image(J.image_bytes(a)), J.image(J.image_bytes(b))
        assert x.tolist() == (a >> np.uint64(48)).tolist()
        told = alike.judged(x, y)
        assert told is None or told == alike.links(a, b)
        n_open += told is None
    assert n_open < 90
    assert J.image(J.image_bytes(a[:0])).tolist() == []


def test_near_copies_need_no_sets(spark, monkeypatch):
    """Whole sets of shingles of texts that clearly link aren't fetched, stored or shuffled."""
    rng, real, sets = random.Random(8), J.stored, []

    def stored(df, name):
        out = real(df, name)
        if name.endswith("-sets"):
            sets.append(out.count())
        return out

    monkeypatch.setattr(J, "stored", stored)
    rows = []
    for i in range(20):
        base = [f"g{i}w{j}" for j in range(300)]
        for _ in range(4):
            w = list(base)
            w[rng.randrange(300)] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    got = J.linked(spark.createDataFrame(rows, "doc_id long, text string"), J.Alike(4, 85)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i // 4 * 4) for i in range(80)]
    assert sum(sets) == 0

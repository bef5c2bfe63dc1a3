import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle as M
from quillspark.llm.queries import op13_merkle_manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, fan):
    """The root, and each start's steps: (before, after) of every level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // fan * fan : k // fan * fan + fan]
            steps[i].append(("".join(run[: k % fan]), "".join(run[k % fan + 1 :])))
        nodes = [H(*nodes[k : k + fan]) for k in range(0, len(nodes), fan)]
        at = [k // fan for k in at]
    return nodes[0], steps


def brute(rows, fan=16):
    """(doc_id, leaf, subroot, root, steps) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        some = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = some, *climb([leaf(r) for r in some], fan)
    root, tops = climb([trees[s][1] for s in names], fan)
    return [(r[0], leaf(r), trees[s][1], root, st + top) for s, top in zip(names, tops, strict=True) for r, st in zip(trees[s][0], trees[s][2], strict=True)]


def found(df, fan=16):
    return [(r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.steps]) for r in M.proofs(df, FIELDS, fan_in=fan).collect()]


def key(r):
    return (str(r[0]), r[1], str(r[4]))


@pytest.mark.parametrize("fan,sizes", [(16, [1, 16, 17, 300, 2]), (2, [1, 2, 3, 9, 33]), (3, [27, 28, 1])])
def test_against_a_plain_tree(spark, fan, sizes):
    rows = [(i * 7 % 1000, f"s{k}" if k else None, "en", i, f"text {k} {i}") for k, n in enumerate(sizes) for i in range(n)]
    assert sorted(found(spark.createDataFrame(rows, SCHEMA), fan), key=key) == sorted(brute(rows, fan), key=key)


def test_salted_lookups(spark, monkeypatch):
    monkeypatch.setattr(M, "RUNS_PER_SALT", 2)
    monkeypatch.setattr(M, "ROWS_PER_SALT", 5)
    rows = [(i, f"s{i % 30}" if i % 3 else "hot", None, i, None) for i in range(400)]
    assert sorted(found(spark.createDataFrame(rows, SCHEMA), 3), key=key) == sorted(brute(rows, 3), key=key)


def test_odd_rows(spark):
    """Nulls in every column, an empty source, repeated rows and ids, a very long text; extra columns with names used inside; an empty table."""
    rows = [(None, None, None, None, None), (1, None, "en", 1, "a"), (1, None, "en", 1, "a"), (1, None, "en", 1, "b"), (2, "", "é", 0, ""), (3, "é", "en", 5, "x" * 3_000_000), (3, "z", "en", 5, "-")]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA + ", _place string, tree string, n string")
    assert sorted(found(df), key=key) == sorted(brute(rows), key=key)
    assert found(df.limit(0)) == []


def test_query_against_plain_python(spark, sf_dir):
    rows = [tuple(r[f] for f in FIELDS) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {}
    for (i, own, sub, root, steps), row in zip(brute(rows), [r for r in sorted(rows, key=lambda r: (r[1].encode(), r[0]))], strict=True):
        h = leaf([*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])]) if zlib.crc32(str(i).encode()) % 5 == 0 else own
        for before, after in steps:
            h = H(before, h, after)
        want[i] = (own, sub, root, H(*[x for s in steps for x in s]), h, h == root)
    got = {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in op13_merkle_manifest(spark, sf_dir).collect()}
    assert got == want and 0 < sum(not r[5] for r in want.values()) < len(want)


def test_a_proof_of_another_place_fails(spark):
    df = spark.createDataFrame([(i, "a", "en", i, f"t{i}") for i in range(40)], SCHEMA)
    rows = M.proofs(df, FIELDS)
    a, b = (rows.where(F.col("doc_id") == i).head() for i in (3, 4))
    frame = spark.createDataFrame([(a.leaf, b.steps, b.root)], rows.select("leaf", "steps", "root").schema)
    assert frame.where(M.fold(F.col("leaf"), F.col("steps")) == F.col("root")).count() == 0

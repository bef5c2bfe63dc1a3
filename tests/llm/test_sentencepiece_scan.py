import random

import numpy as np
import pytest
import sentencepiece

from quillspark.llm import sentencepiece_scan as S
from quillspark.llm.tokens import default_path

PATH = default_path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "Hello world", "  two  blanks ", "naïve café 日本語 😀\n\ttab", "x" * 300, "den the that ing " * 30, "a▁b", "über " * 20, "\u0000 a", "======== ----", "1234567890 " * 9, "한국어 текст ελληνικά", "\r\n\r\n  x"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def some(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("aabcdeehinorst   ▁\nüßé.,'12日x") for _ in range(rng.choice([5, 40, 200]))) for _ in range(n)]


def test_ids_equal_the_library(library):
    p = S.Pieces(PATH)
    for t in TEXTS + some(300, 1):
        ids, _ = p.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t), t
        assert p.decode(ids) == t.replace("▁", " "), t


def test_paths_equal_merges():
    p = S.Pieces(PATH)
    for t in some(200, 2) + ["x" * 90, "tionation" * 12]:
        s = p.normalised(t)
        assert p.path(s, 0, len(s)) == [i for w in p.merged(s) for i in p.ids_of(w)]


def test_chunks_give_the_library_s_ids(spark, library):
    texts = [(1, "den the that ing " * 90), (2, None), (3, "x" * 999 + "日本" * 40), (3, ""), (None, "ab " * 300), (5, "den the that ing " * 90), (6, "tion" * 400), (7, "".join(some(40, 3)))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, ids string")
    whole = sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in S.encode(docs, PATH).collect())
    cut = S.encode(docs, PATH, giant_chars=100, chunk_chars=64, run=3).collect()
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in cut) == whole
    want = sorted((str(i), np.asarray(library.encode(t or ""), "<u4").tobytes(), (t or "").replace("▁", " ")) for i, t in texts)
    assert whole == want


def test_transfer_is_associative_and_has_one_path():
    p = S.Pieces(PATH)
    s = p.normalised("den the that ing " * 10 + "x" * 90 + "hello there you all " * 9)
    cuts = [0, 50, 130, 200, 300, len(s)]
    ms = [p.transfer(s, a, b) for a, b in zip(cuts, cuts[1:])]
    left = ms[0]
    for m in ms[1:]:
        left = S.times(left, m)
    right = ms[-1]
    for m in ms[-2::-1]:
        right = S.times(m, right)
    assert np.allclose(left, right) and (left > S.LOW).sum() == 1


def test_other_models_are_refused(tmp_path):
    with open(PATH, "rb") as f:
        data = f.read()
    i = data.index(b"\x18\x02", data.index(b"tok_v0"))
    (tmp_path / "m").write_bytes(data[:i] + b"\x18\x01" + data[i + 2 :])
    with pytest.raises(ValueError, match="BPE"):
        S.Pieces(str(tmp_path / "m"))


def test_empty_table(spark):
    assert S.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_scans_in_place(spark, library):
    """Texts of up to a run of chunks are scanned without a shuffle; cut anywhere, their ids are those of the whole; what is kept is bounded."""
    texts = some(3, 5) + ["".join(some(400, 6)), "x" * 9000, "den the that ing " * 1200, " " * 500 + "tion" * 300]
    written = lambda: sum(e.totalShuffleWrite() for e in (found.apply(i) for found in [spark.sparkContext._jsc.sc().statusStore().executorList(False)] for i in range(found.size())))
    before = written()
    rows = S.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    assert written() == before
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: library.encode(t) for i, t in enumerate(texts)}
    p = S.Pieces(PATH, most_words=50)
    for t in texts:
        whole = p.encode(t)
        for chars in (17, 100, 4096):
            ids, score = p.scan(t, chars)
            assert ids == whole[0] and np.isclose(score, whole[1])
    assert len(p.words) == 50 and len(p.pairs) <= 50

"""SentencePiece encoding by a model of the BPE kind, in parallel also within one giant text.

BPE merges the neighbours whose union has the best score, the left ones first. What it leaves is the only way to cut a text
into pieces of which any two neighbours, taken alone, are left as they are: a merge across a cut that stays would have
come before, in the pair alone as in the text. So an encoding is the best path in the (max, +) semiring where a piece adds its score
and neighbours that would merge add minus infinity; that path is the only finite one, and equals the library's ids.

A giant text is cut into chunks at fixed places. A state at a boundary is the piece that holds the character before it. A
chunk's transfer matrix has the best score from each state at its left boundary to each at its right one; matrices are
combined associatively, boundary states follow from the products, and then each chunk traces its own path. No piece has a blank after
another character, so all paths meet where a word begins, and whole words within a chunk are encoded once and kept. Texts of up to a run
of chunks are scanned where they lie; the chunks of longer ones are dealt out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import slices, small_batches, stored

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
LOW = -1e30
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BEGIN = re.compile(f"[^{SPACE}](?={SPACE})")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: numbers, 32-bit floats as bytes, or byte strings."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {5: 4, 1: 8}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """A model's pieces with their scores. Models that merge otherwise, normalise or hold user-defined pieces are refused.

    most_words: so many words, and as many pairs of neighbours, are kept with what was found for them, some 0.2 KB each; others are encoded each time."""

    def __init__(self, path: str, most_words: int = 400_000):
        self.names: list[str] = []
        self.score: dict[str, tuple[int, float]] = {}
        self.byte: dict[int, int] = {}
        kinds: list[int] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        with open(path, "rb") as f:
            data = f.read()
        for n, v in _fields(data):
            if n == 1:
                piece = dict(_fields(v))
                name, kind = piece[1].decode(), piece.get(3, NORMAL)
                if kind == BYTE:
                    self.byte[int(name[3:5], 16)] = len(self.names)
                elif kind == NORMAL:
                    self.score[name] = (len(self.names), float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                elif kind == UNKNOWN:
                    self.unknown_id = len(self.names)
                self.names.append(name)
                kinds.append(kind)
            elif n == 2:
                trainer = dict(_fields(v))
            elif n == 3:
                normalizer = dict(_fields(v))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or {USER, UNUSED} & set(kinds):
            raise ValueError("only models of the BPE kind without user-defined and unused pieces can be read")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that leave characters and blanks as they are can be read")
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a blank after another character; words can't be encoded one by one")
        self.byte_of = {i: b for b, i in self.byte.items()}
        #: What each id stands for; control pieces stand for nothing.
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else n.replace(SPACE, " ").encode() if k == NORMAL else b"" for i, (n, k) in enumerate(zip(self.names, kinds, strict=True))]
        self.longest = max(map(len, self.score))
        self.unknown = min(s for _, s in self.score.values()) - 10.0
        self.starts = {p[:i] for p in self.score for i in range(1, len(p) + 1)}
        self.rank = {p: s for p, (_, s) in self.score.items()}
        #: What each id adds to a score: a run of bytes counts as its characters.
        self.adds = np.array([self.rank.get(n, 0.0) if k == NORMAL else self.unknown if k == UNKNOWN or i in self.byte_of and self.byte_of[i] & 192 != 128 else 0.0 for i, (n, k) in enumerate(zip(self.names, kinds, strict=True))])
        self.words = _Words(self, most_words)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.most_words = most_words

    def normalised(self, text: str) -> str:
        """Blanks as SPACE, and one before the text."""
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def merged(self, s: str) -> list[str]:
        """The pieces that merging leaves of a short string."""
        parts, rank = list(s), self.rank.get
        found = [rank(a + b, LOW) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (best := max(found)) > LOW:
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = rank(parts[at - 1] + parts[at], LOW)
            if at < len(found):
                found[at] = rank(parts[at] + parts[at + 1], LOW)
        return parts

    def stay(self, a: str | None, b: str) -> bool:
        """Whether two neighbours stay as they are; without a, whether b alone is one piece."""
        key = (a or "", b)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.most_words:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(key[0] + b) == ([a, b] if a else [b])
        return found

    def after(self, s: str, i: int) -> Iterator[tuple[int, float]]:
        """End and score of every piece of s that begins at i; a character that isn't a piece counts as one."""
        n, j = len(s), i + 2
        yield i + 1, self.score.get(s[i], (0, self.unknown))[1]
        while j <= n and (w := s[i:j]) in self.starts:
            if found := self.score.get(w):
                yield j, found[1]
            j += 1

    def ids_of(self, piece: str) -> list[int]:
        if found := self.score.get(piece):
            return [found[0]]
        return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")] if len(self.byte) == 256 else [self.unknown_id]

    def path(self, s: str, begin: int, end: int, before: str | None = None) -> list[int]:
        """Ids of the only path from begin to end after the piece `before`."""
        back: dict[int, int] = {begin: -1}
        for i in range(begin, end):
            if i in back:
                last = s[back[i] : i] if i > begin else before
                for j, _ in self.after(s, i):
                    if j <= end and j not in back and self.stay(last, s[i:j]):
                        back[j] = i
        out, j = [], end
        while j > begin:
            out.append(self.ids_of(s[back[j] : j]))
            j = back[j]
        return [x for part in reversed(out) for x in part]

    def word(self, w: str) -> bytes:
        """Ids of a word; a long one is one path, a short one is merged outright."""
        return np.asarray([x for p in self.merged(w) for x in self.ids_of(p)] if len(w) <= 64 else self.path(w, 0, len(w)), "<u4").tobytes()

    def in_words(self, s: str) -> bytes:
        """Ids of whole words."""
        return b"".join(map(self.words.__getitem__, _WORD.findall(s)))

    def total(self, ids: bytes) -> float:
        """The score of ids."""
        return float(self.adds[np.frombuffer(ids, "<u4")].sum())

    def encode(self, text: str) -> tuple[bytes, float]:
        ids = self.in_words(self.normalised(text))
        return ids, self.total(ids)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 are replaced."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text

    def across(self, s: str, at: int) -> list[tuple[int, int]]:
        """The states at a boundary: begin and end of every piece that holds the character before it. At the text's begin there is one."""
        if not at:
            return [(0, 0)]
        return [(i, j) for i in range(max(0, at - self.longest), at) for j, _ in self.after(s, i) if j >= at]

    def meetings(self, s: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and the last place where a word begins from lo to hi, hi not included; no piece lies across such a place."""
        m = _BEGIN.search(s, max(0, lo - 1), hi)
        if not m or m.start() + 1 >= hi:
            return None
        last = s.rfind(SPACE, m.start() + 1, hi)
        while s[last - 1] == SPACE:
            last -= 1
        return m.start() + 1, last

    def walk(self, s: str, live: dict[tuple[int, int], np.ndarray], lo: int, hi: int) -> dict[tuple[int, int], np.ndarray]:
        """From pieces with the scores of the paths that lead to them, to the pieces that hold the character before hi."""
        at: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        out: dict[tuple[int, int], np.ndarray] = {}

        def put(piece: tuple[int, int], v: np.ndarray) -> None:
            held = out if piece[1] >= hi else at.setdefault(piece[1], {})
            held[piece] = np.maximum(held[piece], v) if piece in held else v

        for piece, v in live.items():
            put(piece, v)
        for p in range(lo, hi):
            here = at.pop(p, None)
            for q, score in self.after(s, p) if here else ():
                for (i, _), v in here.items():
                    if self.stay(s[i:p] or None, s[p:q]):
                        put((p, q), v + score)
        return out

    def middle(self, s: str, lo: int, hi: int) -> tuple[int, int, bytes, float] | None:
        """Of the chunk from lo to hi: where its first and its last word begin, and ids and score of the words between. None if no word begins in it."""
        places = self.meetings(s, lo, hi)
        if not places:
            return None
        ids = self.in_words(s[places[0] : places[1]])
        return *places, ids, self.total(ids)

    def transfer(self, s: str, lo: int, hi: int) -> np.ndarray:
        """Of the chunk from lo to hi of s: the best score from each state at lo to each at hi."""
        return self._transfer(s, lo, hi, self.across(s, lo), self.across(s, hi), self.middle(s, lo, hi))

    def _transfer(self, s: str, lo: int, hi: int, left: list[tuple[int, int]], right: list[tuple[int, int]], middle: tuple[int, int, bytes, float] | None) -> np.ndarray:
        eye = np.where(np.eye(len(left), dtype=bool), 0.0, LOW)
        out = np.full((len(left), len(right)), LOW)
        live = dict(zip(left, eye, strict=True))
        if middle:
            first, last, _, score = middle
            met = np.full(len(left), LOW)
            for v in self.walk(s, live, lo, first).values():
                met = np.maximum(met, v)
            live, lo = {(last, last): met + score}, last
        at = {piece: i for i, piece in enumerate(right)}
        for piece, v in self.walk(s, live, lo, hi).items():
            out[:, at[piece]] = v
        return np.maximum(out, LOW)

    def trace(self, s: str, lo: int, hi: int, begin: int, end: int) -> bytes:
        """Ids of the pieces after the state `begin` at lo up to the state `end` at hi, which is included."""
        return self._trace(s, self.across(s, lo)[begin], self.across(s, hi)[end], self.middle(s, lo, hi))

    def _trace(self, s: str, begin: tuple[int, int], end: tuple[int, int], middle: tuple[int, int, bytes, float] | None) -> bytes:
        (i, a), (_, z) = begin, end
        if not middle:
            return np.asarray(self.path(s, a, z, s[i:a] or None), "<u4").tobytes()
        first, last, words, _ = middle
        return np.asarray(self.path(s, a, first, s[i:a] or None), "<u4").tobytes() + words + np.asarray(self.path(s, last, z), "<u4").tobytes()

    def scan(self, text: str, chunk_chars: int) -> tuple[bytes, float]:
        """Ids and score of a text, by the transfer matrices of its chunks."""
        s = self.normalised(text)
        cuts = [*range(0, max(1, len(s) // chunk_chars) * chunk_chars, chunk_chars), len(s)]  # the last one takes what is left
        states, chunks = [self.across(s, c) for c in cuts], list(zip(cuts, cuts[1:], strict=False))
        middles = [self.middle(s, lo, hi) for lo, hi in chunks]
        ms = [self._transfer(s, lo, hi, *states[c : c + 2], middles[c]) for c, (lo, hi) in enumerate(chunks)]
        found = _states(ms, 0, None)
        ids = [self._trace(s, states[c][found[c]], states[c + 1][found[c + 1]], middles[c]) for c in range(len(chunks))]
        return b"".join(ids), float(sum([m[a, b] for m, a, b in zip(ms, found, found[1:], strict=False)]))


class _Words(dict):
    """word -> its ids as little-endian unsigned 32-bit integers; the first `most` stay."""

    def __init__(self, pieces: Pieces, most: int):
        self.pieces, self.most = pieces, most

    def __missing__(self, word: str) -> bytes:
        ids = self.pieces.word(word)
        if len(self) < self.most:
            self[word] = ids
        return ids


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), LOW)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _states(matrices: list[np.ndarray], begin: int, end: int | None) -> list[int]:
    """The best boundary states along a run of matrices, from begin to end (or to the best last one), both included."""
    ahead = [np.where(np.arange(len(matrices[0])) == begin, 0.0, LOW)]
    for m in matrices:
        ahead.append(np.maximum((ahead[-1][:, None] + m).max(axis=0), LOW))
    out = [int(ahead[-1].argmax()) if end is None else end]
    for v, m in zip(reversed(ahead[:-1]), reversed(matrices), strict=True):
        out.append(int((v + m[:, out[-1]]).argmax()))
    return out[::-1]


def _giants(texts: DataFrame, path: str, chunk_chars: int, run: int) -> DataFrame:
    """digest, ids and score of giant texts (digest, text, distinct): chunks are dealt out, encoded and put together again.

    run: how many chunks' matrices are combined in one step; products of runs are combined in the next, so no task has more
    than a run of matrices and one row per run of its text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            for digest, text in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = p.normalised(text)
                count = max(1, len(s) // chunk_chars)  # the last one takes what is left
                for c in range(count):
                    begin, end = c * chunk_chars, (c + 1) * chunk_chars if c < count - 1 else len(s)
                    low = max(0, begin - 2 * p.longest)  # what the states at both boundaries can be is seen from either side
                    part = s[low : end + p.longest]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (digest, c, c // run, begin - low, end - low, part)], names=["digest", "chunk", "run", "lo", "hi", "part"])

    spark = texts.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    deal = lambda df: df.repartition(tasks, "digest", "chunk")  # noqa: E731  files are small for the work that they hold
    chunks = stored(texts.mapInArrow(cut, "digest binary, chunk long, run long, lo long, hi long, part string"), "pieces-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r[k]]) for k in ("digest", "chunk", "run")] + [pa.array([len(m := p.transfer(r["part"], r["lo"], r["hi"]))]), pa.array([m.tobytes()])], names=["digest", "chunk", "run", "states", "m"])

    made = stored(deal(chunks).mapInArrow(matrices, "digest binary, chunk long, run long, states long, m binary"), "pieces-matrices")

    def sorted_matrices(t: pa.Table, by: str) -> tuple[list[int], list[np.ndarray]]:
        rows = sorted(zip(t.column(by).to_pylist(), t.column("states").to_pylist(), t.column("m").to_pylist(), strict=True))
        return [r[0] for r in rows], [np.frombuffer(r[2]).reshape(r[1], -1) for r in rows]

    def product(t: pa.Table) -> pa.Table:
        _, ms = sorted_matrices(t, "chunk")
        while len(ms) > 1:
            ms = [times(*ms[i : i + 2]) if i + 1 < len(ms) else ms[i] for i in range(0, len(ms), 2)]
        return pa.table({"digest": t.column("digest")[:1], "run": t.column("run")[:1], "states": pa.array([len(ms[0])]), "m": pa.array([ms[0].tobytes()])})

    def outer(t: pa.Table) -> pa.Table:
        runs, ms = sorted_matrices(t, "run")
        states = _states(ms, 0, None)
        total, n = float(sum(m[a, b] for m, a, b in zip(ms, states, states[1:], strict=False))), len(runs)
        return pa.table({"digest": pa.array(t.column("digest").to_pylist()[:1] * n), "run": pa.array(runs), "begin": pa.array(states[:-1]), "end": pa.array(states[1:]), "score": pa.array([total] * n)})

    runs = made.groupBy("digest", "run").applyInArrow(lambda t: product(t), "digest binary, run long, states long, m binary")
    ends = stored(runs.groupBy("digest").applyInArrow(lambda t: outer(t), "digest binary, run long, begin long, end long, score double"), "pieces-runs")

    def inner(t: pa.Table, e: pa.Table) -> pa.Table:
        numbers, ms = sorted_matrices(t, "chunk")
        states = _states(ms, e.column("begin")[0].as_py(), e.column("end")[0].as_py())
        return pa.table({"digest": t.column("digest"), "chunk": pa.array(numbers), "begin": pa.array(states[:-1]), "end": pa.array(states[1:]), "score": pa.array(e.column("score").to_pylist()[:1] * len(numbers))})

    bounds = made.groupBy("digest", "run").cogroup(ends.groupBy("digest", "run")).applyInArrow(lambda a, b: inner(a, b), "digest binary, chunk long, begin long, end long, score double")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            for r in b.to_pylist():
                ids = p.trace(r["part"], r["lo"], r["hi"], r["begin"], r["end"])
                yield pa.RecordBatch.from_arrays([pa.array([r["digest"]]), pa.array([r["chunk"]]), pa.array([r["score"]]), pa.array([ids])], names=["digest", "chunk", "score", "ids"])

    traced = deal(chunks).join(bounds, ["digest", "chunk"]).select("digest", "chunk", "lo", "hi", "part", "begin", "end", "score").mapInArrow(trace, "digest binary, chunk long, score double, ids binary")

    def whole(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("chunk").to_pylist(), t.column("ids").to_pylist(), strict=True))
        return pa.table({"digest": t.column("digest")[:1], "ids": pa.array([b"".join(r[1] for r in rows)]), "score": t.column("score")[:1]})

    return traced.groupBy("digest").applyInArrow(lambda t: whole(t), "digest binary, ids binary, score double")


def encode(docs: DataFrame, path: str, giant_chars: int = 1 << 13, chunk_chars: int = 4096, run: int = 256) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), score and decoded (the ids' text) of every row of docs (doc_id, text).

    The ids are the library's for the same model. Texts of more than giant_chars characters are cut into chunks of chunk_chars; the
    ids don't depend on either, and scores only by the order of sums. Texts of more than `run` chunks are dealt out, and copies of one are encoded once; others stay
    where they lie. A word of any length is one path. Null texts count as empty and give no ids. Repeated and null ids
    stay; an empty table gives no rows; other columns aren't looked at."""
    spark = docs.sparkSession
    small_batches(spark)
    if chunk_chars <= pieces(path).longest:
        raise ValueError("a chunk must be longer than any piece")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = "doc_id long, ids binary, score double, decoded string"

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            at = 0
            for texts in slices(b.column("text"), 1 << 20):
                found = [p.scan(x, chunk_chars) if len(x) > giant_chars else p.encode(x) for x in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.float64()), pa.array([p.decode(f[0]) for f in found], pa.string())], names=["doc_id", "ids", "score", "decoded"])
                at += len(texts)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p.decode(x) for x in b.column("ids").to_pylist()], pa.string())], names=[*b.schema.names, "decoded"])

    most = max(giant_chars, run * chunk_chars)
    small = base.where(F.length("text") <= most).mapInArrow(in_place, out)
    large = base.where(F.length("text") > most).withColumn("digest", F.unhex(F.sha2("text", 256)))
    found = _giants(large.groupBy("digest").agg(F.first("text").alias("text")), path, chunk_chars, run)
    return small.unionByName(large.select("doc_id", "digest").join(found, "digest").select("doc_id", "ids", "score").mapInArrow(decoded, out))

"""A probabilistic suffix tree over the words of texts, and the scores that it gives texts.

The root's distribution is that of single tokens, (c + 0.5) / (N + 0.5 * (V + 1)). A context of up to `depth` words that training
texts have is a state of the tree if its next words diverge from what its suffix says: if, each occurrence being left out in
turn, it predicts them better. A state's distribution is smoothed with that of its longest suffix state,
(n + T * P) / (N + T) with T distinct next words (Witten and Bell). A token is scored by the longest suffix of what stands before it that is a state.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import scratch, slices, small_batches, split_words, stored

#: Stands for a text's end; no word has a blank in it.
END = "\n"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_24 = np.uint64(24)
MESSAGE = "block long, level int, part int, data binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Settings:
    """depth: words in a context at most. least_count: how often training texts must have a context. gain: what it must save, in nats
    over its training occurrences, each left out in turn. parts: into how many the counts are dealt. block_bytes: of text in a block."""

    depth: int = 2
    least_count: int = 2
    gain: float = 2.0
    parts: int = 64
    block_bytes: int = 12 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _pack(**arrays: object) -> bytes:
    """Arrays of integers go byte plane by byte plane, where their zeros vanish."""
    planes = {k: ("planes", v.dtype.str, np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1).T).tobytes()) if isinstance(v, np.ndarray) and v.dtype.kind == "u" and v.dtype.itemsize > 1 and len(v) else v for k, v in arrays.items()}
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, protocol=5))


def _unpack(data: pa.Scalar) -> dict:
    def plain(v: object) -> object:
        if isinstance(v, tuple) and v and v[0] == "planes":
            kind = np.dtype(v[1])
            return np.ascontiguousarray(np.frombuffer(v[2], np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
        return v

    return {k: plain(v) for k, v in pickle.loads(zstandard.ZstdDecompressor().decompress(data.as_py())).items()}


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


def _messages(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names=["block", "level", "part", "data"])


def _table(rows: list[tuple]) -> pa.Table:
    batches = list(_messages(rows))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.Table.from_batches(batches) if batches else pa.table({n: pa.array([], k) for n, k in zip(("block", "level", "part", "data"), kinds, strict=True)})


def trains(doc_id: Column) -> Column:
    """Whether a document is learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 1


def blocks(docs: DataFrame, set_: Settings) -> DataFrame:
    """Documents as blocks of numbered tokens, each text's end included: block, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            texts = pa.concat_arrays(t.column("text").chunks) if t.column("text").num_chunks != 1 else t.column("text").chunk(0)
            starts, numbers, words = split_words(texts, lower=True)
            words = [*words, END]
            ends = np.insert(numbers.astype(np.int64), starts[1:], len(words) - 1)
            data = _pack(doc_id=t.column("doc_id").to_pylist(), trains=t.column("trains").to_numpy(), sizes=np.diff(starts).astype(np.uint32) + np.uint32(1), tokens=ends.astype(np.uint32), words=words)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])

        held, size = [], 0
        for b in batches:
            at = 0
            for texts in slices(b.column("text"), set_.block_bytes):
                held.append(b.slice(at, len(texts)))
                at += len(texts)
                size += pc.sum(pc.binary_length(texts)).as_py() or 0
                if size >= set_.block_bytes:
                    yield block(held)
                    held, size, number = [], 0, number + 1
        if held:
            yield block(held)

    return docs.mapInArrow(run, "block long, data binary")


def word_hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def _slices(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _order(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The order by key and then by more, which seldom matters: only keys that differ in it are sorted twice."""
    order = np.argsort(key)
    k, m = key[order], more[order]
    mixed = (k[1:] == k[:-1]) & (m[1:] != m[:-1])
    if mixed.any():
        at = np.flatnonzero(np.isin(k, np.unique(k[1:][mixed])))
        order[at] = order[at][np.lexsort((m[at], k[at]))]
    return order


class Block:
    """A block with what the parts have answered so far: the model's probabilities, level by level."""

    def __init__(self, data: pa.Scalar, answers: list[tuple[int, int, dict]], set_: Settings, n: int = 0, v: int = 0):
        b = _unpack(data)
        self.set, self.doc_id, self.trains, self.sizes, self.words = set_, b["doc_id"], b["trains"], b["sizes"].astype(np.int64), b["words"]
        self.tokens = b["tokens"].astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.learns = self.trains[self.doc]
        self.hashes = word_hashes(self.words)
        self.answers: dict[int, list[dict]] = {}
        for level, _, data_ in sorted(answers, key=lambda a: a[:2]):
            self.answers.setdefault(level, []).append(data_)
        if 0 in self.answers or not len(self.tokens):
            order, _ = self.word_parts()
            self.count = np.zeros(len(self.words), np.int64)
            if len(self.words):
                self.count[order] = np.concatenate([a["n"] for a in self.answers[0]]).astype(np.int64)
            self.base = (self.count[self.tokens] + 0.5) / (n + 0.5 * (v + 1))
            self.p, self.seen = self.base, self.count[self.tokens]
            for level in range(1, set_.depth + 1):
                if level in self.answers:
                    self.rise(level)

    def word_parts(self) -> tuple[np.ndarray, np.ndarray]:
        return _slices((self.hashes % np.uint64(self.set.parts)).astype(np.int64), self.set.parts)

    def ask_words(self) -> Iterator[tuple[int, bytes]]:
        counts = np.bincount(self.tokens[self.learns], minlength=len(self.words))
        order, edges = self.word_parts()
        for p in range(self.set.parts):
            here = order[edges[p] : edges[p + 1]]
            if len(here):
                yield p, _pack(words=[self.words[i] for i in here], n=counts[here].astype(np.uint64))

    def entries(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens whose context of so many words is frequent enough; of each its entry's number; the entries' keys, what more names
        their words, parts, first tokens; and how often each token's context occurs in training texts. An entry is a context and a word after it; words that
        training texts lack are one, of the hash 0."""
        before = np.zeros_like(self.seen)
        before[1:] = self.seen[:-1]  # what was counted for the token before is how often the context occurs
        at = np.flatnonzero((self.place >= level) & (before >= self.set.least_count))
        h = np.where(self.count > 0, np.maximum(self.hashes, np.uint64(1)), np.uint64(0))[self.tokens]
        ctx = _mix(h[at - 1] + np.uint64(level))
        for k in range(2, level + 1):
            ctx = _mix(ctx * _A + h[at - k])
        # 40 bits of the context and 24 of the word, of which 8 more are kept aside; the part, which is part of an entry's name too, comes from other bits
        word = _mix(ctx ^ (h[at] * _A))
        key, more = (ctx << _24) | (word >> np.uint64(40)), ((word >> np.uint64(32)) & np.uint64(255)).astype(np.uint8)
        order = _order(key, more)
        sorted_key, more = key[order], more[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (more[1:] != more[:-1])
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(new) - 1
        part = ((ctx[order[new]] >> np.uint64(40)) % np.uint64(self.set.parts)).astype(np.int64)
        return at, number, sorted_key[new], more[new], part, at[order[new]], before[at]

    def ask(self, level: int) -> Iterator[tuple[int, bytes]]:
        at, number, key, more, part, first, _ = self.entries(level)
        n = np.bincount(number[self.learns[at]], minlength=len(key))
        q = np.clip(np.round(-8 * np.log2(self.p[first])), 0, 255).astype(np.uint8)
        order, edges = _slices(part, self.set.parts)
        for p in range(self.set.parts):
            here = order[edges[p] : edges[p + 1]]
            if len(here):
                yield p, _pack(ctx=_deltas(key[here] >> _24), word=(key[here] & np.uint64((1 << 24) - 1)).astype(np.uint32), more=more[here], n=n[here].astype(np.uint32), q=q[here])

    def rise(self, level: int) -> None:
        at, number, key, _, part, _, total = self.entries(level)
        order, _ = _slices(part, self.set.parts)
        n, states = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        n[order] = np.concatenate([a["n"] for a in self.answers[level]] or [[]]).astype(np.int64)
        states[order] = np.concatenate([a["states"] for a in self.answers[level]] or [[]]).astype(np.int64)
        n, t = n[number], states[number]
        self.seen = np.zeros_like(self.seen)
        self.seen[at] = n
        self.p = self.p.copy()
        self.p[at] = np.where(t > 0, (n + t * self.p[at]) / (total + t), self.p[at])

    def scores(self, n: int) -> pa.Table:
        per = lambda v: np.bincount(self.doc, weights=v, minlength=len(self.sizes))
        known = per((self.count[self.tokens] > 0).astype(float))
        return pa.table({
            "doc_id": pa.array(self.doc_id, pa.int64()), "held_out": pa.array(~self.trains), "n_tokens": pa.array(self.sizes), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(self.sizes), n, np.int64)), "base_score": pa.array(per(np.log10(self.base))), "score": pa.array(per(np.log10(self.p))),
        })


def count_words(t: pa.Table) -> tuple[list[tuple], np.ndarray]:
    """The answers to a part's questions about words, and the distinct words' counts."""
    rows = [_unpack(x) for x in t.column("data")]
    coded = pa.array([w for r in rows for w in r["words"]], pa.large_string()).dictionary_encode()
    number = coded.indices.to_numpy()
    totals = np.bincount(number, weights=np.concatenate([r["n"] for r in rows]).astype(float), minlength=len(coded.dictionary)).astype(np.uint64)
    edges = np.cumsum([0, *(len(r["words"]) for r in rows)])
    return [(b, 0, p, _pack(n=totals[number[i:j]])) for b, p, i, j in zip(t.column("block").to_pylist(), t.column("part").to_pylist(), edges, edges[1:], strict=False)], totals


def count_entries(t: pa.Table, level: int, gain: float) -> list[tuple]:
    """The answers to a part's questions about entries: their counts, and for a context that is a state the number of distinct next words, else 0."""
    rows = [_unpack(x) for x in t.column("data")]
    key = np.concatenate([(np.cumsum(r["ctx"]) << _24) | r["word"].astype(np.uint64) for r in rows])
    order = _order(key, more := np.concatenate([r["more"] for r in rows]))
    sorted_key, more = key[order], more[order]
    same_ctx = (sorted_key[1:] >> _24) == (sorted_key[:-1] >> _24)
    new = np.concatenate([[True], (sorted_key[1:] != sorted_key[:-1]) | (more[1:] != more[:-1])])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    n = np.bincount(number, weights=np.concatenate([r["n"] for r in rows]).astype(float))
    under = 2.0 ** (-np.concatenate([r["q"] for r in rows])[order][new].astype(float) / 8)
    state = np.cumsum(np.concatenate([[True], ~same_ctx]))[new] - 1
    total, distinct = np.bincount(state, weights=n), np.bincount(state, weights=(n > 0).astype(float))
    left_out = (n - 1 + distinct[state] * under) / np.maximum(total[state] - 1 + distinct[state], 1e-9)
    saved = np.bincount(state, weights=np.where(n > 0, n * np.log(np.maximum(left_out, 1e-300) / under), 0.0))
    states = np.where(saved > gain, distinct, 0)[state]
    edges = np.cumsum([0, *(len(r["word"]) for r in rows)])
    return [(b, level, p, _pack(n=n[number[i:j]].astype(np.uint32), states=states[number[i:j]].astype(np.uint32))) for b, p, i, j in zip(t.column("block").to_pylist(), t.column("part").to_pylist(), edges, edges[1:], strict=False)]


def _asks(level: int) -> Callable[[Block, int], pa.Table]:
    return lambda b, number: _table([(number, level, p, q) for p, q in b.ask(level)])


def _counts(level: int, gain: float) -> Callable[[pa.Table], pa.Table]:
    return lambda t: _table(count_entries(t, level, gain))


def score_texts(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    Learns from the rows that trains() names, all of them. The texts are read once, as blocks of numbered tokens. For each level, the root
    and then contexts of one word more, each block asks for the counts of what it holds, once for each distinct
    entry; the questions are dealt to parts by word or context, counted there over all blocks, and answered. So what is shuffled grows
    with the distinct entries of blocks, and a word as frequent as may be is an entry per block and next word. Nothing but N and V meets at the driver.
    The blocks lie in buckets, so they aren't shuffled to meet the answers.

    A text longer than block_bytes is a block of its own in one worker, some ten bytes for each of its tokens.
    Null texts count as empty: their score is that of an end. Repeated and null ids stay; an empty table gives no rows; other columns are not looked at."""
    spark = docs.sparkSession
    small_batches(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    set_ = settings or Settings(parts=4 * n_parts)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), trains(F.col("doc_id")).alias("trains"))
    name = f"lm_blocks_{uuid.uuid4().hex}"
    blocks(base, set_).write.bucketBy(n_parts, "block").option("path", scratch(spark, "lm-blocks")).saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone; the files stay

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                yield from _messages([(number, 0, p, q) for p, q in Block(data, [], set_).ask_words()])

    def answer_words(t: pa.Table) -> pa.Table:
        rows, totals = count_words(t)
        return _table([*rows, (-1, 0, t.column("part")[0].as_py(), pickle.dumps((int(totals.sum()), int((totals > 0).sum()))))])

    answers = stored(held.mapInArrow(ask_words, MESSAGE).groupBy("part").applyInArrow(lambda t: answer_words(t), MESSAGE), "lm-words")
    sums = [pickle.loads(bytes(r[0])) for r in answers.where("block = -1").select("data").collect()]  # one row per part
    n, v = sum(s[0] for s in sums), sum(s[1] for s in sums)
    answers = answers.where("block >= 0")

    def with_blocks(found: DataFrame, use: Callable[[Block, int], pa.Table], out: str) -> DataFrame:
        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            told = [(lv, p, _unpack(d)) for lv, p, d in zip(b.column("level").to_pylist(), b.column("part").to_pylist(), b.column("data"), strict=True)]
            tables = [use(Block(x, told, set_, n, v), number) for number, x in zip(a.column("block").to_pylist(), a.column("data"), strict=True)]
            return pa.concat_tables(tables)

        return held.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda a, b: run(a, b), out)

    for level in range(1, set_.depth + 1):
        asked = with_blocks(answers, _asks(level), MESSAGE)
        told = asked.groupBy("part").applyInArrow(_counts(level, set_.gain), MESSAGE)
        answers = answers.unionByName(stored(told, f"lm-level-{level}"))
    return with_blocks(answers, lambda b, number: b.scores(n), OUT)

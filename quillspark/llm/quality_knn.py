"""Quality by nearest-neighbour voting among labelled texts in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, small_batches, texts_of

#: Hashed byte pairs; a prime, so that the remainder mixes both bytes. After them come the DERIVED terms.
PAIRS = 4093
DERIVED = 4
TERMS = PAIRS + DERIVED


def expected_distinct(n: int) -> float:
    """How many of n words of prose differ, taken low: the share falls slowly with the length, whatever it is."""
    return 0.75 * n / (1 + n / 2000) ** 0.25


def term_counts(text: str) -> np.ndarray:
    """How often each term occurs in the whole text.

    Terms are pairs of adjacent bytes, hashed, and four that words give: a word like the one before it, a word that occurred
    before (beyond what prose of that length repeats), a word without a letter or digit, a word in capitals. Counts are damped by their logarithm, and derived ones are shares of the words."""
    out = np.zeros(TERMS, dtype=np.float32)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
    if len(b) > 1:
        pairs = np.bincount((b[:-1] * 257 + b[1:]) % PAIRS, minlength=PAIRS)
        out[:PAIRS] = np.log1p(pairs)
    words = WORD.findall(text)
    if words:
        n, distinct = len(words), set(words)
        bare, loud = {w for w in distinct if not any(map(str.isalnum, w))}, {w for w in distinct if len(w) > 1 and w.isupper()}
        counts = sum(map(eq, words, words[1:])), max(0.0, expected_distinct(n) - len(distinct)), sum(w in bare for w in words) if bare else 0, sum(w in loud for w in words) if loud else 0
        norm = float(np.sqrt((out * out).sum())) or 1.0
        out[PAIRS:] = norm * np.array(counts, dtype=np.float32) / n
    return out


@dataclass(frozen=True)
class Neighbours:
    """The labelled texts in latent space, and the way there. Its size depends on `most` and `dims` alone: 4,097 x dims floats and 2 x most x dims."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    k: int
    power: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the k nearest and those that tie with the last of them, weighted by similarity; without similar ones, among all."""
        n = len(self.labels)
        if not n:
            return np.full(len(counts), 0.5)
        prior = float((self.weights * self.labels).sum() / self.weights.sum())
        sims = self.project(counts) @ self.vectors.T
        k = min(self.k, n)
        least = np.partition(sims, n - k, axis=1)[:, n - k, None]  # all that are as similar as the k-th vote with it
        w = np.where(sims >= least, np.maximum(sims, 0.0), 0.0).astype(np.float64) ** self.power * self.weights
        total = w.sum(axis=1)
        return np.where(total > 1e-9, (w @ self.labels) / np.maximum(total, 1e-9), prior)


def fit(counts: np.ndarray, labels: np.ndarray, weights: np.ndarray, dims: int = 48, k: int = 15, power: float = 8.0) -> Neighbours:
    """Latent-semantic analysis of the labelled texts: damped counts by inverse document frequency, then a truncated SVD."""
    n = len(labels)
    df = (counts > 0).sum(axis=0)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    if not n:
        return Neighbours(idf, np.zeros((counts.shape[1], 1), np.float32), np.zeros((0, 1), np.float32), labels, weights, k, power)
    x = counts * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    values, vectors = np.linalg.eigh(x @ x.T)  # single precision, as the driver's memory is small; what it can't tell from none is left out
    top = np.argsort(-values)[: min(dims, n)]
    top = top[values[top] > 1e-5 * max(values.max(), 1e-30)]
    basis = (x.T @ (vectors[:, top] / np.sqrt(values[top]))).astype(np.float32)
    model = Neighbours(idf, basis, np.zeros((0, 1), np.float32), labels, weights, k, power)
    return Neighbours(idf, basis, model.project(counts), labels, weights, k, power)


def _packed(counts: np.ndarray) -> bytes:
    """The terms that occur, as places and counts; most don't."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n, out = len(raw) // 6, np.zeros(TERMS, dtype=np.float32)
    out[np.frombuffer(raw[: 2 * n], np.uint16)] = np.frombuffer(raw[2 * n :], np.float32)
    return out


def train(docs: DataFrame, labels: DataFrame, learns: Column, most: int = 1000, label_col: str = "quality") -> Neighbours:
    """Learns from at most `most` labelled texts of each label, those with the smallest hash of their id, where `learns` holds.

    Only doc_id, of any type that can be joined on, and text are looked at; of rows with the same id the smallest text counts. Rows without a label other than 0 and 1 don't count; of several labels for an id the
    smallest does. A label's texts count in proportion to how many such rows there are, sampled or not."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = labels.select("doc_id", F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1)).groupBy("doc_id").agg(F.min("_label").alias("_label")).where(learns)
    totals = dict(ids.groupBy("_label").count().collect())
    parts = [ids.where(F.col("_label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(parts[0].union(parts[1])), "doc_id")
    chosen = chosen.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_label"), pa.array([_packed(term_counts(x)) for x in texts_of(b)], pa.binary())], names=["doc_id", "_label", "counts"])

    rows = sorted(((r[0], r[1], bytes(r[2])) for r in chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, _label int, counts binary").collect()), key=lambda r: (r[0], r[2]))
    y = np.array([r[1] for r in rows], dtype=np.float64)
    counts = np.array([_unpacked(r[2]) for r in rows], dtype=np.float32).reshape(len(rows), TERMS)
    share = {v: totals.get(v, 0) / max(1, int((y == v).sum())) for v in (0, 1)}
    return fit(counts, y, np.array([share[int(v)] for v in y], dtype=np.float64))


def score(docs: DataFrame, model: Neighbours, keep: list[str] = ("doc_id",), text_col: str = "text", block: int = 256) -> DataFrame:
    """The columns `keep` and `score` of every row: cosine products of a block of whole texts with all labelled vectors.

    The model is broadcast once; its size is bounded, see Neighbours. No shuffle: hot sources and copies don't matter.
    Null texts count as empty and score as the labels at large do; without labels all score 0.5. Rows with null or repeated ids are
    scored each by its own text; an empty table gives no rows. `keep` can't hold columns named _text or _score; keep_good takes any."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*keep).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = texts_of(b, "_text")
            found = [model.scores(np.stack([term_counts(x) for x in texts[i : i + block]])) for i in range(0, len(texts), block)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(np.clip(np.concatenate(found), 0, 1), pa.float64())], names=[*(f.name for f in kept), "_score"])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "_score double"])
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, out)


def held_out(doc_id: str = "doc_id") -> Column:
    """A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, learns: Column | None = None, keep_at: float = 0.5) -> DataFrame:
    """The rows of docs that score keep_at or more, with all their columns.

    It learns from the texts of learn_from (docs itself, if not given) whose ids have a label and aren't held out."""
    model = train(docs if learn_from is None else learn_from, labels, ~held_out() if learns is None else learns)
    clash = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in clash.items()])
    return score(renamed, model, list(clash.values()), clash["text"]).where(F.col("_score") >= keep_at).select(*[F.col(n).alias(c) for c, n in clash.items()])

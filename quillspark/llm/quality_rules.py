"""Quality rules as weak supervision: each rule votes or abstains, EM estimates how far each is to be trusted."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BLANKS, WORD, small_batches, stored, texts_of

_SYMBOLS = "#*$%&|<>"
_LETTER_OR_DIGIT = re.compile(r"\w")
_MIX = np.uint64(0x9E3779B97F4A7C15)

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_lower long, n_bangs long, n_bare_words long, n_distinct_words long, n_stutters long"


def repeat_words(words: list[str], window: int = 5) -> int:
    """Words inside windows of `window` words that occur twice or more in the text, all occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    g = h[:n].copy()
    for k in range(1, window):
        g *= _MIX
        g ^= g >> np.uint64(29)
        g += h[k : n + k]
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), dtype=bool)
    for k in range(window):
        inside[k : n + k] |= twice
    return int(inside.sum())


def measure(text: str) -> tuple[int, ...]:
    """The COUNTS of one whole text."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    upper = sum(map(text.count, _UPPER)) if text.isascii() else sum(map(str.isupper, text))
    lower = sum(map(text.count, _LOWER)) if text.isascii() else sum(map(str.islower, text))
    distinct = set(words)
    bare = {w for w in distinct if not _LETTER_OR_DIGIT.search(w)}
    return (
        len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines),
        upper, lower, text.count("!"), sum(w in bare for w in words) if bare else 0, len(distinct), sum(map(eq, words, words[1:])),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """The columns `keep` and the COUNTS of every row's whole text; null texts have no words."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.select(*keep).schema.fields]
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([measure(x) for x in texts_of(b, "_text")], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *(pa.array(found[:, i]) for i in range(len(names)))], names=[*(f.name for f in kept), *names])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), COUNTS])
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, out)


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, F.lit(0))
    return (vote if good is None else vote.when(good, F.lit(1))).otherwise(F.lit(2)).cast("int")


def rules() -> dict[str, Column]:
    """Each rule's vote on a row of COUNTS: 0 bad, 1 good, 2 abstains. Shares are of the text's words, lines or letters.

    A rule knows one kind of junk, so it abstains where it sees none: that a text has few symbols doesn't speak
    against its being shouted. Only a text that looks like prose in general gets a vote for it."""
    n, lines, letters = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1)), F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    c = F.col
    return {
        "word_count": _vote(c("n_words") < 10),
        "word_length": _vote(~(c("word_chars") / n).between(2.0, 12.0)),
        "symbols": _vote(c("n_symbols") > 0.1 * n),
        "dup_lines": _vote((c("n_dup_lines") > 0.3 * lines) & (lines >= 5)),
        "repeat_words": _vote(c("n_repeat_words") > 0.2 * n),
        "case": _vote((c("n_upper") > 0.4 * letters) & (n >= 5)),
        "bangs": _vote(c("n_bangs") > 0.2 * n),
        "bare_words": _vote(c("n_bare_words") > 0.2 * n),
        # longer texts repeat more of their words: the share falls slowly with their length, without an end
        "variety": _vote((c("n_distinct_words") < 0.15 * n * F.pow(F.greatest(n, F.lit(5000)) / 5000, F.lit(-0.3))) & (n >= 50)),
        "stutters": _vote(c("n_stutters") > 0.3 * n),
        "prose": _vote((c("n_lower") < 0.2 * n) & (n >= 5), (c("n_symbols") + c("n_bangs") + c("n_bare_words") <= 0.01 * n) & (c("n_distinct_words") >= 0.3 * n) & (c("n_lower") >= 0.8 * letters)),
    }


@dataclass(frozen=True)
class VoteModel:
    """What EM found. accuracy[r, y, v] = P(rule r votes v | quality y); prior = P(good)."""

    prior: float
    accuracy: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good | votes) for rows of votes."""
        logs = np.stack([np.log(self.accuracy[np.arange(votes.shape[1]), y, votes]).sum(axis=1) for y in (0, 1)])
        odds = logs[1] - logs[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(votes: np.ndarray, weights: np.ndarray, rounds: int = 200, tolerance: float = 1e-9, strength: float = 0.1) -> VoteModel:
    """EM for the model in which rules vote independently given the quality.

    votes: distinct patterns; weights: how many rows have each. It starts from the belief that a rule which votes is
    mostly right: in good texts it seldom votes bad. Dirichlet pseudo-counts of that belief (strength, as a share of
    the table) keep the classes from turning into others, such as long and short texts."""
    r, total = votes.shape[1], max(float(weights.sum()), 1.0)
    belief = np.array([[0.30, 0.30, 0.40], [0.001, 0.50, 0.499]])  # bad and good: votes bad, good, abstains
    acc, prior = np.repeat(belief[None], r, axis=0), 0.8
    pseudo = belief * np.array([[1.0], [max(10.0, strength * total)]])
    hot = np.stack([votes == v for v in range(3)], axis=2).astype(float)  # pattern, rule, vote
    for _ in range(rounds):
        p = VoteModel(prior, acc).posterior(votes)
        both = np.stack([(1 - p) * weights, p * weights])
        counts = np.einsum("yp,prv->ryv", both, hot) + pseudo
        new = counts / counts.sum(axis=2, keepdims=True)
        prior = float(np.clip((both[1].sum() + 8) / (total + 10), 1e-6, 1 - 1e-6))
        moved, acc = np.abs(new - acc).max(), new
        if moved < tolerance:
            break
    return VoteModel(prior, acc)


def _voted(counts: DataFrame) -> DataFrame:
    return counts.withColumn("_votes", sum((v * 3**i for i, v in enumerate(rules().values())), F.lit(0)).cast("int"))


def _split(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(rules()))) % 3


def vote_model(counts: DataFrame) -> VoteModel:
    """The model of a whole table of COUNTS.

    The votes of all rows are counted by pattern with map-side partial aggregation; there are at most 3^11 patterns,
    whatever the table's size, so EM runs on them at the driver."""
    found = _voted(counts).groupBy("_votes").count().orderBy("_votes").collect()
    return fit(_split(np.array([x[0] for x in found], dtype=np.int64)), np.array([x[1] for x in found], dtype=float))


def judge(counts: DataFrame, model: VoteModel, keep_at: float = 0.5) -> DataFrame:
    """Rows of COUNTS with `quality` (posterior probability that the text is good), `base_failed` and `kept`.

    The posteriors of all 3^11 patterns of votes are broadcast: 177,147 short rows at any size."""
    every = np.arange(3 ** len(rules()))
    posterior = counts.sparkSession.createDataFrame(pd.DataFrame({"_votes": every.astype("int32"), "quality": model.posterior(_split(every))}))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = _voted(counts).join(F.broadcast(posterior), "_votes").drop("_votes")
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))


def quality_rows(docs: DataFrame, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns `keep`, the COUNTS of its text, quality, base_failed and kept.

    The texts are read once, measured in Arrow batches without a shuffle; the counts alone are stored and judged. Empty and
    null texts have no words and so fail; null or repeated ids are carried along. `keep` can't name what is made here: a ValueError; other columns
    may have any name. A very long text is measured whole in one worker."""
    made = {*(c.split()[0] for c in COUNTS.split(", ")), "quality", "base_failed", "kept"}
    if made & set(keep):
        raise ValueError(f"columns of the result can't be kept too: {sorted(made & set(keep))}")
    counts = stored(with_counts(docs, text_col, list(keep)), "quality-counts")
    return judge(counts, vote_model(counts))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns.

    The texts are read twice and never stored: once for the votes of all rows, once to judge each row as it passes
    by. No join on ids, so null and repeated ids don't matter."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    clash = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in clash.items()])
    model = vote_model(with_counts(renamed, clash["text"]))
    judged = judge(with_counts(renamed, clash["text"], list(clash.values())), model).where("kept")
    return judged.drop(*names).select(*[F.col(n).alias(c) for c, n in clash.items()])

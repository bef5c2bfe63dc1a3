"""Words out of syllables: a lattice of known words over each run of syllables, cut along the cheapest path.

What a word costs is learned from a corpus: words are runs of syllables that occur together far more often than their parts would.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.shared import stored

#: Syllables and what lies between them; words don't reach over punctuation.
_TOKEN = re.compile(r"[^\W\d_]+|\d[\d.,]*\d|\d|_|[^\w\s]")
_SYLLABLE = re.compile(r"[^\W\d_]+")
UNKNOWN = 25.0


def cost_table(docs: DataFrame, text_col: str = "text", longest: int = 4, least: int = 5, cohesion: float = 2.0) -> DataFrame:
    """word (syllables by single blanks, lower case) and its cost: minus log of its share, for single syllables and for cohesive runs of 2 to `longest`.

    A run is a word if it occurs `least` times and its cohesion, log(c(run) / (c(head) * c(tail)) * N) at the weakest place it can be cut at, is `cohesion` or more.
    All texts are counted: one groupBy over runs with partial sums in the map tasks; runs find the counts of their parts by equi-joins."""
    lower = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    pieces = F.explode(F.split(lower, r"[^\p{L}\s]+"))  # runs don't reach over punctuation and digits
    syllables = docs.select(pieces.alias("p")).select(F.regexp_extract_all("p", F.lit(r"(\p{L}+)"), 1).alias("s")).where(F.size("s") > 0)
    runs = [_runs(n) for n in range(1, longest + 1)]
    counts = syllables.select(F.explode(F.concat(*runs)).alias("w")).groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    counts = stored(counts, "runs")  # texts are cut once
    single = ~F.col("w").contains(" ")
    total = F.broadcast(counts.where(single).agg(F.sum("c").alias("total")))  # one row
    parts = F.split("w", " ")
    at = F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("i")
    cuts = counts.where(~single).select("w", "c", parts.alias("s"), at)
    cuts = cuts.select("w", "c", F.array_join(F.slice("s", F.lit(1), F.col("i")), " ").alias("head"), F.array_join(F.slice("s", F.col("i") + 1, F.size("s") - F.col("i")), " ").alias("tail"))
    for part in ("head", "tail"):  # a part is at least as frequent as the run
        cuts = cuts.join(counts.select(F.col("w").alias(part), F.col("c").alias(f"c_{part}")), part)
    bond = F.log(F.col("c") * F.col("total") / (F.col("c_head") * F.col("c_tail")))
    kept = cuts.crossJoin(total).groupBy("w", "c").agg(F.min(bond).alias("weakest")).where(F.col("weakest") >= cohesion).select("w", "c")
    words = counts.where(single).unionByName(kept).crossJoin(total)
    return words.select(F.col("w").alias("word"), (F.log("total") - F.log("c")).alias("cost"))


def costs(docs: DataFrame, text_col: str = "text", longest: int = 4, least: int = 5, cohesion: float = 2.0, most_words: int = 200_000) -> dict[str, float]:
    """cost_table() as the dictionary that segmenter() hands to each Python worker: at most most_words words, a stated bound of that model, the most frequent ones."""
    rows = cost_table(docs, text_col, longest, least, cohesion).orderBy("cost", "word").limit(most_words)
    return {r.word: r.cost for r in rows.collect()}


def _runs(n: int) -> Column:
    """All runs of n syllables of `s`."""
    last = F.size("s") - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice("s", i, n), " "))).otherwise(F.array().cast("array<string>"))


def cheapest(syllables: list[str], cost: dict[str, float], longest: int = 4) -> list[list[str]]:
    """The cheapest cut of syllables into words; of equally cheap ones that with the longer last word. Unknown syllables cost UNKNOWN each."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    low = [s.lower() for s in syllables]
    for end in range(1, len(syllables) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            c = cost.get(" ".join(low[start:end]), UNKNOWN if end - start == 1 else None)
            if c is not None:
                options.append((best[start][0] + c, start))
        best.append(min(options))
    out, end = [], len(syllables)
    while end:
        start = best[end][1]
        out.append(syllables[start:end])
        end = start
    return out[::-1]


def split(text: str, cost: dict[str, float], longest: int = 4) -> list[str]:
    """Words of a text, syllables of one joined by `_`; numbers and punctuation are tokens of their own."""
    out: list[str] = []
    run: list[str] = []
    for m in _TOKEN.finditer(text):
        if _SYLLABLE.fullmatch(m[0]):
            run.append(m[0])
            continue
        out += ["_".join(w) for w in cheapest(run, cost, longest)]
        run = []
        out.append(m[0])
    return out + ["_".join(w) for w in cheapest(run, cost, longest)]


def segmenter(cost: dict[str, float], longest: int = 4) -> Callable[[Column], Column]:
    """For bm25_tokens(), Segments.add() and top_k(), with_metadata(): texts and queries are cut alike. The costs go to each Python worker once a task."""
    return T.segmenter(lambda text: split(text, cost, longest))

"""Vector bin packing: examples go into sequences under limits on tokens, segments and loss-bearing tokens at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches
from quillspark.llm.tokens import word_ids

OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    #: A bin into which no whole example fits is topped up with a cut one while it has at least so many tokens free.
    least_cut: int = 16


@dataclass
class Piece:
    doc: tuple[int | None, int, int]  # id, tokens, leading tokens that bear no loss
    start: int
    ids: bytes  # of this piece alone, so that what waits doesn't hold whole documents

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return loss_of(self.doc, self.start, self.length)


def loss_of(doc: tuple[int | None, int, int], start: int, length: int) -> int:
    return max(0, start + length - max(start, doc[2]))


@dataclass
class Packer:
    """Packs pieces of one task. The examples wait in a pool of at most `most` pieces, so memory is bounded: 64 MB with 2,048 tokens each.

    Bins are filled one by one. The next example is, of those that fit in every dimension, that with the largest dot
    product of its size vector with the bin's free space, both as shares of the limits. Examples of equal size are
    alike, so the heuristic looks at distinct sizes only. Of equal products the longer example goes first, then that with
    more loss; of equal sizes the one that came last. A last bin that is not full returns to the pool, except at
    the end; so a task leaves one bin that isn't full."""

    limits: Limits
    most: int = 8192
    pool: list[Piece] = field(default_factory=list)

    def cut_len(self, doc: tuple[int | None, int, int], start: int, length: int, free_tokens: int, free_loss: int) -> int:
        """The longest prefix of the piece that fits."""
        n = min(length, free_tokens)
        if loss_of(doc, start, n) <= free_loss:
            return n
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if loss_of(doc, start, mid) <= free_loss else (lo, mid - 1)
        return lo

    def add(self, doc: tuple[int | None, int, int], ids: bytes) -> Iterator[list[Piece]]:
        lim, start, n = self.limits, 0, doc[1]
        while start < n:
            k = max(1, self.cut_len(doc, start, n - start, lim.tokens, lim.loss_tokens))
            piece = Piece(doc, start, ids[4 * start : 4 * (start + k)])
            start += k
            if k == lim.tokens:
                yield [piece]
            else:
                self.pool.append(piece)
                if len(self.pool) >= self.most:
                    yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[list[Piece]]:
        lim = self.limits
        sizes: dict[tuple[int, int], list[Piece]] = {}
        for p in self.pool:
            sizes.setdefault((p.length, p.loss), []).append(p)
        self.pool = []
        kinds = sorted(sizes, reverse=True)
        stacks = [sizes[k] for k in kinds]
        need = np.array(kinds, dtype=np.int64).reshape(-1, 2)
        left, alive = sum(map(len, stacks)), np.ones(len(kinds), dtype=bool)
        share = np.column_stack([need[:, 0] / lim.tokens, np.full(len(kinds), 1 / lim.segments), need[:, 1] / lim.loss_tokens])
        while left:
            free = np.array([lim.tokens, lim.segments, lim.loss_tokens], dtype=np.int64)
            out: list[Piece] = []
            while left and free[1]:
                fits = alive & (need[:, 0] <= free[0]) & (need[:, 1] <= free[2])
                if fits.any():
                    dots = share @ (free / [lim.tokens, lim.segments, lim.loss_tokens])
                    j = int(np.where(fits, dots, -1.0).argmax())
                    p = stacks[j].pop()
                    left -= 1
                    alive[j] = bool(stacks[j])
                    out.append(p)
                    free -= [p.length, 1, p.loss]
                    continue
                if free[0] < lim.least_cut:
                    break
                j = int(alive.argmax())  # the longest that waits is cut
                p = stacks[j][-1]
                k = self.cut_len(p.doc, p.start, p.length, int(free[0]), int(free[2]))
                if k < 1:
                    break
                stacks[j].pop()
                alive[j] = bool(stacks[j])
                head, rest = Piece(p.doc, p.start, p.ids[: 4 * k]), Piece(p.doc, p.start + k, p.ids[4 * k :])
                out.append(head)
                free -= [head.length, 1, head.loss]
                key = (rest.length, rest.loss)
                if key in sizes:
                    i = kinds.index(key)
                    stacks[i].append(rest)
                    alive[i] = True
                else:
                    sizes[key] = [rest]
                    kinds.append(key)
                    stacks.append(sizes[key])
                    need, alive = np.vstack([need, [key]]), np.append(alive, True)
                    share = np.vstack([share, [key[0] / lim.tokens, 1 / lim.segments, key[1] / lim.loss_tokens]])
            if not left and free[0] >= lim.least_cut and free[1] and not last:
                self.pool = out  # not full: it waits for what comes
            else:
                yield out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits(), loss_start: str | None = None, lead_share: float = 0.0, id_col: str = "doc_id", text_col: str = "text", most_words: int = 450_000) -> DataFrame:
    """Packs whole documents, cut where need be, into sequences within `limits`; one row per piece, with its ids.

    One pass without a shuffle: each task encodes its documents, sets out full sequences at once and packs the rest
    from a bounded pool, so that neither hot sources nor equal texts matter. A sequence belongs to one task;
    sequence_id is task * 2^32 + its number there, the same again when a lost task runs anew over the same split.
    loss_start names a column with the number of leading ids that bear no loss (an instruction); without it, or where it is
    null, that is lead_share of a document's ids, rounded down.
    most_words: how many words' ids a Python worker keeps (some 250 MB at a
    million). Null texts and empty ones consist of the end id. Rows with null or repeated ids are packed like any other; other
    columns are not looked at. An empty table gives no rows."""
    small_batches(docs.sparkSession)
    extra = [F.col(loss_start).cast("long").alias("_loss_start")] if loss_start else []
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, end = word_ids(tokenizer_path, most_words), np.uint32(end_id).tobytes()
        first = TaskContext.get().partitionId() << 32
        sequences = iter(range(first, first + (1 << 32)))
        packer = Packer(limits)

        def rows(bins: Iterator[list[Piece]]) -> Iterator[tuple]:
            for one in bins:
                number, offset = next(sequences), 0
                for p in one:
                    yield p.doc[0], p.start, p.length, p.ids, p.doc[1], p.loss, number, offset
                    offset += p.length

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _TYPES, strict=True)], names=_NAMES)

        found: list[tuple] = []
        for batch in batches:
            starts = batch.column("_loss_start").to_pylist() if loss_start else [None] * batch.num_rows
            for doc_id, ids, lead in zip(batch.column("doc_id").to_pylist(), words.encode_many(batch.column("text")), starts, strict=True):
                ids += end
                n = len(ids) // 4
                lead = int(lead_share * n) if lead is None else min(max(lead, 0), n)
                found += rows(packer.add((doc_id, n, lead), ids))
                if len(found) >= 4000:
                    yield batch_of(found)
                    found = []
        found += rows(packer.flush(last=True))
        if found:
            yield batch_of(found)

    return narrow.mapInArrow(run, OUT)


_NAMES = [c.split()[0] for c in OUT.split(", ")]
_TYPES = [pa.binary() if "binary" in c else pa.int64() for c in OUT.split(", ")]

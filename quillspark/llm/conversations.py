"""Repair of the order of speakers in conversations: the cheapest edits, found by a fold over each conversation's turns in Spark SQL.

A conversation is right if its roles are, by their first letters, nothing or an s and then ua, ua ... (the s may be missing).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from quillspark.llm.common import BATCH_BYTES, BATCH_ROWS, BLANKS, small_batches, stored

#: What was said last: nothing, system, user, assistant.
STATES = "esua"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: No path. Costs stay far below it.
NEVER = 1 << 40
#: Turns of a block, and blocks or groups of a group above them.
BLOCK, GROUP = 256, 64

State = dict[str, Column]


def _order(prefix: list[Column]) -> list[Column]:
    """Turns in their order; rows of one turn by role and by the digest of their text."""
    return [*prefix, F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_digest")]


def flagged(rows: DataFrame) -> DataFrame:
    """conv_id, n (from 1), what decides the edits: the role's initial and the first fault (blank, duplicate, truncated or none); illegal: the
    role before it doesn't go with it; turn, new_turn: not the turn of the row before. rows: conv_id, turn, role, text.

    Texts count by their digests; the texts themselves stay where they are."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    end = F.rtrim(text, F.lit(BLANKS))
    light = rows.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), role.alias("_role"), F.unhex(F.md5(text.cast("binary"))).alias("_digest"), (end == "").alias("_blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("_open"))
    talk = Window.partitionBy("_conv").orderBy(*_order([]))
    initial = F.left("_role", F.lit(1))
    light = light.withColumns({"n": F.row_number().over(talk), "_before": F.lag(initial).over(talk), "_last_turn": F.lag("_turn").over(talk)})
    same = Window.partitionBy("_conv", "_role", "_digest").orderBy("n")
    fault = F.when(F.col("_blank"), "b").when(F.row_number().over(same) > 1, "d").when(F.col("_open"), "t").otherwise("")
    return light.select(
        F.col("_conv").alias("conv_id"), "n", initial.alias("initial"), fault.alias("fault"), F.col("_turn").alias("turn"),
        (F.col("_turn").isNotNull() & ~F.col("_turn").eqNullSafe(F.col("_last_turn"))).alias("new_turn"),
        F.coalesce(~F.concat("_before", initial).isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
    )


def _state(x: Column) -> State:
    return {s: x[s] for s in STATES}


def _struct(states: State) -> Column:
    return F.struct(*[states[s].alias(s) for s in STATES])


def _more(x: Column, cost: Column | int, edit: Column | str) -> Column:
    """A path with one more edit."""
    return F.struct((x["cost"] + cost).alias("cost"), F.concat(x["audit"], F.lit(edit) if isinstance(edit, str) else edit).alias("audit"))


def _start(state: str) -> Column:
    return _struct({s: F.struct(F.lit(0 if s == state else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")) for s in STATES})


def _inserted(x: State) -> State:
    """The states with insertions after them: at most one, or a user's and an assistant's, can be cheapest."""
    u = F.least(x["u"], *[_more(x[s], INSERT, "I") for s in "esa"])
    return {"e": x["e"], "s": x["s"], "u": u, "a": F.least(x["a"], _more(u, INSERT, "I"))}


def _turn(acc: Column, turn: Column) -> Column:
    """The four cheapest paths after one more turn: deleted, or, unless it is blank or a duplicate, kept or given the role that fits; then insertions."""
    x, initial = _state(acc), turn["initial"]
    late, dead = F.when(turn["fault"] == "t", F.lit(TRUNCATED)).otherwise(0), turn["fault"].isin("b", "d")
    gone = {s: _more(x[s], DELETE, "D") for s in STATES}

    def said(s: str, to: str) -> Column:
        kept = initial == to
        return _more(x[s], F.when(dead, F.lit(NEVER)).when(kept, late).otherwise(late + REROLE), F.when(kept, "K").otherwise("R"))

    system = _more(x["e"], F.when(dead | (initial != "s"), F.lit(NEVER)).otherwise(late), "K")
    return _struct(_inserted({"e": gone["e"], "s": F.least(gone["s"], system), "u": F.least(gone["u"], *[said(s, "u") for s in "esa"]), "a": F.least(gone["a"], said("u", "a"))}))


def _after(acc: Column, block: Column) -> Column:
    """Paths followed by those of a block, block[i] being its paths from the i-th state."""
    x = _state(acc)
    join = lambda s, t: _more(x[s], block[STATES.index(s)][t]["cost"], block[STATES.index(s)][t]["audit"])
    return _struct({t: F.least(*[join(s, t) for s in STATES]) for t in STATES})


def repairs(rows: DataFrame) -> DataFrame:
    """For each conversation of rows (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost and audit, the cheapest edits' initials.

    Edits: K keeps a turn, R gives it the role user or assistant (3), D deletes it (4; blank turns and duplicates must go), I puts an empty turn of user or
    assistant anywhere (3); a truncated turn that stays costs 3 more. Of equally cheap edits those count whose initials are least.
    A turn's first fault counts: blank; duplicate, if role and text were there before; truncated, if the last character but blanks isn't one of .!?
    gaps: turn numbers missing between the least and the largest.

    Null roles and texts count as empty, null conv_ids as one conversation, null turns come first; rows of one turn lie in the order of role and
    digest. Repeated rows are duplicates. Conversations without rows aren't there; other columns are not looked at.

    Sorted structs of at most BLOCK turns are folded by aggregate(), which carries four (cost, audit) structs. A longer conversation is folded
    in blocks, each from every state, and the blocks are joined in groups of GROUP: paths of equally many turns and equal cost are
    never each other's beginnings, so the cheapest of a whole is made of the cheapest of its parts. No task collects a long conversation;
    its turns, some 40 bytes each without texts, are numbered in one sorted pass."""
    block = F.call_function("div", F.col("n") - 1, F.lit(BLOCK))
    counts = {"blank": F.col("fault") == "b", "duplicate": F.col("fault") == "d", "truncated": F.col("fault") == "t", "illegal": F.col("illegal"), "turns": F.col("new_turn")}
    sums = [*counts]
    folded = flagged(rows).groupBy("conv_id", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("n", "initial", "fault"))).alias("_turns"), *[F.sum(c.cast("long")).alias(k) for k, c in counts.items()], F.min("turn").alias("low"), F.max("turn").alias("high")
    )
    fold = lambda start: F.aggregate("_turns", start, _turn)
    begin = _struct(_inserted(_state(_start("e"))))
    paths = F.when(F.col("block") == 0, F.array(fold(begin))).otherwise(F.array(*[fold(_start(s)) for s in STATES]))
    folded = folded.withColumn("_paths", paths).drop("_turns")
    for size in (GROUP, GROUP, None):
        above = F.lit(0).cast("long") if size is None else F.call_function("div", F.col("block"), F.lit(size))
        folded = folded.withColumn("_above", above).groupBy("conv_id", "_above").agg(F.array_sort(F.collect_list(F.struct("block", "_paths"))).alias("_parts"), *[F.sum(k).alias(k) for k in sums], F.min("low").alias("low"), F.max("high").alias("high"))
        joined = F.aggregate(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), F.col("_parts")[0]["_paths"], lambda acc, part: F.transform(acc, lambda row: _after(row, part["_paths"])))
        folded = folded.withColumn("_paths", joined).withColumnRenamed("_above", "block").drop("_parts")
    best = F.least(F.col("_paths")[0]["e"], F.col("_paths")[0]["a"])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return folded.select("conv_id", gaps.alias("gaps"), *sums[:-1], best["cost"].alias("cost"), best["audit"].alias("audit"))


class _Talk:
    """Applies the edits of one conversation to its turns as they come."""

    def __init__(self, conv: object, audit: str):
        self.conv, self.audit, self.at, self.last, self.place = conv, audit, 0, "", 0

    def _said(self, edit: str, role: str | None, text: str) -> tuple:
        fits = "assistant" if self.last == "u" else "user"
        role = fits if role is None else role
        self.last, self.place = role[:1], self.place + 1
        return self.conv, self.place, edit, role, text

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._said("I", None, "")

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._said(edit, role if edit == "K" else None, text)


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns in order, all in one partition."""
    small_batches(rows.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"), F.lit(None).cast("string").alias("_audit"))
    first = audits.select(F.col("conv_id").alias("_conv"), F.lit(None).cast(turns.schema["_turn"].dataType).alias("_turn"), F.lit("").alias("_role"), F.lit("").alias("_text"), F.col("audit").alias("_audit"))
    both = turns.unionByName(first).repartition("_conv").withColumn("_digest", F.unhex(F.md5(F.col("_text").cast("binary"))))
    return both.sortWithinPartitions(*_order([F.col("_conv"), F.col("_audit").isNull()])).drop("_digest")


def _talks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Talk, Iterator[tuple]]]:
    """The conversations with what is said in them after the edits, in pieces."""
    talk = None
    for b in batches:
        for conv, role, text, audit in zip(*(b.column(c).to_pylist() for c in ("_conv", "_role", "_text", "_audit")), strict=True):
            if audit is not None:
                if talk:
                    yield talk, talk.inserted()
                talk = _Talk(conv, audit)
            else:
                yield talk, talk.turn(role, text)
    if talk:
        yield talk, talk.inserted()


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit, role and text of what the conversations are after the edits; audits: repairs() of the same rows, stored.

    Whole texts are shuffled once and read in order, batch by batch: a conversation of any length takes no more memory than its audit."""
    out_schema = _schema(rows, ["place long", "edit string", "role string", "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for _, said in _talks(batches):
            for row in said:
                found.append(row)
                size += len(row[4])
                if len(found) >= BATCH_ROWS or size > BATCH_BYTES:
                    yield _batch(found, out_schema)
                    found, size = [], 0
        if found:
            yield _batch(found, out_schema)

    return _with_audits(rows, audits).mapInArrow(run, out_schema)


def _schema(rows: DataFrame, more: list[str]) -> ty.StructType:
    return ty.StructType([ty.StructField("conv_id", rows.schema["conv_id"].dataType), *ty.StructType.fromDDL(", ".join(more)).fields])


def _batch(found: list[tuple], out_schema: ty.StructType) -> pa.RecordBatch:
    kinds = to_arrow_schema(out_schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds.types, strict=True)], schema=kinds)


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of its repaired turns, `role:text` joined by newlines; hashed turn by turn."""
    out_schema = _schema(rows, ["repaired_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, talk, hashed = [], None, hashlib.sha256()
        for now, said in _talks(batches):
            if now is not talk:
                if talk:
                    done.append((talk.conv, hashed.hexdigest()))
                talk, hashed = now, hashlib.sha256()
            for _, place, _, role, text in said:
                hashed.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
            if len(done) >= BATCH_ROWS:
                yield _batch(done, out_schema)
                done = []
        if talk:
            done.append((talk.conv, hashed.hexdigest()))
        if done:
            yield _batch(done, out_schema)

    return _with_audits(rows, audits).mapInArrow(run, out_schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """repairs() with the digest of each repaired conversation."""
    audits = stored(repairs(rows), "repairs")
    digests = repaired_digests(rows, audits).withColumnRenamed("conv_id", "_conv")
    return audits.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of conversations that a known damage has met: by the CRC-32 of `conv_id:turn`, of 20 rows one is dropped, one
    emptied, one loses its .!?, one comes twice and one is given the role user. Nulls are one space, in what is hashed too."""
    role, text, conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text", "conv_id", "turn"))
    kind = F.pmod(F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")), F.lit(20))
    hit = rows.select("conv_id", "turn", role.alias("_r"), text.alias("_t"), kind.alias("_kind")).where("_kind <> 0")
    said = [F.when(F.col("_kind") == 4, "user").otherwise(F.col("_r")).alias("role"), F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_t", ".!?", "")).otherwise(F.col("_t")).alias("text")]
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hit.select("conv_id", "turn", *said, twice.alias("_copy")).drop("_copy")

"""A Merkle tree over a table, a subtree for each value of a column, and for every row the proof that it is in it.

Proofs are looked up by coordinates: where a row lies and how large its group is tells which nodes are its siblings, level by
level; they are exploded and joined to the stored node table. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import salted, stored
from quillspark.llm.order import numbered

#: A node of level l is asked for by the runs below its neighbours; from so many of them on its rows are dealt over salts.
RUNS_PER_SALT = 4096
ROWS_PER_SALT = 1 << 20
TOP = -1  # the tree over the subroots; others are named by the place of their first leaf


def value(c: Column) -> Column:
    """`-` for null, else how many UTF-8 bytes the value has as text, a colon, and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The lower-case hex SHA-256 of the values, each written by value()."""
    return F.sha2(F.concat(*[value(v) for v in values]).cast("binary"), 256)


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _whole(a: Column, b: Column) -> Column:
    """a / b rounded down, in whole numbers of any size; a isn't negative."""
    return F.call_function("div", a, b)


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, _text), "")


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to. steps: before and after, the hex digests to either side, level by level."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def proof_text(steps: Column) -> Column:
    """All siblings, level by level and from left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


class Shape:
    """Sizes and coordinates in trees of one fan-in; sizes are columns."""

    def __init__(self, fan_in: int):
        if fan_in < 2:
            raise ValueError("a run must have two nodes at least")
        self.fan_in, self.powers = fan_in, [1]
        while self.powers[-1] * fan_in < 1 << 62:
            self.powers.append(self.powers[-1] * fan_in)

    def power(self, level: Column) -> Column:
        return F.get(F.lit(self.powers).cast("array<bigint>"), level.cast("int"))

    def height(self, n: Column) -> Column:
        """How many levels lie below the last node."""
        return F.size(F.filter(F.lit(self.powers).cast("array<bigint>"), lambda p: p < n))

    def count(self, n: Column, level: Column) -> Column:
        """How many nodes a level has."""
        return _whole(n - 1, self.power(level)) + 1

    def salts(self, level: Column) -> Column:
        """A node of this level has this many rows in the lookup, so that no key is asked for by more than a bounded number."""
        few = [max(1, p // self.fan_in // RUNS_PER_SALT) for p in self.powers]
        return F.get(F.lit(few).cast("array<bigint>"), level.cast("int"))


def _levels(leaves: DataFrame, shape: Shape, highest: int, name: str, first: DataFrame | None = None) -> list[DataFrame]:
    """The nodes (tree, idx, n, digest) of each level, stored; n is the level's number of nodes in that tree. A tree ends with the level that has one."""
    levels = [leaves]
    if first is not None:
        levels.append(first)
    while len(levels) <= highest:
        below = levels[-1].where("n > 1")
        runs = below.groupBy("tree", _whole(F.col("idx"), F.lit(shape.fan_in)).alias("idx")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        digest = F.unhex(F.sha2(_joined(F.col("run.digest")).cast("binary"), 256))
        levels.append(stored(runs.select("tree", "idx", shape.count(F.col("n"), F.lit(1)).alias("n"), digest.alias("digest")), name))
    return levels


def _ask(askers: DataFrame, nodes: DataFrame, shape: Shape, lowest: int) -> DataFrame:
    """tree, own and steps for askers (tree, own: an index on level `lowest`, n: the tree's leaves).

    Each asker explodes the coordinates of the siblings on its way up, which meet the node table (tree, level, idx, digest) by an equi-join. Nodes
    high up are asked for by many: they and the questions are dealt over salts. One asker gets at most fan-in less one digests a level."""
    size, here = shape.fan_in, lambda level: _whole(F.col("own"), shape.power(level - lowest))

    def siblings(level: Column) -> Column:
        own, n = here(level), shape.count(F.col("n"), level)
        start = own - F.pmod(own, F.lit(size))
        ids = F.filter(F.sequence(start, F.least(start + size, n) - 1), lambda i: i != own)
        return F.transform(ids, lambda i: F.struct(level.alias("level"), i.alias("idx"), F.pmod(F.xxhash64("tree", "own"), shape.salts(level - lowest + 1)).alias("salt")))

    up = F.filter(F.sequence(F.lit(lowest), F.greatest(shape.height(F.col("n")) - 1, F.lit(lowest))), lambda level: level < shape.height(F.col("n")))
    asked = askers.select("tree", "own", "n", F.inline(F.flatten(F.transform(up, siblings))))
    held = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), shape.salts(F.col("level") - lowest + 1) - 1)))
    got = asked.join(held, ["tree", "level", "idx", "salt"]).groupBy("tree", "own").agg(F.array_sort(F.collect_list(F.struct("level", "idx", "digest"))).alias("_got"))
    rows = askers.join(got, ["tree", "own"], "left")
    some = lambda level, right: _joined(F.transform(F.filter(F.col("_got"), lambda x: (x["level"] == level) & ((x["idx"] > here(level)) if right else (x["idx"] < here(level)))), lambda x: x["digest"]))
    steps = F.transform(up, lambda level: F.struct(F.coalesce(some(level, False), F.lit("")).alias("before"), F.coalesce(some(level, True), F.lit("")).alias("after")))
    return rows.select("tree", "own", steps.alias("steps"))


def proofs(docs: DataFrame, fields: list[str], by: str = "source", order: str = "doc_id", claimed: Column | None = None, fan_in: int = 16) -> DataFrame:
    """One row for each row of docs: `order`, leaf, claimed, subroot, root (hex) and steps, the proof: what fold() needs to come from the leaf to the root.

    The leaves of each value of `by` lie in ascending order of `order`; every fan_in consecutive nodes, fewer in the last run, become
    the digest of their digests until one is left, a lone leaf itself: the subroot. The subroots, in ascending order of `by`, give the root
    in the same way. claimed: a leaf() of what a row is said to be, by default its own.

    Null values of `by` are a group of their own, the first; null ids come first; rows with equal ids lie in the order of their leaves. An empty table
    gives no rows; columns that aren't named are not looked at. Texts are hashed where they are read and never shuffled, however long. Places are
    found by ranges of (by, order, leaf), so a hot group is split. The siblings above the first level are the same for all leaves
    of a run, so the run asks once for all of them; those above the subroots are asked for once for each group."""
    shape = Shape(fan_in)
    own = leaf(*[F.col(f) for f in fields])
    key = value(F.col(by))
    rows = docs.select(F.col(order).alias("_order"), F.col(by).cast("string").alias("_by"), key.alias("_key"), F.unhex(own).alias("_leaf"), F.unhex(own if claimed is None else claimed).alias("_claimed"))
    leaves = numbered(rows, [F.col("_by"), F.col("_order"), F.col("_leaf")], "_place", "merkle-leaves").withColumn("_salt", salted("_key", "_leaf", 256))
    groups = leaves.groupBy("_key").agg(F.min("_place").alias("tree"), F.count("*").alias("n"), F.collect_set("_salt").alias("_salts"))
    groups = numbered(groups, [F.col("tree")], "rank", "merkle-groups")
    known = groups.select("_key", "tree", "n", F.explode("_salts").alias("_salt"))
    placed = leaves.join(known, ["_key", "_salt"]).withColumn("idx", F.col("_place") - F.col("tree"))

    member = F.struct("idx", F.col("_order").alias("order"), F.col("_leaf").alias("digest"), F.col("_claimed").alias("claimed"))
    runs = placed.groupBy("tree", _whole(F.col("idx"), F.lit(fan_in)).alias("own")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(member)).alias("run"))
    runs = stored(runs, "merkle-runs")
    sizes = groups.agg(F.max("n"), F.count("*")).head()
    heights = [sum(p < (n or 0) for p in shape.powers) for n in sizes]

    digest = F.unhex(F.sha2(_joined(F.col("run.digest")).cast("binary"), 256))
    lone = runs.where("n = 1").select("tree", F.lit(0).cast("long").alias("idx"), "n", F.col("run")[0]["digest"].alias("digest"))
    first = runs.where("n > 1").select("tree", F.col("own").alias("idx"), shape.count(F.col("n"), F.lit(1)).alias("n"), digest.alias("digest"))
    levels = _levels(lone, shape, heights[0], "merkle-nodes", first)
    table = lambda some, from_level: [df.select("tree", F.lit(i + from_level).alias("level"), "idx", "n", "digest") for i, df in enumerate(some)]

    def together(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    nodes = together(table(levels, 0))
    subroots = stored(nodes.where("n = 1").select("tree", "digest").join(groups.select("tree", "rank", F.col("n").alias("rows")), "tree"), "merkle-subroots")
    upper = _levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("rank").alias("idx"), F.lit(sizes[1]).cast("long").alias("n"), "digest"), shape, heights[1], "merkle-top")
    top = together(table(upper, 0))
    root = top.where("n = 1").select(F.col("digest").alias("root"))
    askers = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("rank").alias("own"), F.lit(sizes[1]).cast("long").alias("n"))
    above = _ask(askers, top.drop("n"), shape, 0).select(F.col("own").alias("rank"), F.col("steps").alias("above"))
    ends = subroots.join(above, "rank").crossJoin(F.broadcast(root))  # one root
    salts = lambda n: _whole(n - 1, F.lit(ROWS_PER_SALT)) + 1
    ends = ends.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), salts(F.col("rows")) - 1)).alias("_salt"), F.col("digest").alias("subroot"), "root", "above")

    within = _ask(runs.select("tree", "own", "n"), nodes.where("level > 0 and n > 1").drop("n"), shape, 1)
    whole = runs.join(within, ["tree", "own"]).withColumn("_salt", F.pmod("own", salts(F.col("n")))).join(ends, ["tree", "_salt"])
    each = whole.select("n", "run", "steps", "above", "subroot", "root", F.posexplode("run").alias("_pos", "m"))
    beside = F.struct(_joined(F.slice(F.col("run.digest"), F.lit(1), F.col("_pos"))).alias("before"), _joined(F.slice(F.col("run.digest"), F.col("_pos") + 2, F.lit(fan_in))).alias("after"))
    below = F.when(F.col("n") > 1, F.array(beside)).otherwise(F.array().cast("array<struct<before:string,after:string>>"))
    return each.select(F.col("m.order").alias(order), _text(F.col("m.digest")).alias("leaf"), _text(F.col("m.claimed")).alias("claimed"), _text(F.col("subroot")).alias("subroot"), _text(F.col("root")).alias("root"), F.concat(below, F.col("steps"), F.col("above")).alias("steps"))

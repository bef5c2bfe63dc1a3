"""Shards of nearly equal size out of groups that must not be cut: a minimax contiguous partition. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import salted, stored
from quillspark.llm.order import numbered

#: How many capacities are tried at once: a round of the search takes as many jobs as there are shards, whatever their number.
TRIED = 64


class Line:
    """The groups in their order, as running sums `upto` of their sizes (each at least 1), in a table sorted by it."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.total, self.largest = (x or 0 for x in groups.agg(F.max("upto"), F.max("bytes")).head())

    def last_within(self, limits: list[int], start: int = 0) -> list[int]:
        """For each limit, the largest running sum that isn't above it, `start` where there is none. One pass over the sums between."""
        some = self.groups.where((F.col("upto") > start) & (F.col("upto") <= max(limits)))
        found = some.agg(*[F.max(F.when(F.col("upto") <= x, F.col("upto"))).alias(f"m{i}") for i, x in enumerate(limits)]).head()
        return [start if x is None else x for x in found]

    def first_from(self, least: int) -> int:
        """The smallest running sum, 0 among them, that isn't below least."""
        return 0 if least <= 0 else self.groups.where(F.col("upto") >= least).agg(F.min("upto")).head()[0]

    def feasible(self, capacities: list[int], shards: int) -> list[bool]:
        """Whether the groups fit into so many shards: each is filled greedily, all capacities side by side."""
        ends = [0] * len(capacities)
        for _ in range(shards):
            if min(ends) == self.total:
                break
            ends = [max(a, b) for a, b in zip(ends, self.last_within([e + c for e, c in zip(ends, capacities, strict=True)], min(ends)), strict=True)]
        return [e == self.total for e in ends]

    def smallest_capacity(self, shards: int) -> int:
        """The least capacity that is feasible, by a search that cuts the range into TRIED + 1 parts a round.

        It lies between the mean (or the largest group, if larger) and the mean plus the largest group."""
        mean = -(-self.total // shards)
        low, high = max(mean, self.largest) - 1, mean + self.largest
        while high - low > 1:
            n = min(TRIED, high - low - 1)
            tried = [low + (high - low) * (i + 1) // (n + 1) for i in range(n)]
            fits = self.feasible(tried, shards)
            k = fits.index(True) if True in fits else n
            low, high = tried[k - 1] if k else low, tried[k] if k < n else high
        return high

    def cuts(self, shards: int) -> tuple[int, list[int]]:
        """The smallest capacity, and the running sums at which the shards end but for the last.

        Under that capacity each cut is as close as it can be to an equal share of what is left, and not before the place from
        where the rest just fits, so that the other shards are near equal too if one group is large."""
        capacity = self.smallest_capacity(shards)
        fits = [self.total]  # fits[k]: from here on k shards do
        while len(fits) < shards:
            fits.append(self.first_from(fits[-1] - capacity))
        at, out = 0, []
        for left in range(shards, 1, -1):
            if at == self.total:
                out.append(at)
                continue
            share = at + (self.total - at) // left
            below, within = self.last_within([max(share, at), min(at + capacity, self.total)], at)
            above = min(self.first_from(share + 1), within) if share < within else within
            options = [x for x in (below, above, within) if max(fits[left - 1], at + 1) <= x <= at + capacity]
            at = min(options, key=lambda x: (abs(x - share), x))
            out.append(at)
        return capacity, out


def shards(docs: DataFrame, count: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to count - 1) and slot (gapless from 0 in its shard) for each row of docs; equal texts share a shard.

    The groups of equal texts lie in the order of their smallest id; the shards are consecutive groups, and the largest shard is as small as
    any such partition allows. size: the UTF-8 bytes of the text and 1. Null texts have no bytes and lie with the empty ones; null ids
    come first; repeated rows are rows of their own. With fewer groups than shards some shards are empty. An empty table gives no
    rows; other columns are not looked at, whatever their names.

    Texts are read once and shuffled as 16 bytes of digest. Groups are summed before the shuffle; a group's place goes back to its rows over
    salts, and the rows are numbered by ranges, so that a group of copies may hold any share of them. At the driver there are counts, limits
    and cuts, some numbers for each shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_text"))
    rows = stored(rows, "shard-rows").withColumn("_salt", salted("_text", F.struct("doc_id"), 256))
    groups = rows.groupBy("_text").agg(F.min("doc_id").alias("_first"), F.sum("size").alias("bytes"), F.count("*").alias("_n"), F.collect_set("_salt").alias("_salts"))
    groups = numbered(groups, [F.col("_first"), F.col("_text")], "_place", "shard-groups", {"upto": "bytes"})
    groups = stored(groups.repartitionByRange("upto").sortWithinPartitions("upto"), "shard-line")
    line = Line(groups.select("upto", "bytes"))
    cuts = line.cuts(count)[1] if line.total else []
    shard = sum((F.when(F.col("upto") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    sizes = {r[0]: r[1] for r in groups.groupBy(shard.alias("s")).agg(F.sum("_n")).collect()}  # one row a shard
    before = [sum(n for s, n in sizes.items() if s < k) for k in range(count)]
    held = groups.select("_text", "upto", shard.cast("int").alias("shard"), F.explode("_salts").alias("_salt"))
    placed = rows.join(held, ["_text", "_salt"]).select("doc_id", "size", "text_crc32", "shard", "upto")
    placed = numbered(placed, [F.col("upto"), F.col("doc_id")], "_place", "shard-places")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.get(F.lit(before).cast("array<bigint>"), F.col("shard"))).alias("slot"))

"""Exact Jaccard join of word n-grams, filtered by the prefixes of several global orders at once.

If two sets are alike to the degree t, then under *any* order of all tokens the first n - ceil(t*n) + 1 tokens of
either share one. So a pair is a candidate only if it shares prefix tokens under each of three orders: by frequency, and
by a hash upwards and downwards. The first makes the candidates, the other two are intersected with it. Both are read from
a set's image, 16 bits of each of its tokens in a byte or so, which nearly always tells whether two sets link. Only where it
doesn't are texts fetched and sets compared, so that whole sets stay out of the shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import drop_stored, slices, small_batches, split_words, stored, with_group_value
from quillspark.llm.components import components

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The hashes of each text's distinct k-word shingles, ascending. With fewer words the whole sequence is one; without words there is none."""
    for some in slices(texts):
        starts, numbers, words = split_words(some, lower=True)
        h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))[numbers]
        g = _rolled(h, k) if len(h) >= k else h[:0]
        for lo, hi in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            n = hi - lo
            if n < k:
                yield _rolled(h[lo:hi] + np.uint64(n), n) if n else h[:0]
                continue
            s = np.sort(g[lo : hi - k + 1])
            new = s[1:] != s[:-1]
            yield s if new.all() else s[np.concatenate([[True], new])]


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    g = h[:n].copy()
    for i in range(1, k):
        g *= _ODD
        g ^= g >> np.uint64(31)
        g += h[i : n + i]
    return _mix(g)


@dataclass(frozen=True)
class Alike:
    """Two sets link when 100 * intersection >= percent * union."""

    k: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        return n + (-self.percent * n // 100) + 1

    def least(self) -> int:
        """Smaller sets link with equal ones only: a set of n and one of n + 1 that holds it."""
        n = 1
        while 100 * n < self.percent * (n + 1):
            n += 1
        return n

    def sizes(self, a: Column, b: Column) -> Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def near(self, n_a: Column, n_b: Column, parity_a: Column, parity_b: Column) -> Column:
        """Never false for sets that link: where their parities differ, so do the sets, and linked ones differ in few tokens."""
        differ = sum((F.bit_count(F.get(parity_a, F.lit(i)).bitwiseXOR(F.get(parity_b, F.lit(i)))) for i in range(PARITY)), F.lit(0))
        return self.sizes(n_a, n_b) & ((100 + self.percent) * differ <= (100 - self.percent) * (n_a + n_b))

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def judged(self, a: np.ndarray, b: np.ndarray) -> bool | None:
        """Whether sets with these images link; None if only the sets can tell.

        Images share at least what their sets share, so a no is certain. They share more only where tokens that the sets don't
        share have equal images: for a wrong yes, so many pairs of them that the chance is below 2^-64, that of equal hashes."""
        n = len(a) + len(b)
        p, q = self.prefix(len(a)), self.prefix(len(b))
        if not (len(np.intersect1d(a[:p], b[:q])) and len(np.intersect1d(a[-p:], b[-q:]))):
            return False
        both, need = len(np.intersect1d(_numbered(a), _numbered(b), assume_unique=True)), -(-self.percent * n // (100 + self.percent))
        if both < need:
            return False
        over = both - need + 1
        chance = (len(a) - need + 1) * (len(b) - need + 1) / 65536
        return True if chance <= 0 or over * math.log(chance) - math.lgamma(over + 1) < -64 * math.log(2) else None


def _numbered(image: np.ndarray) -> np.ndarray:
    """Equal numbers of an ascending image are told apart by their places among them."""
    return (image << 32) | (np.arange(len(image)) - np.searchsorted(image, image))


def image_bytes(s: np.ndarray) -> bytes:
    """The image of an ascending set, the upper 16 bits of its tokens: their steps, in bytes of which 255 is carried on."""
    steps = np.diff((s >> np.uint64(48)).astype(np.int64), prepend=0)
    ends = np.cumsum(steps // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = steps % 255
    return out.tobytes()


def image(raw: pa.Buffer | bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


def _bytes(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def frequencies(docs: DataFrame, alike: Alike, bits: int = 22, slices: int = 16) -> np.ndarray:
    """For each of 2^bits buckets of tokens, how many sets have one of them, on a scale of logarithms (8 steps to a doubling).

    All documents count. It is a sketch of fixed size that orders the tokens; any order gives whole results."""
    size, cut = 1 << bits, np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        total, held, n = np.zeros(size, np.uint32), [], 0
        for b in batches:
            for s in shingle_sets(b.column("text"), alike.k):
                held.append((s >> cut).astype(np.uint32))
                n += len(held[-1])
                if n > 2_000_000:
                    total += np.bincount(np.concatenate(held), minlength=size).astype(np.uint32)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size).astype(np.uint32)
        if total.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(total, slices)]
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), _bytes(parts)], names=["part", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        import zlib

        total = np.zeros(size // slices, np.uint32)
        for x in table.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
        return pa.table({"part": table.column("part")[:1], "counts": _bytes([zlib.compress(total.tobytes(), 1)])})

    # two steps, so that no task merges the sketches of all others
    first = docs.select("text").mapInArrow(run, "part int, counts binary").withColumn("_pid", F.pmod(F.spark_partition_id(), F.lit(32)))
    some = first.groupBy("part", "_pid").applyInArrow(lambda t: merge(t), "part int, counts binary")
    merged = some.groupBy("part").applyInArrow(lambda t: merge(t), "part int, counts binary")
    import zlib

    ranks = np.zeros(size, np.uint8)
    for r in merged.collect():  # compressed; the driver never holds all counts at once
        total = np.frombuffer(zlib.decompress(bytes(r[1])), np.uint32)
        ranks[r[0] * (size // slices) : (r[0] + 1) * (size // slices)] = np.minimum(255, np.round(8 * np.log2(1.0 + total)))
    return ranks


#: How many classes of another component a class is compared with in a round, before pairs are.
HUBS = 5
#: A token with at most so many classes outside its largest place makes at most so many pairs for each of its rows, and needs no more rounds.
SPARE = 8
#: The rounds end when other tokens' pairs are at most so many for each row of shared tokens.
REST = 0.25
#: Longs of parity bits: each token of a set turns one bit over.
PARITY = 4
CLASS = "cid long, sig binary, n long, cold int, parity array<long>, first array<long>, image binary"


def measured(docs: DataFrame, alike: Alike, ranks: np.ndarray) -> DataFrame:
    """The docs' doc_id and tag, and of each text's set: its hash, size, prefix by frequency and image."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    cut = np.uint64(64 - int(np.log2(len(ranks))))
    hot = float(np.percentile(ranks, 99.9)) + 16  # four times what a usual bucket holds
    least = alike.least()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for b in batches:
            rows = []
            for s in shingle_sets(b.column("text"), alike.k):
                raw, n = s.tobytes(), len(s)
                sig = xxhash.xxh3_128_digest(raw)
                about, cold = [None] * 3, 0
                if n >= least:
                    p = alike.prefix(n)
                    rank = ranks[(s >> cut).astype(np.int64)].astype(np.uint64)
                    order = np.argsort((rank << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")[:p]
                    cold = int((rank[order] <= hot).sum())
                    parity = np.packbits((np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1).astype(np.uint8)).view(np.int64)
                    about = [parity, s[order].view(np.int64), image_bytes(s)]
                rows.append((int.from_bytes(sig[:8], "little", signed=True), sig, n, cold, *about))
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), *cols], names=["doc_id", "tag", *(c.split()[0] for c in CLASS.split(", "))])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, " + CLASS)


def _sets(docs: DataFrame, alike: Alike) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.tobytes() for x in shingle_sets(b.column("text"), alike.k)]
            yield pa.RecordBatch.from_arrays([_bytes([xxhash.xxh3_128_digest(x) for x in raw]), _bytes(raw)], names=["sig", "set"])

    return docs.mapInArrow(run, "sig binary, set binary")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, alike: Alike, name: str) -> DataFrame:
    """The pairs (x, y) of classes that link, also as sigs a and b; sizes and parity bits have let them pass.

    First their images are compared; only what these leave open has its texts fetched and its sets compared."""
    # tables of their own: where they are small, Spark knows so and doesn't shuffle all classes and texts to find a few
    needed = stored(pairs.select(F.col("x").alias("cid")).union(pairs.select("y")).distinct(), f"jaccard-{name}-ids")
    about = stored(classes.join(needed, "cid", "left_semi").select("cid", "sig", "doc_id", "tag", "image"), f"jaccard-{name}-about")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            view = lambda c: [image(x.as_buffer()) for x in b.column(c)]
            found = [alike.judged(p, q) for p, q in zip(view("image_x"), view("image_y"), strict=True)]
            b, sure = b.filter(pa.array([x is not False for x in found], pa.bool_())), pa.array([x is True for x in found if x is not False], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("x", "y", "a", "b")), sure], names=["x", "y", "a", "b", "sure"])

    x = about.select(F.col("cid").alias("x"), F.col("sig").alias("a"), F.col("image").alias("image_x"))
    y = about.select(F.col("cid").alias("y"), F.col("sig").alias("b"), F.col("image").alias("image_y"))
    seen = pairs.select("x", "y").join(y, "y").join(x, "x").select("x", "y", "a", "b", "image_x", "image_y")
    seen = stored(seen.mapInArrow(judge, "x long, y long, a binary, b binary, sure boolean"), f"jaccard-{name}-judged")
    links, left = seen.where("sure").drop("sure"), stored(seen.where("not sure").drop("sure"), f"jaccard-{name}-candidates")
    done = [needed, about]
    if left.head(1):
        links = stored(links.union(_compared_sets(left, about, docs, alike, name)), f"jaccard-{name}-links")
        done.append(seen)
    for old in [*done, left]:
        drop_stored(old)
    return links


def _compared_sets(pairs: DataFrame, about: DataFrame, docs: DataFrame, alike: Alike, name: str) -> DataFrame:
    """Those of the pairs (x, y, and the sigs a and b) whose sets link."""
    needed = pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))
    texts = stored(about.join(needed, "sig", "left_semi").select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")), f"jaccard-{name}-needed")
    fetched = docs.join(texts, docs["doc_id"].eqNullSafe(F.col("_d")) & (docs["tag"] == F.col("_t")), "left_semi").dropDuplicates(["doc_id", "tag"])
    sets = stored(_sets(fetched.select("text"), alike), f"jaccard-{name}-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            view = lambda c: [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(c)]
            ok = pa.array([alike.links(p, q) for p, q in zip(view("set_x"), view("set_y"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("x", "y", "a", "b")], names=["x", "y", "a", "b"])

    x, y = (sets.select(F.col("sig").alias(c), F.col("set").alias(f"set_{n}")) for c, n in ("ax", "by"))
    return pairs.join(y, "b").join(x, "a").select("x", "y", "a", "b", "set_x", "set_y").mapInArrow(run, "x long, y long, a binary, b binary")


def _hubs(turn: int) -> list[Column]:
    return [F.min_by("cid", F.xxhash64(F.lit(HUBS * turn + i), "cid")) for i in range(HUBS)]


def _compared(met: DataFrame, classes: DataFrame, alike: Alike, name: str) -> DataFrame:
    """Of the hubs that classes met (cid, hubs, and `to`, the hubs' place), the five that each met at most tokens and that parity bits don't rule out: x, y, to."""
    times = met.select("cid", F.explode(F.array_distinct("hubs")).alias("h"), "to").where("cid <> h").groupBy("cid", "h").agg(F.count("*").alias("times"), F.min("to").alias("to"))
    times = stored(times, f"jaccard-{name}-met")
    about = {c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}")) for c in ("cid", "h")}
    likely = times.join(about["cid"], "cid").join(about["h"], "h").where(alike.near(F.col("n_cid"), F.col("n_h"), F.col("p_cid"), F.col("p_h")))
    best = Window.partitionBy("cid").orderBy(F.col("times").desc(), "h")
    stars = likely.select("cid", "h", "to", F.row_number().over(best).alias("nth")).where(F.col("nth") <= HUBS)
    return stored(stars.select(F.col("cid").alias("x"), F.col("h").alias("y"), "to"), f"jaccard-{name}")


def linked_rows(docs: DataFrame, alike: Alike = Alike(), most_turns: int = 8) -> DataFrame:
    """doc_id, tag (a hash of the text), n (size of its set) and root (its component, by any name) of every row of docs (doc_id, text).

    Documents with equal sets are one class from the start, however many they are. In the first turn, classes whose prefixes share a
    token are compared with five hubs at most that their parity bits don't rule out, those which they meet at most of their
    tokens; what links becomes one place. In each later turn, at each token with many classes outside the place that has most
    of its classes, those are compared with other hubs, of that place. So a group of near copies takes some times as
    many comparisons as it has members. The turns end when the pairs of different places that share a token are few for the
    size of the table, when a turn links few of those compared, or after most_turns; all such pairs are then compared one by one. So no link that joins
    two components is missed, whatever the turns found, and no pairs within a group are listed.

    A document without words (null, empty or blank) has n = 0 and no root. Null and repeated ids: each row has its own text. An empty
    table gives no rows. Other columns are not looked at."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    whole = stored(measured(base, alike, frequencies(base, alike)), "jaccard-whole")
    one = whole.where("first is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "tag", "cid", "n", "cold", "parity", "first", "image")).alias("r"))
    classes = stored(one.select("r.*", "sig"), "jaccard-classes")
    rows = stored(whole.select("doc_id", "tag", "cid", "sig", "n", F.col("first").isNotNull().alias("meets")), "jaccard-rows")
    drop_stored(whole)

    tokens = classes.select("cid", "n", "cold", F.posexplode("first").alias("at", "token"))
    # a cold token has few rows for the size of the table, so that they can meet in a window; a hot one isn't alone and needn't be counted
    cold = tokens.where("at < cold").withColumn("size", F.count("*").over(Window.partitionBy("token"))).where("size > 1")
    shared = stored(cold.select("token", "at", "cid", "n").union(tokens.where("at >= cold").select("token", "at", "cid", "n")), "jaccard-shared")
    tops = stored(shared.groupBy("token").agg(F.count("*").alias("size"), F.array(*_hubs(0)).alias("hubs")).where("size > 1").select("token", "hubs"), "jaccard-hubs")
    stars = _compared(shared.join(tops, "token").select("cid", "hubs", F.lit(None).cast("long").alias("to")), classes, alike, "stars")
    first = _verified(stars.select("x", "y"), classes, base, alike, "star")

    sigs = rows.where("meets").select("cid", "sig").distinct()
    found = stored(components(first), "jaccard-found")
    places = stored(_places(found, sigs), "jaccard-places")
    spots = shared.join(places, "cid", "left").withColumn("place", F.coalesce("place", "cid"))
    mixed = spots.groupBy("token").agg(F.min("place").alias("_lo"), F.max("place").alias("_hi"), F.count("*").alias("size")).where("_lo <> _hi").select("token", "size")
    spots = stored(spots.join(mixed, "token"), "jaccard-spots")

    def tops_of(spots: DataFrame, turn: int) -> DataFrame:
        groups = spots.groupBy("token", "place").agg(F.count("*").alias("m"), F.array(*_hubs(turn)).alias("hubs"))
        tops = groups.groupBy("token").agg(F.sum("m").alias("size"), F.max(F.struct("m", F.xxhash64(F.lit(turn), "place").alias("by"), "place", "hubs")).alias("top"))
        return stored(tops.select("token", "size", F.col("top.m").alias("m"), F.col("top.place").alias("to"), "top.hubs"), "jaccard-hubs")

    links, many = [found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")], REST * shared.count()
    crowd, moves = spots.where(F.col("size") > SPARE + 1).drop("size"), None
    for turn in range(1, most_turns + 1):
        tops = tops_of(crowd, turn).where(F.col("size") - F.col("m") > SPARE)
        if (tops.agg(F.sum(F.col("size") * (F.col("size") - F.col("m")))).head()[0] or 0) <= many:
            break
        crowd = stored(crowd.join(tops.select("token", "to", "hubs"), "token"), "jaccard-crowd")
        stars = _compared(crowd.where("place <> to"), classes, alike, "stars")
        more = _verified(stars.select("x", "y"), classes, base, alike, "turn")
        moved = stored(more.join(stars, ["x", "y"]).groupBy(F.col("x").alias("cid")).agg(F.min("to").alias("to")), "jaccard-moved")
        links.append(more.select("a", "b"))
        n_moved = moved.count()
        if not n_moved:
            break
        crowd = crowd.drop("to", "hubs").join(moved, "cid", "left").withColumn("place", F.coalesce("to", "place")).drop("to")
        now = moved.select("cid", "to", F.lit(turn).alias("turn"))
        moves = now if moves is None else moves.union(now)
        if 8 * n_moved < stars.select("x").distinct().count():
            break
    if moves is not None:
        moves = stored(moves.groupBy("cid").agg(F.max_by("to", "turn").alias("to")), "jaccard-moves")
        spots = stored(spots.join(moves, "cid", "left").withColumn("place", F.coalesce("to", "place")).drop("to"), "jaccard-spots")
    tops = tops_of(spots.where(F.col("size") > SPARE + 1).drop("size"), 0).select("token", F.col("to").alias("top"))

    # what is left: a class outside the place with most, and any class of another place, that may link and share a token
    spots = spots.join(tops, "token", "left").join(classes.select("cid", "parity"), "cid")
    x, y = (spots.select("token", "top", *[F.col(c).alias(f"{c}_{s}") for c in ("at", "cid", "n", "place", "parity")]) for s in "xy")
    # what can follow the first token that two sets share must be enough; later ones needn't find the pair again
    enough = (100 + alike.percent) * F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= alike.percent * (F.col("n_x") + F.col("n_y"))
    once = F.coalesce(F.col("place_y") == F.col("top"), F.lit(False)) | (F.col("cid_x") < F.col("cid_y"))
    x = x.where("top is null or place_x <> top").drop("top")
    meet = x.join(y, (x["token"] == y["token"]) & (F.col("place_x") != F.col("place_y")) & once & enough & alike.near(F.col("n_x"), F.col("n_y"), F.col("parity_x"), F.col("parity_y")))
    rest = meet.select(F.col("cid_x").alias("x"), F.col("cid_y").alias("y")).distinct()
    second = _verified(stored(rest, "jaccard-rest"), classes, base, alike, "rest")

    for more in [*links[1:], second.select("a", "b")]:
        links[0] = links[0].union(more)
    roots = stored(components(links[0]), "jaccard-roots").withColumnRenamed("node", "sig")
    return rows.select("doc_id", "tag", "n", "sig").join(roots, "sig", "left").select("doc_id", "tag", "n", F.when(F.col("n") > 0, F.coalesce("root", "sig")).alias("root"))


def _places(found: DataFrame, sigs: DataFrame) -> DataFrame:
    """cid and place, a number for its component, of every class that has links."""
    return sigs.join(found.withColumnRenamed("node", "sig"), "sig").groupBy("cid").agg(F.min(F.xxhash64("root")).alias("place"))


def linked(docs: DataFrame, alike: Alike = Alike()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of every row of docs; see linked_rows.

    A document without words links with nothing: its component is its own id. A component's id is the smallest that
    isn't null, or null if there is none."""
    rows = linked_rows(docs, alike)
    whole = with_group_value(rows.where("n > 0"), ["root"], F.min("doc_id"), "component_id", "tag")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return whole.select("doc_id", "n", "component_id").union(alone).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, alike: Alike = Alike()) -> DataFrame:
    """The rows of docs without all but one of each component: that with the smallest doc_id stays, and all its columns.

    Documents without words stay. Rows that agree in id and text are one. Texts are shuffled once, by id and hash, to be kept or dropped."""
    rows = stored(linked_rows(docs, alike), "jaccard-roots")
    first = rows.where("n > 0").groupBy("root").agg(F.min(F.struct(_key("doc_id").alias("id"), "tag")).alias("r")).select("r.id", "r.tag")
    keep = first.union(rows.where("n = 0").select(_key("doc_id"), "tag")).select(F.col("id").alias("_id"), F.col("tag").alias("_tag"))
    tag = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.select(F.struct("*").alias("_row"), _key("doc_id").alias("_id"), tag.alias("_tag"))  # in a struct no column's name can clash
    return keyed.join(keep, ["_id", "_tag"], "left_semi").dropDuplicates(["_id", "_tag"]).select("_row.*")


def _key(name: str) -> Column:
    """An id to join on; null becomes the largest, so that a known one is kept rather."""
    return F.coalesce(F.col(name).cast("long"), F.lit((1 << 63) - 1))

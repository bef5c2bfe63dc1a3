"""SimHash fingerprints of documents, and the search for all fingerprints within a Hamming radius. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import stored

BITS = 128
#: Bit 0 and bit 32 of a word: two counters of 32 bits are added up in one long.
_LANES = 0x0000000100000001
#: Of the pairs of the test tables whose sets of five-word shingles are alike by 0.8 or more, all lie within 23 bits, half within 14; texts
#: that have nothing to do with each other lie about 64 apart. Eight tables are exact up to 23 bits with two flipped in a block.
RADIUS, BLOCKS = 23, 8


def terms(text: Column, window: int = 3) -> Column:
    """Each word of the lower-cased text with the words after it, `window` in all, fewer at the end: array of structs."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")), " ")
    parts = [words if k == 0 else F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - k, F.lit(0))) for k in range(window)]
    return F.arrays_zip(*[p.alias(f"t{k}") for k, p in enumerate(parts)])


def fingerprints(rows: DataFrame, keys: list[str], text_col: str, window: int = 3) -> DataFrame:
    """keys, hi and lo: the fingerprint of each row's whole text. Rows with equal keys must have equal texts; they give one row.

    A term's weight is how often it occurs. Each occurrence votes on 128 bits, those of two hashes of the term; a bit is set if
    over half of the votes are for it, so a text without words has none. The votes are summed in the map tasks: what
    is shuffled is one row of 64 sums for a text, however long it is."""
    named = rows.select(*keys, F.col(text_col).alias("_text"))
    each = named.select(*keys, F.inline(terms(F.col("_text"), window)).alias(*[f"_t{k}" for k in range(window)]))
    cols = [F.col(f"_t{k}") for k in range(window)]
    hashed = each.select(*keys, F.when(F.col("_t0") != "", F.xxhash64(*cols)).alias("_h0"), F.when(F.col("_t0") != "", F.xxhash64(F.lit(1), *cols)).alias("_h1"))
    sums = [F.sum(F.shiftrightunsigned(f"_h{w}", i).bitwiseAND(F.lit(_LANES))).alias(f"_s{w}_{i}") for w in (0, 1) for i in range(32)]
    votes = hashed.groupBy(*keys).agg(F.count("_h0").alias("_n"), *sums)

    def half(w: int) -> Column:
        word = F.lit(0).cast("long")
        for i in range(32):
            s = F.col(f"_s{w}_{i}")
            for bit, ones in ((i, s.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(s, 32))):
                value = (1 << bit) - (1 << 64 if bit == 63 else 0)
                word = word.bitwiseOR(F.when(2 * ones > F.col("_n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
        return word

    return votes.select(*keys, half(0).alias("hi"), half(1).alias("lo"))


def as_string(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def _blocks(hi: Column, lo: Column, blocks: int) -> list[Column]:
    """The bits of each block; half of the blocks are cut from either word."""
    if blocks % 2:
        raise ValueError("blocks must be even")
    half = blocks // 2
    edges = [64 * i // half for i in range(half + 1)]
    return [F.shiftrightunsigned(word, 64 - edges[i + 1]).bitwiseAND(F.lit(_mask(edges[i + 1] - edges[i]))) for word in (hi, lo) for i in range(half)]


def _mask(width: int) -> int:
    return (1 << width) - 1 if width < 64 else -1


def _flips(width: int, most: int) -> list[int]:
    """The masks that flip at most so many of a block's bits."""
    flips = [sum(1 << i for i in some) for k in range(most + 1) for some in combinations(range(width), k)]
    return [x - (1 << 64) if x >> 63 else x for x in flips]


def _tables(prints: DataFrame, blocks: int) -> DataFrame:
    """One row per fingerprint and block table: its columns, _table and _bits."""
    cut = _blocks(F.col("hi"), F.col("lo"), blocks)
    return prints.select("*", F.posexplode(F.array(*cut)).alias("_table", "_bits"))


def near_rows(prints: DataFrame, is_query: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """For each distinct fingerprint among the query rows: hi, lo and n_near, how many rows of prints, queries and all,
    lie within the radius, those with the same fingerprint included. Copies are counted by class, not by pairs.

    Fingerprints that differ in at most `radius` bits differ in at most radius // blocks of some block, so the tables are exact: each
    has all fingerprints by the bits of one block, and a query looks up those of its own block with up to so many bits
    flipped. A pair counts in the first table where it meets. The fingerprints of a key are one array, counted in place:
    the pairs of a large group of near copies are compared but are never rows."""
    widths = {64 * (i + 1) // (blocks // 2) - 64 * i // (blocks // 2) for i in range(blocks // 2)}
    flips = {w: _flips(w, radius // blocks) for w in widths}
    sizes = prints.groupBy("hi", "lo").agg(F.count("*").alias("_rows"))
    held = _tables(sizes, blocks).groupBy("_table", "_bits").agg(F.collect_list(F.struct("hi", "lo", "_rows")).alias("_held"))
    asked = prints.where(is_query).select("hi", "lo").distinct()
    half = blocks // 2
    by_table = {w: [t for t in range(blocks) if 64 * (t % half + 1) // half - 64 * (t % half) // half == w] for w in widths}
    probes = [_tables(asked, blocks).where(F.col("_table").isin(by_table[w])).select("hi", "lo", "_table", "_bits", F.explode(F.lit(flips[w]).cast("array<bigint>")).alias("_flip")) for w in sorted(widths)]
    probe = reduce(DataFrame.unionByName, probes).select("hi", "lo", "_table", F.col("_bits").bitwiseXOR(F.col("_flip")).alias("_bits"))

    def counted(y: Column) -> Column:
        x = [F.col("hi").bitwiseXOR(y["hi"]), F.col("lo").bitwiseXOR(y["lo"])]
        first = reduce(lambda rest, tb: F.when(F.bit_count(tb[1]) <= radius // blocks, F.lit(tb[0])).otherwise(rest), list(enumerate(_blocks(*x, blocks)))[::-1], F.lit(blocks))
        return F.when((F.bit_count(x[0]) + F.bit_count(x[1]) <= radius) & (first == F.col("_table")), y["_rows"]).otherwise(F.lit(0).cast("long"))

    # merged: Spark takes the probes for as few as the queries that they are made of, and would broadcast them
    met = probe.join(held.hint("merge"), ["_table", "_bits"]).select("hi", "lo", F.aggregate("_held", F.lit(0).cast("long"), lambda n, y: n + counted(y)).alias("_n"))
    return met.groupBy("hi", "lo").agg(F.sum("_n").alias("n_near"))


def _place(cuts: list[int], value: Column) -> Column:
    """How many of the ascending cuts are not above the value. Two steps of the root of their number: first the run of cuts, then the place in it."""
    if not cuts:
        return F.lit(0)
    width = max(1, isqrt(len(cuts)))
    runs = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda some: F.size(F.filter(some, lambda c: c <= value))
    run = below(F.lit([r[0] for r in runs]).cast("array<bigint>"))
    inner = F.get(F.lit(runs).cast("array<array<bigint>>"), run - 1)
    return F.when(run == 0, 0).otherwise((run - 1) * width + below(inner))


def in_order(base: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """base (doc_id, digest, ...) with _bucket: the rows in order of doc_id and digest, null first, cut into buckets of about equal size,
    and after each bucket's rows, marked _extra, the first row of the next bucket; after the last one, that of the first.

    The cuts are approximate percentiles of the ids; they and one id per bucket of 100,000 rows meet at the driver, some 16 bytes for each."""
    spark = base.sparkSession
    want = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), base.count() // per_bucket)
    n = max(1, want)
    cuts = base.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 40_000)).head()[0] or []
    cuts = sorted(set(cuts))
    bucket = _place(cuts, F.col("doc_id"))
    placed = base.withColumn("_bucket", F.coalesce(F.when(F.col("doc_id").isNotNull(), bucket), F.lit(0))).withColumn("_extra", F.lit(False))
    firsts = sorted(placed.groupBy("_bucket").agg(F.min(F.struct("doc_id", "digest")).alias("f")).collect(), key=lambda r: r[0])
    before = [(firsts[i - 1]["_bucket"], *r["f"]) for i, r in enumerate(firsts)]
    extra = F.broadcast(spark.createDataFrame(before, "_to int, _id long, _digest binary"))
    added = base.join(extra, base["doc_id"].eqNullSafe(extra["_id"]) & (base["digest"] == extra["_digest"])).select(*base.columns, F.col("_to").alias("_bucket"), F.lit(True).alias("_extra"))
    return placed.unionByName(added)


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness: one row per row of docs (doc_id, text).

    Edited: the last floor(n_chars/2) code points are replaced by the first as many, or all, of the next document, by doc_id.
    Null texts count as empty. Rows with equal doc_id follow each other by the digest of their texts; null is an id like any other, the
    smallest. A very long text takes some times its size in one task, see fingerprints(). An empty table gives no rows; other columns aren't looked at. n_near, for rows whose id is divisible by
    20: how many rows' fingerprints lie within `radius` bits, its own row included.

    Whole texts are shuffled once, into buckets of neighbouring ids; the next text is then the next row, and the
    votes are summed where the texts are. Hot sources and copies have no part in how rows are dealt."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha1(F.col("text").cast("binary"))))
    order = Window.partitionBy("_bucket").orderBy("_extra", F.col("doc_id").asc_nulls_first(), "digest")
    rows = in_order(base).select("_bucket", "_extra", "doc_id", "text", F.row_number().over(order).alias("_nth"), F.lead("text").over(order).alias("_after"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left(F.coalesce("_after", F.lit("")), half))
    keys = ["_bucket", "_nth", "_extra", "doc_id", "kind", "n_chars", "sha"]
    rows = rows.select("_bucket", "_nth", "_extra", "doc_id", "text", edited.alias("edited"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(t).alias("t"), n.cast("long").alias("n_chars"), sha.alias("sha")) for k, t, n, sha in ((0, "text", F.length("text"), F.lit("")), (1, "edited", F.lit(0), F.sha2(F.col("edited").cast("binary"), 256)))]
    both = rows.select("_bucket", "_nth", "_extra", "doc_id", F.inline(F.array(*kinds))).where("kind = 0 or not _extra")
    found = fingerprints(both, keys, "t")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{c}_{kind}")
    prints = stored(found.groupBy("_bucket", "_nth", "_extra", "doc_id").agg(*[pick(k, c) for k in (0, 1) for c in ("hi", "lo")], pick(0, "n_chars"), pick(1, "sha")), "simhash-prints")
    follow = Window.partitionBy("_bucket").orderBy("_nth")
    table = prints.select("*", F.lead("hi_0").over(follow).alias("n_hi"), F.lead("lo_0").over(follow).alias("n_lo")).where("not _extra")
    own = prints.where("not _extra").select("doc_id", F.col("hi_0").alias("hi"), F.col("lo_0").alias("lo"))
    near = near_rows(own, F.col("doc_id") % 20 == 0, radius).withColumnsRenamed({"hi": "_h", "lo": "_l"})
    table = table.join(near, (table["hi_0"] == near["_h"]) & (table["lo_0"] == near["_l"]) & (table["doc_id"] % 20 == 0), "left")
    mine, theirs, others = ((F.col(a), F.col(b)) for a, b in (("hi_0", "lo_0"), ("hi_1", "lo_1"), ("n_hi", "n_lo")))
    return table.select("doc_id", F.col("n_chars_0").alias("n_chars"), F.col("sha_1").alias("edited_sha256"), as_string(*mine).alias("fingerprint"), as_string(*theirs).alias("edited_fingerprint"), likeness(mine, theirs).alias("near_edited"), likeness(mine, others).alias("near_next"), "n_near")

"""A stored BM25 index in segments, with the best chunks found without reading all of it.

Tables below a path, parted by `segment`; a segment is what one delivery added and took away:
  chunks  by, doc_id, chunk_id, digest, dl, tokens    the chunks it added, the tokens of each sorted, so that they take little room
  gone    by, chunk_id                                chunks of earlier segments that it replaced or removed
  blocks  by, term, block, n, front, ids, tfs, dls    postings, the most telling first, BLOCK to a row; sorted by term
  terms   by, term, df                                how many chunks more (or fewer) have the term
  totals  by, n, dl, deliveries                       how many chunks and tokens more (or fewer); written last: without it a segment isn't there
A segment that is written again replaces itself, so a broken-off or repeated delivery does no harm.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import bm25
from quillspark.shared import exists, folders, forget, scratch, small, small_batches

#: Postings of a block.
BLOCK = 128
#: So many times k chunks are scored as a whole for a first bound.
AHEAD = 4
#: Scores are compared after rounding to nine digits.
SLACK = 2e-9
#: Postings that a map task packs at once, those of a part of the index, and the fewest for which there is one more part; how many thousandths of score aren't parted.
HELD, PART, LEAST, STEP = 1_000_000, 1_000_000, 50_000, 8
#: Chunks, about, by whose postings the parts' bounds are set.
SAMPLED = 4096
#: Rows of a file of which a bitmap tells.
BITS = 32_768
#: Sorted strings are written as what they have more than their predecessor.
SORTED = {"parquet.writer.version": "v2", "parquet.enable.dictionary#tokens.list.element": "false"}
#: The order of postings within a term is that of scores with these constants; bounds hold for any.
ORDER_K1, ORDER_B = 1.5, 0.75


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass(frozen=True)
class Segments:
    """The index below a path; by: columns whose values have statistics of their own, such as collection."""

    spark: SparkSession
    path: str
    by: tuple[str, ...] = ()
    _schemas: dict[str, ty.StructType] = field(default_factory=dict, compare=False)

    def numbers(self) -> list[int]:
        """Whole segments, ascending; found by their folders' names alone."""
        some = [n.removeprefix("segment=") for n in folders(self.spark, f"{self.path}/totals")]
        return sorted(int(n) for n in some if n.isdigit() and exists(self.spark, f"{self.path}/totals/segment={n}/_SUCCESS"))

    def table(self, name: str, before: int | None = None) -> DataFrame | None:
        """A table's rows of all whole segments, or of those before one; None where there are none."""
        some = [n for n in self.numbers() if before is None or n < before]
        if not some:
            return None
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(f"{self.path}/{name}/segment={some[0]}").schema.add("segment", ty.IntegerType())
        return self.spark.read.schema(self._schemas[name]).parquet(f"{self.path}/{name}").where(F.col("segment").isin(some))

    def deliveries(self) -> list[str]:
        """Names of the deliveries that the index has."""
        rows = self.table("totals")
        return [] if rows is None else [r[0] for r in rows.select(F.explode("deliveries")).distinct().collect()]

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        with _cleaned(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").options(**SORTED if name == "chunks" else {}).parquet(f"{self.path}/{name}/segment={number}")

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        """As shared.stored(), smaller and without what was shuffled for it."""
        path = scratch(self.spark, name)
        with _cleaned(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _placed(rows: DataFrame) -> DataFrame:
        """Rows of files, with the file and their number in it."""
        return rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _at(self, rows: DataFrame, places: DataFrame, there: bool = True) -> DataFrame:
        """Rows of files that are at the places (_file, _row), or those that aren't. Texts and tokens stay where they lie: a bit for each row is sent to them."""
        part, bit = F.floor(F.col("_row") / BITS).alias("_part"), F.col("_row") % BITS
        marks = places.select("_file", part, bit.alias("_bit")).groupBy("_file", "_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        marked = self._placed(rows).withColumn("_part", part).join(F.broadcast(marks), ["_file", "_part"], "left")
        return marked.where(F.coalesce(F.getbit(byte, (bit % 8).cast("int")), F.lit(0)) == int(there)).select(*rows.columns)

    def live(self, before: int | None = None) -> DataFrame | None:
        """Chunks that no later segment took away, with their segment."""
        chunks = self.table("chunks", before)
        if chunks is None:
            return None
        ids = self._placed(chunks).select(*self.by, "chunk_id", "segment", "_file", "_row")
        return self._at(chunks, self._alive(ids, self.table("gone", before), "left_semi"), there=False)

    def _alive(self, rows: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
        """Rows whose chunk no later segment took away; with left_semi the others."""
        last = gone.groupBy(*self.by, F.col("chunk_id").alias("_gone")).agg(F.max("segment").alias("_until"))
        last = last.withColumnsRenamed({c: f"_{c}" for c in self.by})
        same = (F.col("chunk_id") == F.col("_gone")) & (F.col("_until") > F.col("segment"))
        for c in self.by:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        return rows.join(last.hint("shuffle_hash"), same, how)  # no task sorts the rows

    def add(self, chunks: DataFrame, number: int | None = None, removed: DataFrame | None = None, content: str = "page_content", segment: T.Segment | None = None, delivery: str | None = None) -> int:
        """A segment out of documents as they are now: chunks (by, doc_id, chunk_id, content); its number.

        Chunks of the same documents that the index had and that aren't among them go; those that are there with the same text are left
        alone. removed: documents (by, doc_id) of which nothing is left. Chunk ids are not repeated in a delivery. Null texts have no tokens.
        number: the delivery's own number, above all earlier ones; given again it replaces what it wrote before. delivery: its name; one that the index has by
        that name adds nothing, and one that broke off is written again under its number."""
        if delivery is not None and delivery in self.deliveries():
            return self.numbers()[-1]
        number = number if number is not None else max(self.numbers(), default=-1) + 1
        keys = [*self.by, "chunk_id"]
        text = F.coalesce(F.col(content), F.lit(""))
        asked = chunks.select(*self.by, "doc_id", "chunk_id", text.alias("_text"), F.md5(text).alias("digest"))
        old, held_back = self.table("chunks", number), []
        if old is not None:
            # what is left, what goes and what stays as it is are told by ids; texts and tokens are found by their places then
            texts = self._stored(asked, "segment-new")
            have = self._placed(texts).drop("_text")
            ids = self._placed(old.select(*keys, "doc_id", "digest", "dl", "segment", "_metadata")).drop("_metadata")
            touched = have.select(*self.by, "doc_id")
            touched = (touched if removed is None else touched.unionByName(removed.select(*self.by, "doc_id"))).distinct()
            held = self._stored(self._alive(ids, self.table("gone", number)).join(touched, [*self.by, "doc_id"], "left_semi"), "segment-held")
            same = self._stored(held.join(have, [*keys, "doc_id", "digest"], "left_semi").select(*keys), "segment-same")
            gone = self._stored(held.join(same, keys, "left_anti").select(*keys, "dl", "_file", "_row"), "segment-gone")
            asked, held_back = self._at(texts, have.join(same, keys, "left_semi").select("_file", "_row"), there=False), [held, same, texts]
        tokens = F.array_sort(T.bm25_tokens(F.col("_text"), segment))
        # the tokens are stored once, as the index's own
        self._write(asked.select(*self.by, "doc_id", "chunk_id", "digest", tokens.alias("tokens")).withColumn("dl", F.size("tokens").cast("long")), "chunks", number)
        forget(*held_back)
        new = self.spark.read.parquet(f"{self.path}/chunks/segment={number}")
        if old is None:
            gone, lost = new.limit(0).select(*keys, "dl"), None
        else:
            lost = self._at(old, gone).select(*self.by, F.explode(F.array_distinct("tokens")).alias("term"), F.lit(-1).alias("_d"))
        self._write(gone.select(*keys), "gone", number)
        self._write_blocks(new, number)
        more = self.spark.read.parquet(f"{self.path}/blocks/segment={number}").select(*self.by, "term", F.col("n").alias("_d"))  # a posting is a chunk that has the term
        delta = (more if lost is None else more.unionByName(lost)).groupBy(*self.by, "term").agg(F.sum("_d").alias("df")).where("df <> 0")
        self._write(delta.repartitionByRange("term").sortWithinPartitions("term"), "terms", number)
        totals = new.select(*self.by, F.lit(1).alias("_d"), "dl").unionByName(gone.select(*self.by, F.lit(-1).alias("_d"), (-F.col("dl")).alias("dl")))
        totals = totals.groupBy(*self.by).agg(F.sum("_d").alias("n"), F.sum("dl").alias("dl"))
        if not self.by:
            totals = totals.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("dl", F.lit(0)).alias("dl"))
        elif totals.isEmpty():  # a segment without rows is a segment still
            totals = self.spark.createDataFrame([(*[None] * len(self.by), 0, 0)], totals.schema)
        names = F.array(F.lit(delivery)) if delivery is not None else F.array().cast("array<string>")
        self._write(totals.withColumn("deliveries", names).coalesce(1), "totals", number)
        if old is not None:
            forget(gone)
        return number

    def _write_blocks(self, new: DataFrame, number: int) -> None:
        """Blocks out of chunks with tokens: terms are counted where the tokens are, once, and leave as packets, Parquet files in memory, one for each part of the index.

        Parts are ranges of term and score, so a frequent term is split; a sample sets their bounds alone. Within a term postings come by score in steps of a thousandth, the largest first."""
        by, block, held_most, part_most = list(self.by), BLOCK, HELD, PART
        small_batches(self.spark)
        means = new.groupBy(*by).agg(F.avg("dl").alias("_avg"))
        rows = bm25._with(new.select(*by, "chunk_id", "dl", "tokens"), means, self.by).select(*by, "chunk_id", F.col("dl").cast("int").alias("dl"), "_avg", "tokens")
        keys = [ty.StructField(c, new.schema[c].dataType) for c in by]
        cut = ty.StructType([*keys, ty.StructField("term", ty.StringType()), ty.StructField("block", ty.LongType()), ty.StructField("ids", ty.ArrayType(new.schema["chunk_id"].dataType)), ty.StructField("tfs", ty.ArrayType(ty.IntegerType())), ty.StructField("dls", ty.ArrayType(ty.IntegerType())), ty.StructField("front", ty.ArrayType(ty.StructType([ty.StructField("tf", ty.IntegerType()), ty.StructField("dl", ty.IntegerType())])))])
        count = bm25.counter([*by, "chunk_id", "dl", "_avg"])

        def less(t: pa.Table | pa.RecordBatch) -> np.ndarray:
            tf, dl, avg = (t.column(c).to_numpy() for c in ("tf", "dl", "_avg"))
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.round(-1000 * tf / (tf + ORDER_K1 * (1 - ORDER_B + ORDER_B * dl / avg))).astype(np.int32)

        def codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            return pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)

        def places(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
            """The place of each term among the distinct ones, and these, sorted."""
            coded = column.combine_chunks().cast(pa.large_binary()).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            return place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))

        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in count(batches):
                yield pa.RecordBatch.from_arrays([b.column("term"), pa.array(less(b) // STEP, pa.int32())], names=["term", "_step"])

        every = max(1, new.count() // SAMPLED)
        with _cleaned(self.spark):
            some = rows.where(F.expr(f"pmod(xxhash64(chunk_id), {every}) = 0")).mapInArrow(steps, "term string, _step int").groupBy("term", "_step").agg(F.count("*").alias("n")).toArrow()
        n = (pc.sum(some["n"]).as_py() or 0) * every
        parts = max(1, math.ceil(n / PART), min(n // LEAST, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        some = some.set_column(0, "term", some["term"].cast(pa.large_binary())).sort_by([("term", "ascending"), ("_step", "ascending")])
        ends = np.cumsum(some["n"].to_numpy())
        first = pa.array(sorted({int(i) for i in np.searchsorted(ends, np.arange(1, parts) * (n / every / parts), "right")} - {len(ends)}), pa.int64())
        bounds = list(zip(some["term"].take(first).to_pylist(), some["_step"].take(first).to_pylist()))  # the least of each part but the first
        strings = [f.name for f in keys if isinstance(f.dataType, ty.StringType)]
        coding = {"term": "DELTA_BYTE_ARRAY", "dl": "DELTA_BINARY_PACKED"}
        match new.schema["chunk_id"].dataType:
            case ty.StringType():
                coding["chunk_id"] = "DELTA_BYTE_ARRAY"
            case ty.IntegerType() | ty.LongType():
                coding["chunk_id"] = "DELTA_BINARY_PACKED"
        coded = ["tf", "_avg", *strings]

        def packets(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            step, (term, words) = less(t) // STEP, places(t["term"])
            least = step.min()
            width = int(step.max()) - int(least) + 2
            own = term * width + (step - least)
            limits = []
            for word, s in bounds:
                i = bisect_left(words, word, key=lambda x: x.as_py())
                limits.append(i * width + (min(max(s - int(least), 0), width - 1) if i < len(words) and words[i].as_py() == word else 0))
            order = np.lexsort((*(codes(t[c]) for c in by), own))
            t, own = t.take(pa.array(order)), own[order]
            cuts = [0, *np.searchsorted(own, limits, "left"), len(own)]
            for p, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if j > i:
                    sink = pa.BufferOutputStream()
                    pq.write_table(t.slice(i, j - i).combine_chunks(), sink, compression="zstd", use_dictionary=coded, column_encoding=coding, write_statistics=False, store_schema=True)
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "packet"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in count(batches):
                held.append(b)
                n += b.num_rows
                if n >= held_most:
                    yield from packets(held)
                    held, n = [], 0
            if n:
                yield from packets(held)

        def in_blocks(t: pa.Table, number: int) -> pa.RecordBatch:
            term, _ = places(t["term"])
            ids = t["chunk_id"].combine_chunks()
            ids_at = np.empty(len(ids), np.int64)
            ids_at[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            order = np.lexsort((ids_at, less(t), term, *(codes(t[c]) for c in by)))
            n, t = len(order), t.take(pa.array(order)).combine_chunks()
            changes = np.arange(n) == 0
            for c in (*by, "term"):
                own = codes(t[c])
                changes[1:] |= own[1:] != own[:-1]
            starts = np.flatnonzero(changes)
            place = np.arange(n) - np.repeat(starts, np.diff([*starts, n]))
            cuts = np.flatnonzero(place % block == 0)
            offsets, take = pa.array([*cuts, n], pa.int32()), pa.array(cuts)
            lists = [pa.ListArray.from_arrays(offsets, t[c].combine_chunks()) for c in ("chunk_id", "tf", "dl")]
            # of equal and higher counts only the shortest chunks can have the largest score
            own, tf, dl = np.repeat(np.arange(len(cuts)), np.diff([*cuts, n])), t["tf"].to_numpy(), t["dl"].to_numpy()
            by_tf = np.lexsort((dl, -tf, own))
            fall = dl[by_tf] - own[by_tf] * (1 << 32)  # lower in each block than in all before it
            steep = by_tf[fall < np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(fall)[:-1]])]
            points = pa.StructArray.from_arrays([pa.array(tf[steep], pa.int32()), pa.array(dl[steep], pa.int32())], ["tf", "dl"])
            lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(own[steep], np.arange(len(cuts) + 1)), pa.int32()), points))
            heads = [t[c].take(take).combine_chunks() for c in (*by, "term")]
            return pa.RecordBatch.from_arrays([*heads, pa.array(np.arange(number, number + len(cuts))), *lists], names=cut.names)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number, held, n = -1, 0, [], 0
            for b in batches:
                for p, packet in zip(b.column("part").to_pylist(), b.column("packet")):
                    if n and (p != part or n >= 4 * part_most):  # a part that many equal scores make large is cut into blocks in several goes
                        done = in_blocks(pa.concat_tables(held), number)
                        yield done
                        number, held, n = number + done.num_rows, [], 0
                    if p != part:
                        part, number = p, p << 33
                    held.append(pq.read_table(pa.BufferReader(packet.as_buffer())))
                    n += held[-1].num_rows
            if n:
                yield in_blocks(pa.concat_tables(held), number)

        out = rows.mapInArrow(packed, "part int, packet binary").repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part").mapInArrow(blocks, cut)
        self._write(out.select(*by, "term", "block", F.size("ids").alias("n"), "front", "ids", "tfs", "dls"), "blocks", number)

    def merge(self, into: str) -> Segments:
        """One segment, below another path, with what is live: dead postings are left out and blocks are full again. Readers of this path are not disturbed."""
        out = Segments(self.spark, into, self.by)
        terms, totals = self.table("terms"), self.table("totals")
        if terms is None:
            return out
        live = self.live()
        out._write(live.drop("segment"), "chunks", 0)
        out._write(live.select(*self.by, "chunk_id").limit(0), "gone", 0)
        kept = self.spark.read.parquet(f"{into}/chunks/segment=0")  # what is live is told from the rest once
        out._write_blocks(kept, 0)
        out._write(terms.groupBy(*self.by, "term").agg(F.sum("df").alias("df")).where("df > 0").repartitionByRange("term").sortWithinPartitions("term"), "terms", 0)
        out._write(totals.groupBy(*self.by).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"), F.array_distinct(F.flatten(F.collect_list("deliveries"))).alias("deliveries")).coalesce(1), "totals", 0)
        return out

    def term_stats(self) -> DataFrame:
        """by, term, df and idf of all terms: sums of the segments' deltas."""
        n = self.totals().select(*self.by, "n")
        df = self.table("terms").groupBy(*self.by, "term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = bm25._with(df, n, self.by).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.groupBy(*self.by).agg(F.avg("raw").alias("mean"))
        return bm25._with(raw, mean, self.by).select(*self.by, "term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    def totals(self) -> DataFrame:
        """by, n (chunks) and avgdl."""
        t = self.table("totals").groupBy(*self.by).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).where("n > 0")
        return t.select(*self.by, "n", (F.col("dl") / F.col("n")).alias("avgdl"))

    def as_index(self) -> bm25.Index:
        """The live postings as bm25.Index, counted from the live chunks' tokens: a chunk that went is left out once, not posting by posting."""
        live = self.live().select(*self.by, "chunk_id", "dl", "tokens")
        rows = bm25.counted(live.select(*self.by, "chunk_id", "tokens"))
        return bm25.Index(rows.select(*self.by, "chunk_id", "term", F.col("tf").cast("long").alias("tf")), live.select(*self.by, "chunk_id", "dl"), self.by, None, live.drop("dl"))

    # search

    def _asked(self, queries: DataFrame, segment: T.Segment | None, most_terms: int) -> tuple[DataFrame, list[str] | None]:
        """query_id, by, term, w (how often it is asked for, times its idf), df, n, avgdl; and the terms, if they are few.

        The mean over all terms is made only where a frequent term asks for it."""
        words = small(queries.select("query_id", F.explode(T.bm25_tokens(F.col("query_text"), segment)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
        some = [r[0] for r in words.select("term").distinct().limit(most_terms + 1).collect()]
        few = some if len(some) <= most_terms else None
        terms, totals = self.table("terms"), self.totals()
        terms = (terms if few is None else terms.where(F.col("term").isin(few))).groupBy(*self.by, "term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        rows = small(bm25._with(words.join(terms, "term"), totals, self.by).withColumn("idf", raw))
        if not rows.where("idf < 0").isEmpty():
            all_terms = self.term_stats().select(*self.by, "term", F.col("idf").alias("_idf"))
            rows = small((rows.join(all_terms if few is None else all_terms.where(F.col("term").isin(few)), [*self.by, "term"])).withColumn("idf", F.col("_idf")).drop("_idf"))
        return rows.withColumn("w", F.col("times") * F.col("idf")), few

    def plan(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, keep: DataFrame | None = None, segment: T.Segment | None = None, most_terms: int = 1000) -> tuple[DataFrame, DataFrame]:
        """Which blocks a top-k reads: query_id, by, term, segment, block, w, avgdl, bound, read; and the lower bound theta of each (query_id, by).

        A block's bound is the largest score that its postings can have, exact for any mean length by its front. First the best blocks of each
        term are read; some times k of their chunks, those with most so far, are scored as a whole by their own tokens: the k-th best of them is a score that the
        result can't fall short of. Then a block is read only if
        its bound and the largest bounds of the query's other terms reach it. A chunk of the result has all its postings in
        such blocks, so its score is whole; others can only come out lower. Terms with a negative weight are always read."""
        by, keys = list(self.by), ["query_id", *self.by]
        asked, few = self._asked(queries, segment, most_terms)
        blocks = self.table("blocks")
        blocks = blocks if few is None else blocks.where(F.col("term").isin(few))
        part = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
        top = F.array_max(F.transform("front", lambda x: part(x["tf"], x["dl"])))
        meta = blocks.select(*by, "term", "segment", "block", "front").join(asked.select("query_id", *by, "term", "w", "avgdl"), [*by, "term"])
        meta = meta.select(*keys, "term", "segment", "block", "w", "avgdl", (F.greatest(F.col("w"), F.lit(0.0)) * top).alias("bound"))
        best = Window.partitionBy(*keys, "term").orderBy(F.col("bound").desc(), "segment", "block")
        first = small(meta.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= -(-k // BLOCK) + 1))
        sure = self._scored(first, keep, few, k1, b)
        nth = Window.partitionBy(*keys).orderBy(F.col("raw").desc())
        ahead = small(sure.withColumn("_r", F.row_number().over(nth)).where(F.col("_r") <= AHEAD * k).select(*keys, "chunk_id"))
        whole = self._whole(ahead, asked, k1, b, most_terms)
        theta = small(whole.withColumn("_r", F.row_number().over(nth)).where(F.col("_r") == k).select(*keys, F.col("raw").alias("theta")))
        peaks = first.where("_r = 1").select(*keys, "term", F.col("bound").alias("peak"))
        every = peaks.groupBy(*keys).agg(F.sum("peak").alias("all"))
        lines = small(peaks.join(every, keys).join(theta, keys, "left").select(*keys, "term", (F.col("theta") - F.col("all") + F.col("peak") - SLACK).alias("least")))
        reach = meta.join(lines, [*keys, "term"]).withColumn("read", F.col("least").isNull() | (F.col("w") < 0) | (F.col("bound") >= F.col("least")))
        return reach.drop("least"), theta

    def _whole(self, some: DataFrame, asked: DataFrame, k1: float, b: float, most_ids: int) -> DataFrame:
        """query_id, by, chunk_id, raw: the whole scores of some chunks (query_id, by, chunk_id), by their tokens."""
        by, chunks = list(self.by), self.table("chunks")
        ids = [r[0] for r in some.select("chunk_id").distinct().limit(most_ids + 1).collect()]
        if len(ids) <= most_ids:
            chunks = chunks.where(F.col("chunk_id").isin(ids))
        rows = self._alive(chunks.select(*by, "chunk_id", "dl", "tokens", "segment"), self.table("gone")).join(some, [*by, "chunk_id"])
        rows = rows.join(asked.select("query_id", *by, "term", "w", "avgdl"), ["query_id", *by])
        tf = F.size(F.filter("tokens", lambda t: t == F.col("term")))
        score = F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        return rows.groupBy("query_id", *by, "chunk_id").agg(F.sum(score).alias("raw"))

    def _scored(self, wanted: DataFrame, keep: DataFrame | None, few: list[str] | None, k1: float, b: float) -> DataFrame:
        """query_id, by, chunk_id, raw: sums over the postings of the wanted blocks, of live chunks and, with keep, of those alone."""
        by, blocks = list(self.by), self.table("blocks")
        if few is not None:  # the most telling blocks come first: what is wanted of a term lies before a block of it, which the scan is told
            limit = F.lit(False)
            for term, seg, block in wanted.groupBy("term", "segment").agg(F.max("block")).collect():
                limit = limit | ((F.col("term") == term) & (F.col("segment") == seg) & (F.col("block") <= block))
            blocks = blocks.where(limit)
        hits = blocks.select(*by, "term", "segment", "block", "ids", "tfs", "dls").join(wanted.select("query_id", *by, "term", "segment", "block", "w", "avgdl"), [*by, "term", "segment", "block"])
        rows = hits.select("query_id", *by, "segment", "w", "avgdl", F.inline(F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))
        rows = self._alive(rows, self.table("gone"))
        if keep is not None:
            rows = rows.join(keep.select(*by, "chunk_id").distinct(), [*by, "chunk_id"], "left_semi")
        score = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        return rows.groupBy("query_id", *by, "chunk_id").agg(F.sum(score).alias("raw"))

    def top_k(self, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, keep: DataFrame | None = None, segment: T.Segment | None = None, most_terms: int = 1000) -> DataFrame:
        """query_id, by, chunk_id, raw, rank: the k best chunks as bm25.top_k(bm25.scores(...)) finds them, from the blocks that can hold them.

        Queries (query_id, query_text) are segmented like the texts, if the index was. keep: chunk ids (with by) that may be returned."""
        if not self.numbers():
            return self.spark.createDataFrame([], "query_id int, chunk_id string, raw double, rank int")
        reach, theta = self.plan(queries, k, k1, b, keep, segment, most_terms)
        wanted = small(reach.where("read"))
        few = [r[0] for r in wanted.select("term").distinct().limit(most_terms + 1).collect()]
        rows = self._scored(wanted, keep, few if len(few) <= most_terms else None, k1, b).join(theta, ["query_id", *self.by], "left")
        rows = rows.where(F.col("theta").isNull() | (F.col("raw") >= F.col("theta") - SLACK)).drop("theta")
        return bm25.top_k(rows, k, score="raw", by=self.by)

    def normalised_top_k(self, queries: DataFrame, k: int = 10, threshold: float | None = None, keep: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, segment: T.Segment | None = None) -> DataFrame:
        """query_id, by, chunk_id, score, rank: as bm25.top_k(bm25.normalised(...)).

        Where the terms of a query can't be in all chunks and none weighs less than nothing, the smallest score is that of a chunk without
        them, 0, and the largest is the best one's: the top-k decides all. Only the other queries are scored over all their postings."""
        keys = ["query_id", *self.by]
        asked, _ = self._asked(queries, segment, 1000)
        sure = small(asked.groupBy(*keys).agg((F.sum("df") < F.max("n")).alias("a"), (F.min("w") >= 0).alias("c")).groupBy("query_id").agg(F.min(F.col("a") & F.col("c")).alias("sure")))
        easy = queries.join(sure.where("sure"), "query_id", "left_semi")
        hard = queries.join(sure.where("not sure"), "query_id", "left_semi")
        found = self.top_k(easy, k, k1, b, keep, segment)
        # without a choice of chunks the best one is found already
        best = (found.where("rank = 1") if keep is None else self.top_k(easy, 1, k1, b, None, segment)).select(*keys, F.col("raw").alias("hi"))
        rows = found.join(small(best), keys).select(*keys, "chunk_id", F.when(F.col("hi") > 0, F.col("raw") / F.col("hi")).otherwise(F.col("raw")).alias("score"))
        if not hard.isEmpty():
            full = bm25.normalised(self.as_index(), hard, k1, b)
            rows = rows.unionByName(full if keep is None else full.join(keep.select(*self.by, "chunk_id").distinct(), [*self.by, "chunk_id"], "left_semi"))
        return bm25.top_k(rows, k, threshold, by=self.by)


"""Collections, small key-value tables, statistics and deletes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.bm25 import equals
from quillspark.shared import forget, stored


@dataclass
class Store:
    """Objects by key below a path, on any file system that Spark knows."""

    spark: SparkSession
    root: str

    def _at(self, key: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def put(self, key: str, data: bytes) -> str:
        """Writes an object, in place of one that is there; the folder is made if need be. The path."""
        fs, p = self._at(key)
        out = fs.create(p, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return p.toString()

    def get(self, key: str) -> bytes | None:
        fs, p = self._at(key)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def remove(self, key: str) -> bool:
        fs, p = self._at(key)
        return fs.delete(p, True)

    def names(self, key: str = "") -> list[str]:
        fs, p = self._at(key)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def claim(self, key: str) -> bool:
        """Whether the object is made by this call: of several writers one only is told so."""
        fs, p = self._at(key)
        fs.mkdirs(p.getParent())
        try:
            fs.create(p, False).close()
            return True
        except Exception:  # noqa: BLE001  the file system's own kind of "it is there"
            if fs.exists(p):
                return False
            raise

    def has(self, key: str) -> bool:
        fs, p = self._at(key)
        return fs.exists(p)


class Conflict(RuntimeError):
    """Another writer was faster, or broke off; see Versions.forget_claims()."""


@dataclass
class Versions:
    """Folders 0, 1, ... below a path, of which the last that is whole counts. A writer claims the next number first, so that of two
    writers who read the same version one gets a Conflict. Two old versions stay for readers that are at them."""

    store: Store

    def _numbers(self, suffix: str) -> list[int]:
        return sorted(int(n.removesuffix(suffix)) for n in self.store.names() if n.endswith(suffix) and n.removesuffix(suffix).isdigit())

    def last(self) -> int | None:
        whole = [n for n in self._numbers(".done")]
        return whole[-1] if whole else None

    def path(self, n: int) -> str:
        return f"{self.store.root}/{n:012d}"

    def write(self, base: int | None, df: DataFrame, single: bool = False) -> None:
        n = 0 if base is None else base + 1
        if not self.store.claim(f"{n:012d}.claim"):
            raise Conflict(f"version {n} of {self.store.root} is being written")
        (df.coalesce(1) if single else df).write.mode("overwrite").parquet(self.path(n))
        self.store.put(f"{n:012d}.done", b"")
        for old in self._numbers(".done")[:-3]:
            for name in (f"{old:012d}.done", f"{old:012d}.claim", f"{old:012d}"):
                self.store.remove(name)

    def forget_claims(self) -> None:
        """Lets others write again after a writer was lost between its claim and the end."""
        done = set(self._numbers(".done"))
        for n in self._numbers(".claim"):
            if n not in done:
                self.store.remove(f"{n:012d}.claim")


@dataclass
class KeyValueTable:
    """A small table under a path, replaced as a whole when rows are put or dropped: settings, templates, catalog rows.

    Readers never see half a version; a writer whose base was replaced meanwhile reads again and tries again."""

    spark: SparkSession
    path: str
    schema: str
    key: str

    def __post_init__(self) -> None:
        self.versions = Versions(Store(self.spark, self.path))

    def _at(self, version: int | None) -> DataFrame:
        return self.spark.createDataFrame([], self.schema) if version is None else self.spark.read.schema(self.schema).parquet(self.versions.path(version))

    def read(self) -> DataFrame:
        return self._at(self.versions.last())

    def _change(self, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> None:
        for i in range(tries):
            base = self.versions.last()
            try:
                return self.versions.write(base, change(self._at(base)), single=True)
            except Conflict:
                if i + 1 == tries:
                    raise
                time.sleep(0.2 * 2**i)

    def put(self, rows: DataFrame) -> None:
        """Rows by key: new ones are added, known ones replaced."""
        self._change(lambda old: old.join(rows, self.key, "left_anti").select(*old.columns).unionByName(rows.select(*old.columns)))

    def patch(self, key: object, **values: object) -> None:
        """Sets the given fields that aren't None."""

        def change(row: DataFrame) -> DataFrame:
            for k, v in values.items():
                if v is not None:
                    row = row.withColumn(k, F.when(F.col(self.key) == key, F.lit(v)).otherwise(F.col(k)).cast(row.schema[k].dataType))
            return row

        self._change(change)

    def get(self, key: object) -> DataFrame:
        return self.read().where(F.col(self.key) == key)

    def drop(self, condition: Column) -> None:
        self._change(lambda old: old.where(~F.coalesce(condition, F.lit(False))))


#: Fields that searches filter on. Each has a Bloom filter, and rows lie by a Z-order key of the first ZORDERED ones that there are.
INDEXED = ("source_file", "doc_id", "chunk_id", "embedding_model", "file_extension", "processing_timestamp")
ZORDERED = ("source_file", "file_extension", "processing_timestamp")
#: Values that a field's cuts are made from, and the bits of a place among them.
SAMPLED, PLACE_BITS = 10_000, 6


def zorder_key(rows: DataFrame, fields: list[str], bits: int = PLACE_BITS, most_sampled: int = SAMPLED) -> Column:
    """A key under which rows near each other in several fields lie together: the bits of each field's percentile rank, interleaved.

    Ranks are places among cuts of a sample of at most most_sampled rows, which decides how rows lie, never which there are. Null ranks first."""
    n = rows.count()
    some = rows.select(*fields).sample(min(1.0, most_sampled / max(n, 1)), 11).limit(most_sampled).collect() if fields else []
    places = []
    for f in fields:
        values = sorted(v for v in (r[f] for r in some) if v is not None)
        cuts = sorted({values[len(values) * i // (1 << bits)] for i in range(1, 1 << bits)}) if values else []
        kind = rows.schema[f].dataType
        value = F.col(f)
        below = sum((F.when(F.lit(c).cast(kind) <= value, 1).otherwise(0) for c in cuts), F.lit(1))
        places.append(F.when(F.col(f).isNull(), 0).otherwise(below).cast("long"))
    key = F.lit(0).cast("long")
    for bit in range(bits + 1):
        for i, p in enumerate(places):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(p, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(places) + i))
    return key


@dataclass
class Collections:
    """Collections of chunks: Parquet below root/collection=<name>, parted by `bucket`, a hash of the chunk's id.

    What replaces or removes rows rewrites the buckets that have them and no other file (dynamic partition overwrite). Every write sorts by a Z-order key of
    the filter fields and writes Bloom filters, so filters skip row groups after any number of changes. One writer at a time: another gets a Conflict. A writer that is
    lost before it commits leaves the old buckets; each bucket is moved in as a whole."""

    spark: SparkSession
    root: str
    buckets: int = 32
    row_group_bytes: int = 32 << 20

    def _path(self, name: str) -> str:
        if not name or "/" in name or "=" in name:
            raise ValueError(f"bad collection name: {name!r}")
        return f"{self.root}/collection={name}"

    def _store(self, name: str) -> Store:
        return Store(self.spark, self._path(name))

    def create(self, name: str, force: bool = False) -> bool:
        """Whether it is new; one that is there stays, or is emptied with force."""
        store = self._store(name)
        if store.has("") and not force:
            return False
        store.remove("")
        fs, p = store._at()
        return fs.mkdirs(p)

    def drop(self, name: str) -> bool:
        return self._store(name).remove("")

    def names(self) -> list[str]:
        return [n.removeprefix("collection=") for n in Store(self.spark, self.root).names() if n.startswith("collection=")]

    def missing(self, wanted: list[str]) -> list[str]:
        known = self.spark.createDataFrame([(n,) for n in self.names()], "name string")
        return sorted(r[0] for r in missing(self.spark.createDataFrame([(n,) for n in wanted], "name string"), known).collect())

    def _rows(self, name: str) -> DataFrame | None:
        """With bucket; None where nothing was written yet. Columns that some files lack are null there."""
        if not any(n.startswith("bucket=") for n in self._store(name).names()):
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(self._path(name))

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        """rows with bucket, in files of their buckets; several for a large one."""
        z = zorder_key(rows, [c for c in ZORDERED if c in rows.columns])
        rows = rows.withColumn("_z", z).repartitionByRange("bucket", "_z").sortWithinPartitions("bucket", "_z").drop("_z")
        out = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("parquet.block.size", str(self.row_group_bytes)).partitionBy("bucket")
        for c in INDEXED:
            if c in rows.columns and rows.schema[c].dataType.simpleString() in ("string", "int", "bigint"):
                out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(self._path(name))

    @contextmanager
    def _alone(self, name: str) -> Iterator[None]:
        store = self._store(name)
        if not store.claim("_writing"):
            raise Conflict(f"{name} is being written")
        try:
            yield
        finally:
            store.remove("_writing")

    def release(self, name: str) -> None:
        """Lets others write again after a writer was lost."""
        self._store(name).remove("_writing")

    def add(self, name: str, chunks: DataFrame, key: str = "chunk_id") -> None:
        """Adds rows as they are; repeated ids are there twice, see put()."""
        with self._alone(name):
            self._write(name, chunks.withColumn("bucket", self._bucket(key)), "append")

    def _replace(self, name: str, touched: list[int], rest: DataFrame) -> None:
        """The touched buckets become what `rest` has of them; those that it has nothing of go."""
        self._write(name, rest, "overwrite")
        left = {r[0] for r in rest.select("bucket").distinct().collect()}
        for b in set(touched) - left:
            self._store(name).remove(f"bucket={b}")

    def put(self, name: str, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
        """Rows by id: known ones are replaced, new ones added, of repeated ones one counts. Their ids. Only their buckets are read and written."""
        new = rows = stored(chunks.dropDuplicates([key]).withColumn("bucket", self._bucket(key)), "put")
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        with self._alone(name):
            old = self._rows(name)
            if old is not None:
                kept = old.where(F.col("bucket").isin(touched)).join(rows.select(key), key, "left_anti")
                rows = stored(kept.unionByName(rows, allowMissingColumns=True), "put")
            if touched:
                self._write(name, rows, "overwrite")
        ids = stored(new.select(key), "ids")
        forget(*([new] if rows is new else [new, rows]))
        return ids

    def read(self, *names: str) -> DataFrame:
        """Known collections among those named, or all of them, with `collection`."""
        known, out = self.names(), None
        for name in [n for n in (dict.fromkeys(names) or known) if n in known]:
            part = self._rows(name)
            if part is not None:
                part = part.drop("bucket").withColumn("collection", F.lit(name))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return self.spark.createDataFrame([], "chunk_id string, collection string") if out is None else out

    def known_ids(self, name: str, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
        """Those of ids that the collection has."""
        return known(ids, self.read(name), key)

    def delete(self, name: str, ids: DataFrame | None = None, conditions: dict[str, object] | None = None, key: str = "chunk_id") -> bool:
        """Removes chunks by id or by equal fields; without either nothing happens. Buckets without such rows are left alone."""
        if ids is None and not conditions:
            return True
        with self._alone(name):
            old = self._rows(name)
            if old is None:
                return True
            hit = equals(conditions)
            found = [old.join(ids.select(key).distinct(), key, "left_semi")] if ids is not None else []
            found += [old.where(F.coalesce(hit, F.lit(False)))] if hit is not None else []
            touched = sorted({r[0] for f in found for r in f.select("bucket").distinct().collect()})
            if touched:
                rest = stored(delete_rows(old.where(F.col("bucket").isin(touched)), ids, conditions, key), "rest")
                self._replace(name, touched, rest)
                forget(rest)
        return True


def bootstrap(spark: SparkSession, root: str, name: str = "default") -> Collections:
    """An empty collection to start with; what it held is gone."""
    c = Collections(spark, root)
    c.create(name, force=True)
    return c


def missing(wanted: DataFrame, known: DataFrame, key: str = "name") -> DataFrame:
    """Rows of wanted that known lacks."""
    return wanted.join(known.select(key).distinct(), key, "left_anti")


def known(ids: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Those of ids, each once, that rows have."""
    return ids.select(key).distinct().join(rows.select(key), key, "left_semi")


def file_info(files: DataFrame) -> DataFrame:
    """What is told about uploaded files (filename, size, content_type): with file_extension, and a content type where none is given."""
    ext = F.lower(F.regexp_extract(F.coalesce("filename", F.lit("")), r"[^./]+(\.[^.]*)$", 1))
    return files.select("filename", F.col("size").alias("file_size"), ext.alias("file_extension"), F.when(F.coalesce("content_type", F.lit("")) == "", "application/octet-stream").otherwise(F.col("content_type")).alias("content_type"), F.current_timestamp().alias("upload_time"))


def operation_stats(log: DataFrame) -> DataFrame:
    """One row over a log (operation: index or search, n, seconds): totals, and averages where there were any (else null).

    Statistics begin anew with a log, or with the part of it after some time."""
    total = lambda op, c: F.coalesce(F.sum(F.when(F.col("operation") == op, F.col(c))), F.lit(0))
    some = lambda op: F.when(total(op, "n") > 0, total(op, "seconds").cast("double") / total(op, "n"))
    return log.agg(
        total("index", "n").alias("total_documents_indexed"), total("index", "seconds").cast("double").alias("total_indexing_time"), total("search", "n").alias("total_searches_performed"),
        total("search", "seconds").cast("double").alias("total_search_time"), some("search").alias("avg_search_time_per_search"), some("index").alias("avg_indexing_time_per_doc"),
    )


def delete_rows(chunks: DataFrame, ids: DataFrame | None = None, conditions: dict[str, object] | None = None, key: str = "chunk_id") -> DataFrame:
    rest = chunks if ids is None else chunks.join(ids, key, "left_anti")
    hit = equals(conditions)
    return rest if hit is None else rest.where(~F.coalesce(hit, F.lit(False)))


def collection_stats(files: DataFrame, by: str = "collection") -> DataFrame:
    """Per collection of files (file_extension, size): how many, their bytes and MB, and how many of each extension."""
    kinds = files.groupBy(by, F.lower("file_extension").alias("ext")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return kinds.groupBy(by).agg(F.sum("n").alias("documents"), F.sum("bytes").alias("total_size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("file_types")).withColumn("size_mb", T.size_mb(F.col("total_size")))


def pipeline_stats(files: DataFrame) -> DataFrame:
    """One row over files (documents, chunks, vectors, failed): totals, averages and the share that succeeded."""
    n = F.greatest(F.count("*"), F.lit(1))
    return files.agg(
        F.count("*").alias("files"), F.sum("documents").alias("documents"), F.sum("chunks").alias("chunks"), F.sum("vectors").alias("vectors"),
        (F.sum("documents") / n).alias("documents_per_file"), (F.sum("chunks") / n).alias("chunks_per_file"), (F.sum("vectors") / n).alias("vectors_per_file"),
        (F.sum("chunks") / F.greatest(F.sum("documents"), F.lit(1))).alias("chunks_per_document"), ((n - F.sum(F.col("failed").cast("int"))) / n * 100).alias("success_rate"),
    )


def collection_info(vectors: DataFrame, by: str = "collection") -> DataFrame:
    return vectors.groupBy(by).agg(F.count("*").alias("points_count"), F.max(F.size("embedding")).alias("vector_size"), F.lit("cosine").alias("distance"), F.lit("ready").alias("status"))


def catalog(collections: DataFrame, metadata: DataFrame, stats: DataFrame) -> DataFrame:
    """name with what is known of it: updated_at is that of the stats, else of the metadata, else when it was created."""
    m = metadata.select("name", F.col("description"), F.col("created_at"), F.col("updated_at").alias("_m"))
    s = stats.select("name", "documents", "total_size", F.col("updated_at").alias("_s"))
    rows = collections.select("name").join(m, "name", "left").join(s, "name", "left")
    return rows.select("name", "description", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("total_size", F.lit(0)).alias("total_size"), F.coalesce("_s", "_m", "created_at").alias("updated_at"))


def page_after(rows: DataFrame, order: list[str], after: list[object] | None = None, limit: int = 20) -> DataFrame:
    """The next rows in the order after a row's values of it (a cursor: the last row of the page before), from the start without one.

    order ends with a column that tells all rows apart. Nulls come first. What is added or taken away before the cursor moves nothing, and the
    condition reaches the scan, where an offset counts through all rows before it."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    if after is not None:
        if len(after) != len(order):
            raise ValueError("a cursor has a value for each column of the order")
        later = F.lit(False)
        for c, v in reversed(list(zip(order, after, strict=True))):
            more = F.col(c).isNotNull() if v is None else F.coalesce(F.col(c) > F.lit(v), F.lit(False))
            later = more | (F.col(c).eqNullSafe(F.lit(v)) & later)
        if after[0] is not None:
            rows = rows.where(F.col(order[0]) >= F.lit(after[0]))
        rows = rows.where(later)
    return rows.orderBy(*order).limit(limit)


def page(rows: DataFrame, order: list[str], skip: int = 0, limit: int = 20) -> DataFrame:
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip must not be negative and limit be from 1 to 100")
    return rows.orderBy(*order).offset(skip).limit(limit)


def with_template_variables(templates: DataFrame) -> DataFrame:
    return templates.withColumn("variables", T.template_variables(F.col("template")))

"""What the operators of this package share: shared scratch space, word patterns and hot-key helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words, as the contracts of the queries fix it.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
#: Lower-cases A-Z and nothing else.
LOWER_AZ = {i: i + 32 for i in range(65, 91)}
#: Rows in an Arrow batch; texts are long, so the default of 10,000 would be some 30 MB and more.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small in rows and bytes, unless the session already asks for smaller ones.

    Texts and sets of shingles can be long; both sides of the Arrow stream hold a batch several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not re.fullmatch(r"\d+b?", spark.conf.get(key)) or not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of the cluster, spark.checkpoint.dir.

    Only where that setting is absent (tests on one machine) is a temporary folder taken."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault("root", "file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_LOCAL: dict[str, str] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes the files that stored() made, once what was made of them is stored itself."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[pa.Array]:
    """Consecutive parts of an array of texts, of at most so many bytes or a single text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
        yield texts.slice(at, to - at)
        at = to


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The WORDs of whole texts: where each text's begin (and the last one's end), each word's number, and the distinct words.

    Arrow splits and numbers them; ASCII blanks are the same set as WORD's. lower: A-Z in lower case. Null counts as empty."""
    # a copy of its own: Arrow's ascii_lower misreads a part of an array whose offsets were widened
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "").cast(pa.large_string())
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    if "" in words:
        full = numbers != words.index("")
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
        numbers = numbers[full]
    return starts, numbers, words


def salted(key: Column | str, salt_from: Column | str, salts: int = 1024) -> Column:
    return F.pmod(F.xxhash64(salt_from, key), F.lit(salts)).cast("int")


def with_group_value(df: DataFrame, keys: list[str], agg: Column, out: str, salt_from: str, salts: int = 1024) -> DataFrame:
    """df with an aggregate of each row's group joined on; keys may be hot.

    The rows of a group are dealt over salts. The group's value is sent only to the salts that the group has, so the
    table to join has at most one row for each (key, salt) pair that occurs. agg must be a min, max or sum of a
    column; it is made in two steps, (key, salt) and then key, both with map-side partial aggregation."""
    salted_df = df.withColumn("_salt", salted(F.struct(*keys), salt_from, salts))
    per_key = salted_df.groupBy(*keys).agg(agg.alias(out), F.collect_set("_salt").alias("_salts"))
    per_salt = per_key.withColumn("_salt", F.explode("_salts")).drop("_salts")
    per_salt = per_salt.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_salt").alias("_key_salt"), out)
    cond = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col("_salt") == F.col("_key_salt")]
    return salted_df.join(per_salt, cond, "left").select(*df.columns, out)


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)

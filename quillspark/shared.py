"""Tables between two steps of a plan, in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Rows and bytes of an Arrow batch where texts go to Python: by default 10,000 rows go at once, each several times over.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, unless the session already asks for smaller ones: what a worker holds then doesn't depend on the table."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not re.fullmatch(r"\d+b?", spark.conf.get(key)) or not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; only on a single machine without that setting, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault("root", "file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Removes the files of stored() tables, once what was made of them is written itself."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df as a local table if it has at most so many rows, which then meets others by broadcast; else stored()."""
    table = df.limit(rows + 1).toArrow()
    if table.num_rows > rows:
        return stored(df, "small")
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies below a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

"""Statistics of a running job, gathered while its rows are written, without a second pass."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import catalog

LOG = "run string, at double, operation string, n long, seconds double, metrics map<string,double>"


def chunk_metrics() -> dict[str, Column]:
    """What is told about chunks on their way: texts, tokens, vectors and how long texts are."""
    text = F.coalesce(F.col("page_content"), F.lit(""))
    return {"texts": F.count("*"), "tokens": F.coalesce(F.sum(T.count_words(text)), F.lit(0)), "vectors": F.count("embedding"), "longest": F.coalesce(F.max(F.length(text)), F.lit(0))}


@dataclass(frozen=True)
class Runs:
    """A log of operations below a path, appended to by every run; a reset is an entry of its own, so nothing is rewritten."""

    spark: SparkSession
    path: str

    def _append(self, run: str, operation: str, n: int, seconds: float, metrics: dict[str, float]) -> None:
        row = [(run, time.time(), operation, n, seconds, {k: float(v) for k, v in metrics.items() if v is not None})]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(self.path)

    def write(self, rows: DataFrame, path: str, operation: str = "index", metrics: dict[str, Column] | None = None, mode: str = "append", run: str | None = None) -> str:
        """Writes rows as Parquet and logs how many they were, how long it took and the metrics, aggregates that Spark observes in the same job. The run's id.

        Without metrics those of chunk_metrics() are taken. A job that fails logs nothing."""
        run, seen, start = run or uuid.uuid4().hex, Observation(), time.time()
        wanted = {"rows": F.count(F.lit(1)), **(chunk_metrics() if metrics is None else metrics)}
        rows.observe(seen, *[c.alias(k) for k, c in wanted.items()]).write.mode(mode).parquet(path)
        found = seen.get
        self._append(run, operation, int(found.get("rows", 0)), time.time() - start, found)
        return run

    def timed(self, operation: str, n: int, seconds: float, run: str | None = None) -> str:
        """Logs what was done elsewhere, such as searches."""
        run = run or uuid.uuid4().hex
        self._append(run, operation, n, seconds, {})
        return run

    def reset(self, run: str | None = None) -> None:
        """Statistics begin anew: those of a run, or all. What is logged later counts."""
        self._append(run or "", "reset", 0, 0.0, {})

    def log(self) -> DataFrame:
        """The entries that count: those after the last reset of their run and of all."""
        try:
            rows = self.spark.read.schema(LOG).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)
        resets = rows.where("operation = 'reset'").groupBy(F.col("run").alias("_run")).agg(F.max("at").alias("_at"))
        every = resets.where("_run = ''").select(F.col("_at").alias("_all"))
        rows = rows.where("operation <> 'reset'").join(resets, F.col("run") == F.col("_run"), "left").join(F.broadcast(every), F.lit(True), "left")  # one row at most
        return rows.where("(_at is null or at > _at) and (_all is null or at > _all)").drop("_run", "_at", "_all")

    def stats(self, run: str | None = None) -> DataFrame:
        """One row: catalog.operation_stats() of what counts, of one run or all."""
        rows = self.log()
        return catalog.operation_stats(rows if run is None else rows.where(F.col("run") == run))

    def metrics(self) -> DataFrame:
        """operation, metric and its total over what counts."""
        return self.log().select("operation", F.explode("metrics").alias("metric", "value")).groupBy("operation", "metric").agg(F.sum("value").alias("total"))

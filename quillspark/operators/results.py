"""Results of costly calls, kept by the digest of what was asked: equal texts are encoded once, ever."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from quillspark.functions import text as T
from quillspark.operators.vectors import Embedder
from quillspark.shared import stored


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass(frozen=True)
class Results:
    """A table digest -> result below a path, appended to; name tells models or their versions apart, as a folder each."""

    spark: SparkSession
    path: str
    name: str

    def _at(self) -> str:
        return f"{self.path}/model={self.name}"

    def known(self, kind: ty.DataType) -> DataFrame:
        schema = ty.StructType([ty.StructField("digest", ty.StringType()), ty.StructField("result", kind)])
        try:
            return self.spark.read.schema(schema).parquet(self._at())
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def through(self, rows: DataFrame, asked: Column, call: Callable[[Column], Column], kind: ty.DataType, out: str) -> DataFrame:
        """rows with `out`, the result for `asked` of each row; null for null. Only distinct texts without a result are called for, and then appended.

        They are dealt by length and called in order of it, so that a batch's texts are about as long as each other and pad little. A text that many rows share is one
        row from the shuffle on (partial aggregation in the map tasks); its result goes back to its rows by an equi-join that adaptive execution splits where
        a digest is hot. A writer that was lost and comes again may append a result twice; one counts."""
        rows = rows.withColumns({"_text": asked, "_digest": digest(asked)})
        wanted = rows.where("_digest is not null").groupBy("_digest").agg(F.first("_text").alias("_text"))
        new = wanted.join(self.known(kind).select(F.col("digest").alias("_digest")), "_digest", "left_anti").withColumn("_n", F.length("_text"))
        new = new.repartitionByRange("_n", "_digest").sortWithinPartitions("_n", "_digest")
        new.select(F.col("_digest").alias("digest"), call(F.col("_text")).cast(kind).alias("result")).write.mode("append").parquet(self._at())
        known = self.known(kind).groupBy(F.col("digest").alias("_digest")).agg(F.first("result").alias(out))
        return rows.drop("_text").drop(out).join(known, "_digest", "left").drop("_digest")


def batches(encode: Callable[[list[str]], list[list[float]]], batch: int) -> Callable[[Column], Column]:
    """A model's encode as a column function: Spark hands it batches, and loads it once a Python worker."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        return lambda texts: np.asarray(encode([str(t) for t in texts]), np.float32)

    run = predict_batch_udf(load, return_type=ty.ArrayType(ty.FloatType()), batch_size=batch)
    return lambda text: run(text)


def embed(rows: DataFrame, embedder: Embedder, path: str, name: str, text_col: str = "page_content", is_query: bool = False, batch: int = 16) -> DataFrame:
    """rows with `embedding`, as vectors.embed() gives it, each distinct input encoded once; path and name: where results are kept."""
    asked = T.embedding_input(F.coalesce(F.col(text_col), F.lit("")), is_query)
    return Results(rows.sparkSession, path, name).through(stored(rows, "to-embed"), asked, batches(embedder.encode, batch), ty.ArrayType(ty.FloatType()), "embedding")


def generate(prompts: DataFrame, model: Callable[[list[str]], list[str]], path: str, name: str, prompt_col: str = "prompt", out: str = "response", batch: int = 8) -> DataFrame:
    """prompts with the model's answers, each distinct prompt asked once. For models that answer alike each time."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            values = s.tolist()
            yield pd.Series([a for i in range(0, len(values), batch) for a in model(values[i : i + batch])], dtype="object")

    return Results(prompts.sparkSession, path, name).through(stored(prompts, "to-ask"), F.col(prompt_col), run, ty.StringType(), out)

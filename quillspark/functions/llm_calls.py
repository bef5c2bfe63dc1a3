"""Answers of a language model: calling one, and reading what it says. The model is a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import prompts as P
from quillspark.functions import text as T

CARE_PLAN = "array<struct<recordType:string,period:string,subtype:string,reason:string>>"


def echo(prompts: list[str]) -> list[str]:
    """A stand-in for a model."""
    return [f"Answer: {p[-80:]}" for p in prompts]


def generate(rows: DataFrame, prompt_col: str = "prompt", model: Callable[[list[str]], list[str]] = echo, fail: bool = True) -> DataFrame:
    """rows with `response`: the model's answers to batches of prompts. Where the model fails the query fails, or, without fail, the
    batch's prompts are asked one by one and those that fail have null."""

    def ask(prompts: list[str]) -> list[str | None]:
        try:
            return list(model(prompts))
        except Exception:  # noqa: BLE001  any fault of a model
            if fail:
                raise
            return [None] if len(prompts) == 1 else [a for p in prompts for a in ask([p])]

    @F.pandas_udf("string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in prompts:
            yield pd.Series(ask(s.fillna("").tolist()), dtype=object)

    return rows.withColumn("response", run(F.col(prompt_col)))


def care_plan_rows(responses: DataFrame, most_reason: int = 150) -> DataFrame:
    """The rows of the JSON arrays in `response`, with `error` where one breaks a rule; a response without an array of rows gives one row with an error."""
    found = T.json_array(F.col("response"))
    parsed = responses.withColumn("_found", found).withColumn("_plan", F.from_json("_found", CARE_PLAN))
    rows = parsed.select(*responses.columns, "_found", F.posexplode_outer("_plan").alias("item", "_p")).select(*responses.columns, "_found", "item", "_p.*")
    error = P.care_plan_row_error(F.col("recordType"), F.col("period"), F.col("subtype"), F.col("reason"))
    error = F.when(F.col("_found").isNull(), "no JSON array in the response").when(F.col("item").isNull(), "the JSON array can't be read").otherwise(error)
    return rows.withColumn("error", error).withColumn("reason", T.strip(F.substring("reason", 1, most_reason))).drop("_found")


def care_plan_lists(responses: DataFrame, key: str = "id") -> DataFrame:
    """key, plan (an array of rows) and error: one fault, the first, fails a whole list."""
    rows = care_plan_rows(responses)
    item = F.struct("item", "recordType", "period", "subtype", "reason")
    bad = F.min(F.when(F.col("error").isNotNull(), F.struct(F.coalesce("item", F.lit(0)).alias("item"), "error")))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("plan"), bad.alias("bad"))
    return lists.select(key, F.when(F.col("bad").isNull(), F.transform("plan", lambda p: p.dropFields("item"))).alias("plan"), F.when(F.col("bad").isNotNull(), F.format_string("item %d: %s", "bad.item", "bad.error")).alias("error"))

"""Prompts as Column expressions: templates, chat history, care plans, measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import constants as K


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """{{name}} replaced by each value in turn; what a value brings in is replaced by later ones."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{%s}}" % kv[0]), F.coalesce(kv[1], F.lit(""))), values.items(), template)


def substitute_map(template: Column, values: Column) -> Column:
    """The same from a map column, in its order."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def format_template(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced and {{ }} taken as single braces; null where a name has no value."""
    open_, close = F.lit("\x01"), F.lit("\x02")
    t = F.replace(F.replace(template, F.lit("{{"), open_), F.lit("}}"), close)
    for k, v in values.items():
        t = F.replace(t, F.lit("{%s}" % k), v)
    t = F.when(~t.rlike(r"\{[^}]*\}"), t)
    return F.replace(F.replace(t, open_, F.lit("{")), close, F.lit("}"))


def context_lines(results: DataFrame, by: str, most: int = 3) -> DataFrame:
    """Per query, the first results as lines "- content"."""
    top = results.where(F.col("rank") <= most).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "page_content"))).alias("_r"))
    return top.select(by, F.array_join(F.transform("_r", lambda r: F.concat(F.lit("- "), r["page_content"])), "\n").alias("context"))


def history(messages: DataFrame, last: int, roles: dict[str, str]) -> DataFrame:
    """Per conv_id, the `last` messages but the newest, as lines "role: text" in order; other roles are left out."""
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    role = reduce(lambda c, kv: c.when(F.col("role") == kv[0], kv[1]), roles.items(), F.when(F.lit(False), ""))
    some = messages.withColumn("_n", F.row_number().over(back)).where(F.col("_n").between(2, last)).withColumn("_role", role).where("_role is not null")
    lines = some.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "_role", "text").alias("line")))).alias("_l"))
    return lines.select("conv_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("history"))


def default_prompt(query: Column, context: Column, language: Column) -> Column:
    one = {k: F.concat(F.lit(a), query, F.lit(b), context, F.lit(c)) for k, (a, b, c) in K.DEFAULT_PROMPT.items()}
    return F.when(language == "vi", one["vi"]).otherwise(one["en"])


def with_clean_output(prompt: Column, language: Column) -> Column:
    return F.concat(prompt, F.when(language == "en", K.CLEAN_OUTPUT["en"]).otherwise(K.CLEAN_OUTPUT["vi"]))


def chat_prompt(system: Column, past: Column, query: Column, language: Column) -> Column:
    title = F.when(language == "vi", K.HISTORY_TITLE["vi"]).otherwise(K.HISTORY_TITLE["en"])
    told = F.when(F.length(past) > 0, F.concat(F.lit("\n\n"), title, F.lit("\n"), past, F.lit("\n"))).otherwise("")
    return F.concat(system, told, F.lit("\n\nUser: "), query)


def _or(value: Column, other: str) -> Column:
    return F.when(value.isNull() | (value == ""), other).otherwise(value)


def care_plan_error(r: dict[str, Column]) -> Column:
    """The first rule that a care-plan request breaks, or null; a missing value breaks its rule."""
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(fails(r["age"].between(1, 120)), "age must be from 1 to 120")
        .when(fails(r["bmi"].between(10.0, 50.0)), "bmi must be from 10.0 to 50.0")
        .when(fails(F.lower(r["gender"]).isin("nam", "nữ", "khác")), "unknown gender")
        .when(fails(F.lower(r["diabetesType"]).isin("type 1", "type 2", "gestational")), "unknown diabetes type")
    )


CARE_PLAN_HEAD = (
    f"Recommend measurements for a person with diabetes. Answer with a JSON array only, of objects with recordType ({', '.join(K.RECORD_TYPES)}), period ({', '.join(K.PERIODS)}), "
    "subtype or null, and a clinical reason in Vietnamese of at most 150 words.\n\nProfile:\n"
)


def care_plan_prompt(r: dict[str, Column]) -> Column:
    """What to measure, when and why, for one patient; the answer is to be a JSON array of recordType, period, subtype, reason."""
    fields = [("ID", r["patientId"]), ("Age", r["age"].cast("string")), ("Gender", r["gender"]), ("BMI", r["bmi"].cast("string")), ("Diabetes type", r["diabetesType"]), ("Insulin schedule", r["insulinSchedule"]), ("Treatment method", r["treatmentMethod"]), ("Complications", F.array_join(r["complications"], ", ")), ("Past diseases", _or(F.array_join(r["pastDiseases"], ", "), "None")), ("Lifestyle", r["lifestyle"])]
    return F.concat(F.lit(CARE_PLAN_HEAD), F.concat_ws("\n", *[F.concat(F.lit(f"- {k}: "), F.coalesce(v, F.lit(""))) for k, v in fields]))


def care_plan_row_error(record_type: Column, period: Column, subtype: Column, reason: Column) -> Column:
    """The first rule that a row of a care plan breaks, or null."""
    allowed = F.when(F.lit(False), False)
    for k, v in K.SUBTYPES.items():
        allowed = allowed.when(record_type == k, subtype.isin(*v))
    return (
        F.when(F.coalesce(record_type, F.lit("")) == "", "recordType is missing")
        .when(~record_type.isin(*K.RECORD_TYPES), "unknown recordType")
        .when(F.coalesce(period, F.lit("")) == "", "period is missing")
        .when(~period.isin(*K.PERIODS), "unknown period")
        .when(subtype.isNotNull() & ~allowed, "unknown subtype")
        .when(F.coalesce(reason, F.lit("")) == "", "reason is missing")
    )


def measurement_prompt(r: dict[str, Column]) -> Column:
    fields = [("Loại đo", r["measurementType"]), ("Giá trị", r["value"].cast("string")), ("Thời điểm", r["time"]), ("Bối cảnh", _or(r["context"], K.NO_CONTEXT)), ("Ghi chú", _or(r["note"], K.NO_NOTE))]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in fields])


def feedback(answer: Column, most: int = 250) -> Column:
    return F.regexp_replace(F.substring(answer, 1, most), r"(?U)\A\s+|\s+\z", "")

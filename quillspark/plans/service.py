"""Templates, settings, chat sessions and knowledge bases, over small tables; care plans and measurements, over a model."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import constants as K
from quillspark.functions import llm_calls
from quillspark.functions import prompts as P
from quillspark.functions import text as T
from quillspark.operators import fields, vectors
from quillspark.operators.catalog import Collections, KeyValueTable, Store, page
from quillspark.plans import retrieval

TEMPLATE = "id string, name string, description string, template string, variables array<string>, example_values map<string,string>, created_at string, updated_at string"
SETTINGS = "id string, system_prompt string, language string, knowledge_names array<string>, default_prompt_template_id string"
MESSAGE = "id string, batch string, seq int, role string, content string, created_at string"
BASE = "name string, description string, created_at string, updated_at string, documents long, total_size long"
Model = Callable[[list[str]], list[str]]


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


@dataclass
class Templates:
    """Prompt templates; the first one becomes the default."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.rows = KeyValueTable(self.spark, f"{self.root}/templates", TEMPLATE, "id")
        self.settings = Settings(self.spark, self.root)

    def create(self, name: str, template: str, description: str = "", example_values: dict[str, str] | None = None) -> str:
        first, key, now = self.rows.read().isEmpty(), uuid.uuid4().hex, _now()
        row = self.spark.createDataFrame([(key, name, description, template, None, example_values or {}, now, now)], TEMPLATE)
        self.rows.put(row.withColumn("variables", T.template_variables(F.col("template"))))
        if first:
            self.settings.patch(default_prompt_template_id=key)
        return key

    def update(self, key: str, **values: str) -> None:
        self.rows.patch(key, **values, updated_at=_now())
        if values.get("template") is not None:
            self.rows.put(self.rows.get(key).withColumn("variables", T.template_variables(F.col("template"))))

    def delete(self, key: str) -> None:
        self.rows.drop(F.col("id") == key)

    def list(self, skip: int = 0, limit: int = 20) -> DataFrame:
        return page(self.rows.read(), ["created_at", "id"], skip, limit)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Templates by word search over name, description and text, the best first."""
        rows = self.rows.read()
        asked = self.spark.createDataFrame([(1, query)], "query_id int, query_text string")
        best = fields.search(rows, asked, {"name": 1.0, "description": 1.0, "template": 1.0}, limit)
        return best.join(rows, "id").drop("query_id").orderBy("rank")

    def generate(self, key: str, values: dict[str, str]) -> str:
        """The template with its variables filled in; an error names what is missing."""
        row = self.rows.get(key).head()
        if row is None:
            raise KeyError(key)
        missing = [v for v in row.variables if v not in values]
        if missing:
            raise ValueError(f"values are missing: {', '.join(missing)}")
        filled = self.rows.get(key).select(P.substitute(T.literal(row.template), {k: T.literal(v) for k, v in values.items()}).alias("t"))
        return filled.head()["t"]


@dataclass
class Settings:
    """One row of settings, made with defaults when it is first asked for."""

    spark: SparkSession
    root: str

    def _table(self) -> KeyValueTable:
        t = KeyValueTable(self.spark, f"{self.root}/settings", SETTINGS, "id")
        if t.read().isEmpty():
            t.put(self.spark.createDataFrame([("global", None, "vi", [], None)], SETTINGS))
        return t

    def get(self) -> dict[str, object]:
        return self._table().get("global").head().asDict()

    def set_default_template(self, key: str) -> None:
        if KeyValueTable(self.spark, f"{self.root}/templates", TEMPLATE, "id").get(key).isEmpty():
            raise KeyError(key)
        self.patch(default_prompt_template_id=key)

    def patch(self, **values: object) -> None:
        """Sets what isn't None."""
        row = {**self.get(), **{k: v for k, v in values.items() if v is not None}}
        self._table().put(self.spark.createDataFrame([tuple(row[c.split()[0]] for c in SETTINGS.split(", "))], SETTINGS))


@dataclass
class Sessions:
    """Chat sessions, one per user: a table that messages are appended to; a deleted session is a message of its own kind that hides what was before."""

    spark: SparkSession
    root: str

    def _rows(self) -> DataFrame:
        path = f"{self.root}/messages"
        return self.spark.read.schema(MESSAGE).parquet(path) if Store(self.spark, path).has("") else self.spark.createDataFrame([], MESSAGE)

    def add_all(self, messages: DataFrame) -> None:
        """Appends messages (user_id, seq, role, content): those of a user that come together in order of seq."""
        rows = messages.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("id"), F.lit(f"{_now()}-{uuid.uuid4().hex}").alias("batch"), "seq", "role", "content", F.lit(_now()).alias("created_at"))
        rows.write.mode("append").parquet(f"{self.root}/messages")

    def add(self, user_id: str, role: str, content: str) -> None:
        self.add_all(self.spark.createDataFrame([(user_id, 0, role, content)], "user_id string, seq int, role string, content string").coalesce(1))

    def messages(self, user_id: str | None = None, of: DataFrame | None = None) -> DataFrame:
        """conv_id, turn, role, text of one user's session, of those of some (conv_id), or of all."""
        rows = self._rows() if user_id is None else self._rows().where(F.col("id") == f"user_{user_id}")
        if of is not None:
            rows = rows.join(of.select(F.col("conv_id").alias("id")).distinct(), "id", "left_semi")
        gone = F.max(F.when(F.col("role") == "deleted", F.col("batch"))).over(Window.partitionBy("id"))
        rows = rows.withColumn("_gone", gone).where("role <> 'deleted' and (_gone is null or batch > _gone)")
        turn = F.row_number().over(Window.partitionBy("id").orderBy("batch", "seq")) - 1
        return rows.select(F.col("id").alias("conv_id"), turn.alias("turn"), "role", F.col("content").alias("text"))

    def delete(self, user_id: str) -> None:
        if self.messages(user_id).isEmpty():
            raise KeyError(user_id)
        self.add(user_id, "deleted", "")


@dataclass
class KnowledgeBases:
    """Collections with what is known about them."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.collections = Collections(self.spark, f"{self.root}/collections")
        self.about = KeyValueTable(self.spark, f"{self.root}/bases", BASE, "name")

    def create(self, name: str, description: str = "", force: bool = False) -> bool:
        if not 1 <= len(name) <= 255:
            raise ValueError("a name has 1 to 255 characters")
        new = self.collections.create(name, force)
        if new:
            self.about.put(self.spark.createDataFrame([(name, description, _now(), None, 0, 0)], BASE))
        return new

    def update(self, name: str, description: str) -> None:
        self.about.patch(name, description=description, updated_at=_now())

    def refresh(self, name: str, files: DataFrame) -> None:
        """Writes how many files (size) there are and their bytes."""
        n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
        self.about.patch(name, documents=n, total_size=size, updated_at=_now())

    def drop(self, name: str) -> None:
        """With its chunks and raw files."""
        self.collections.drop(name)
        Store(self.spark, f"{self.root}/files").remove(f"collection={name}")
        self.about.drop(F.col("name") == name)


def chat(root: str, questions: DataFrame, chunks: DataFrame | None = None, embedder: vectors.Embedder | None = None, model: Model = llm_calls.echo, template_id: str | None = None, k: int = 5, threshold: float = 0.3) -> DataFrame:
    """user_id and answer for one question of each of many users (user_id, query): the whole turn, written to their sessions.

    Prompts: the settings' own, else the template with that id, else the default one; a template's example values are filled in. Without chunks there is no
    context. An answer of under five characters becomes an apology, and so does one that the model fails to give."""
    spark = questions.sparkSession
    sessions, templates = Sessions(spark, root), Templates(spark, root)
    settings = templates.settings.get()
    row = templates.rows.get(template_id).head() if template_id else None
    template, examples = settings["system_prompt"] or (row.template if row else None), dict(row.example_values or {}) if row else {}
    sessions.add_all(questions.select("user_id", F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("query").alias("content")))
    asked = questions.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("conv_id"), "user_id", "query", F.lit(settings["language"]).alias("language"))
    found = spark.createDataFrame([], "conv_id string, rank int, page_content string")
    if chunks is not None and embedder is not None:
        names = list(settings["knowledge_names"] or [])
        some = chunks.where(F.col("collection").isin(*names)) if names else chunks
        queries = vectors.embed(asked.select(F.col("conv_id").alias("query_id"), F.col("query").alias("query_text")), embedder, "query_text", is_query=True)
        queries = queries.withColumn("query_embedding", F.col("embedding").cast("array<double>")).drop("embedding")
        found = retrieval.with_content(retrieval.search(some, queries, k, threshold=threshold), some, []).select(F.col("query_id").alias("conv_id"), "rank", F.col("content").alias("page_content"))
    prompts = retrieval.chat_prompts(asked, found, sessions.messages(of=asked), template, examples)
    said = llm_calls.generate(prompts.join(asked, "conv_id"), model=model, fail=False)
    answer = F.when(F.col("response").isNull(), F.when(F.col("language") == "vi", K.FAILURE["vi"]).otherwise(K.FAILURE["en"])).otherwise(T.guarded_response(F.col("response"), F.col("language")))
    sessions.add_all(said.select("user_id", F.lit(0).alias("seq"), F.lit("assistant").alias("role"), answer.alias("content")))
    # as written: the model isn't asked again when the rows are read
    last = sessions.messages(of=asked).groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"))
    return asked.select("conv_id", "user_id").join(last, "conv_id").select("user_id", "answer")


def health(spark: SparkSession, root: str) -> dict[str, object]:
    """Whether the tables can be read, and what runs."""
    try:
        Settings(spark, root).get()
        ok = "healthy"
    except Exception as e:  # noqa: BLE001  what fails is what is told
        ok = f"unhealthy: {type(e).__name__}"
    return {"status": ok, "spark": spark.version, "collections": len(Collections(spark, f"{root}/collections").names())}


def care_plans(requests: DataFrame, model: Model = llm_calls.echo) -> DataFrame:
    """The rows of the plans that a model gives for requests; requests that break a rule give one row with `error` and aren't asked."""
    fields = {c: F.col(c) for c in ("patientId", "age", "gender", "bmi", "diabetesType", "insulinSchedule", "treatmentMethod", "complications", "pastDiseases", "lifestyle")}
    rows = requests.withColumn("error", P.care_plan_error(fields))
    asked = llm_calls.generate(rows.where("error is null").select("patientId", P.care_plan_prompt(fields).alias("prompt")), model=model)
    plans = llm_calls.care_plan_rows(asked.drop("prompt")).drop("response")  # an answer that can't be read is a row with its error
    return plans.unionByName(rows.where("error is not null").select("patientId", "error"), allowMissingColumns=True)


def analyse_measurements(requests: DataFrame, model: Model = llm_calls.echo) -> DataFrame:
    """patientId and feedback, at most 250 characters of what a model says to each measurement."""
    fields = {c: F.col(c) for c in ("measurementType", "value", "time", "context", "note")}
    said = llm_calls.generate(requests.select("patientId", P.measurement_prompt(fields).alias("prompt")), model=model)
    return said.select("patientId", P.feedback(F.col("response")).alias("feedback"))


def suggest_templates(ideas: DataFrame, model: Model = llm_calls.echo) -> DataFrame:
    """idea and the template that a model makes of it."""
    asked = ideas.withColumn("prompt", F.concat(F.lit("Write a prompt template with {{variables}} for this purpose:\n"), "idea"))
    return llm_calls.generate(asked, model=model).select("idea", T.strip(F.col("response")).alias("template"))

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import vectors
from quillspark.plans import retrieval
from quillspark.plans import service as S


def test_templates_and_settings(spark, tmp_path):
    t = S.Templates(spark, str(tmp_path))
    a = t.create("greeting", "Hello {{name}}, about {{topic}}", "says hello")
    b = t.create("summary", "Sum up {{text}}")
    assert t.settings.get()["default_prompt_template_id"] == a
    assert t.generate(a, {"name": "{{topic}}", "topic": "it's"}) == "Hello it's, about it's"
    with pytest.raises(ValueError, match="topic"):
        t.generate(a, {"name": "x"})
    t.update(b, template="Sum {{a}} {{b}}")
    assert t.rows.get(b).head().variables == ["a", "b"] and [r.id for r in t.list(limit=1).collect()] == [a]
    t.create("other", "nothing of the kind")
    assert [r.name for r in t.search("hello").collect()] == ["greeting"]
    t.delete(a)
    with pytest.raises(KeyError):
        t.generate(a, {})


def test_sessions(spark, tmp_path):
    s = S.Sessions(spark, str(tmp_path))
    s.add("u", "user", "hi")
    s.add("u", "assistant", "hello")
    assert [(r.turn, r.role, r.text) for r in s.messages("u").orderBy("turn").collect()] == [(0, "user", "hi"), (1, "assistant", "hello")]
    s.delete("u")
    with pytest.raises(KeyError):
        s.delete("u")
    s.add("u", "user", "again")
    assert [(r.turn, r.text) for r in s.messages().collect()] == [(0, "again")]


def test_chat(spark, tmp_path):
    root = str(tmp_path)
    t = S.Templates(spark, root)
    key = t.create("x", "{{query}} | {{context}} | {{chat_history}} | {{tone}}", example_values={"tone": "calm"})
    e = vectors.HashEmbedder(16)
    chunks = retrieval.ingest(spark.createDataFrame([(1, "the cat sat on the mat, happily")], "doc_id long, page_content string"), "c", e)
    ask = lambda *qs: spark.createDataFrame(list(qs), "user_id string, query string")

    def model(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("no model")
        return [f"<b>You said</b> {len(p.splitlines())} lines" if "cat" in p else "x" for p in prompts]

    got = {r.user_id: r.answer for r in S.chat(root, ask(("a", "cat on a mat"), ("b", "?"), ("c", "boom")), chunks, e, model, key, threshold=0.0).collect()}
    assert got["a"].startswith("You said") and got["b"].startswith("Xin lỗi, tôi không thể") and got["c"].startswith("Xin lỗi, tôi gặp sự cố")
    S.chat(root, ask(("a", "more of the cat")), model=lambda ps: ["the answer is " + str("Trợ lý: You said" in ps[0])]).collect()
    assert [r.role for r in S.Sessions(spark, root).messages("a").orderBy("turn").collect()] == ["user", "assistant", "user", "assistant"]
    assert S.Sessions(spark, root).messages("a").orderBy(F.col("turn").desc()).head().text == "the answer is True"
    with pytest.raises(KeyError):
        t.settings.set_default_template("nothing")
    assert S.health(spark, root)["status"] == "healthy"


def test_knowledge_bases(spark, tmp_path):
    k = S.KnowledgeBases(spark, str(tmp_path))
    assert k.create("a", "first") and not k.create("a")
    k.refresh("a", spark.createDataFrame([(3,), (4,)], "size long"))
    k.update("a", "new")
    row = k.about.get("a").head()
    assert (row.description, row.documents, row.total_size) == ("new", 2, 7)
    k.drop("a")
    assert k.collections.names() == [] and k.about.get("a").isEmpty()


def test_care_plans(spark):
    schema = "patientId string, age int, gender string, bmi double, diabetesType string, insulinSchedule string, treatmentMethod string, complications array<string>, pastDiseases array<string>, lifestyle string"
    df = spark.createDataFrame([("p1", 40, "Nữ", 22.0, "Type 2", "none", "diet", ["x"], [], "calm"), ("p2", 400, "Nữ", 22.0, "Type 2", "none", "diet", [], [], "calm")], schema)
    model = lambda prompts: [json.dumps([{"recordType": "BloodGlucose", "period": "noon", "subtype": None, "reason": "None" if "Past diseases: None" in p else "?"}]) for p in prompts]
    lost = {r.patientId: r.error for r in S.care_plans(df, lambda ps: ["no plan"] * len(ps)).collect()}
    assert lost["p1"] == "no JSON array in the response"
    assert S.care_plans(df.withColumn("age", F.lit(None).cast("int")), model).where("error is null").count() == 0
    rows = {r.patientId: r for r in S.care_plans(df, model).collect()}
    assert rows["p1"].error is None and rows["p1"].reason == "None" and rows["p2"].error == "age must be from 1 to 120"


def test_measurements(spark):
    df = spark.createDataFrame([("p", "Blood Glucose", "5.1", "noon", None, "")], "patientId string, measurementType string, value string, time string, context string, note string")
    (row,) = S.analyse_measurements(df, lambda ps: [p + " " + "x" * 300 for p in ps]).collect()
    assert len(row.feedback) == 250 and "Không rõ" in row.feedback and "Không có ghi chú." in row.feedback
    assert S.suggest_templates(spark.createDataFrame([("x",)], "idea string")).count() == 1

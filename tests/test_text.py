import pytest
from pyspark.sql import functions as F

from quillspark.functions import llm_calls
from quillspark.functions import prompts as P
from quillspark.functions import text as T


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if None not in cols.values() else spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(column.alias("v")).head()["v"]


@pytest.mark.parametrize("text,want", [("Xin chào, tôi là trợ lý AI", "vietnamese"), ("Hello, I am an AI assistant", "english"), ("123 456 789", "unknown"), ("Việt Nam đang phát triển mạnh mẽ", "vietnamese"), ("Machine learning is the future", "english"), ("Tôi speak English và tiếng Việt", "mixed")])
def test_chunk_language(spark, text, want):
    assert value(spark, T.chunk_language(F.col("t"))["language"], t=text) == want


@pytest.mark.parametrize("text,want", [("Xin chào, tôi là AI trợ lý", "vi"), ("Hello, I am an English speaker", "en"), ("Tôi speak English và tiếng Việt", "mixed"), ("123 456 789", "unknown"), ("", "unknown")])
def test_document_language(spark, text, want):
    assert value(spark, T.document_language(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("Một câu đơn giản, không có gì.", "simple"), ("CHƯƠNG 1: TỔNG QUAN\n\nNội dung chương 1", "hierarchical"), ("```python\nprint('x')\n```", "code"), ("| a, 1 | b, 2 |\n| c, 3 | d, 4 |", "tabular"), ("# one\n## two\n### three", "hierarchical")])
def test_structure(spark, text, want):
    assert value(spark, T.structure(F.col("t"))["structure_type"], t=text) == want


@pytest.mark.parametrize("text,want", [("CHƯƠNG 1: TỔNG QUAN", "header"), ("- Mục 1\n- Mục 2\n- Mục 3", "list"), ("Đây là một câu bình thường.", "text"), ("a  b\nc  d", "table"), ("see the Figure", "image")])
def test_content_type(spark, text, want):
    assert value(spark, T.content_type(F.col("t")), t=text) == want


def test_clean(spark):
    assert value(spark, T.clean(F.col("t")), t="  Công   ty   ABC  đạt được    kết quả  tốt  ") == "Công ty ABC đạt được kết quả tốt"
    assert value(spark, T.clean(F.col("t")), t="a#b.c | d\n\n\n\ne") == "a b. c d\n\ne"
    assert value(spark, T.clean(F.col("t")), t=None) == ""


def test_small_functions(spark):
    assert value(spark, T.sanitize(F.col("t"), 3), t="  a \n b  c") == "a b"
    assert value(spark, T.valid_patient_id(F.col("t")), t=" ab1 ") and not value(spark, T.valid_patient_id(F.col("t")), t="a-1")
    assert value(spark, T.template_variables(F.col("t")), t="{{ b }} {{a}} {{b}}") == ["a", "b"]
    assert value(spark, P.format_template(F.col("t"), {"x": F.lit("1")}), t="{x} {{x}}") == "1 {x}"
    assert value(spark, P.format_template(F.col("t"), {"x": F.lit("1")}), t="{x} {y}") is None
    assert value(spark, P.substitute_map(F.col("t"), F.create_map(F.lit("a"), F.lit("1"))), t="{{a}}b") == "1b"
    assert value(spark, T.guarded_response(F.col("t"), F.lit("en")), t="`ok`").startswith("Sorry")


def test_care_plan_rows(spark):
    df = spark.createDataFrame([("x [{\"recordType\":\"BloodPressure\",\"period\":\"noon\",\"subtype\":\"fasting\",\"reason\":\"r\"}]",), ("no",)], "response string")
    row = llm_calls.care_plan_rows(df).where("item = 0").head()
    assert row.error == "unknown subtype" and row.period == "noon"
    assert sorted((r.error, r.item) for r in llm_calls.care_plan_rows(df).collect())[0] == ("no JSON array in the response", None)


def test_segmenter(spark):
    cut = T.segmenter(lambda t: t.replace("Việt Nam", "Việt_Nam").split(" "))
    assert value(spark, T.bm25_tokens(F.col("t"), cut), t="Ở Việt Nam , tôi") == ["ở", "việt_nam", "tôi"]
    assert value(spark, T.bm25_tokens(F.col("t"), cut), t="Plain, text") == ["plain", "text"]
    assert value(spark, T.chunk_tokens(F.col("t"), cut), t="Tôi ở Việt Nam và đẹp lắm") == ["ở", "Việt_Nam", "đẹp", "lắm"]
    assert value(spark, T.chunk_tokens(F.col("t")), t="The cats don't sit") == ["cats", "sit"]


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"metadata": {"v": 1}, "a": ["x", "y"], "abbreviations": ["y", "z"]}', encoding="utf-8")
    assert T.dictionary_words(spark, str(tmp_path / "d.json")) == ["x", "y", "z"] and T.dictionary_words(spark, str(tmp_path / "d.json"), "abbreviations") == ["y", "z"]
    assert len(T.dictionary_words(spark, str(tmp_path / "none.json"))) == 43


def test_required_json(spark):
    assert value(spark, T.required_json_array(F.col("t")), t='x [ {"a": 1} ] y') == '[ {"a": 1} ]'
    with pytest.raises(Exception, match="no JSON array"):
        value(spark, T.required_json_array(F.col("t")), t="none")

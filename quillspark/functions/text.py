"""Text functions as Column expressions: cleaning, language, structure, content type, sizes. No UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import constants as K


def _char_class(chars: set[str]) -> str:
    """A character class with neighbours as ranges: each range costs a comparison for each character that isn't in the class."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


# the first range sorts out nearly all characters of other texts with one comparison
_MARKED = "(?=[À-ỹ])" + _char_class({x for c in K.VI_LETTERS for x in (c.lower(), c.upper())})
_MARKED_AS_IS = "(?=[À-ỹ])" + _char_class(set(K.VI_LETTERS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row: Spark shares nothing over the branches of a CASE or within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _how_many(text: Column, pattern: str) -> Column:
    """Characters in matches of pattern+. Nothing is made of each match, as regexp_count does."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))).cast("long")


def literal(text: str) -> Column:
    """A string literal that SQL string parsing has no part in."""
    return F.lit(text)


def strip(text: Column) -> Column:
    """Without leading and trailing white space, Unicode's included."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def clean(text: Column) -> Column:
    """Cleaned text: runs of blanks, empty lines, odd characters and glued sentences put right, in this order; null gives ''."""
    t = F.coalesce(text, F.lit(""))
    for pattern, to in (
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
        (r"(?U)[^\w\sÀ-ɏḀ-ỿ.,!?;:()\[\]\"'\n-]", " "),
        (rf"(?iUu)([.!?])\s*([{K.SENTENCE_STARTS}])", "$1 $2"),
        (r" +", " "),
    ):
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


def has_vietnamese(text: Column) -> Column:
    return text.rlike(_MARKED)


def vietnamese_letters(text: Column) -> Column:
    """Case doesn't count here, as it does in letters()."""
    return _how_many(text, _MARKED)


def ascii_letters(text: Column) -> Column:
    return _how_many(text, "[a-zA-Z]")


def letters(text: Column) -> Column:
    return ascii_letters(text) + _how_many(text, _MARKED_AS_IS)


def _letter_counts(text: Column) -> Column:
    """struct of ascii, letters and marked ones."""
    return let(ascii_letters(text), lambda n: F.struct(n.alias("ascii"), (n + _how_many(text, _MARKED_AS_IS)).alias("letters"), vietnamese_letters(text).alias("marked")))


def _lower_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}\p{M}\p{Pc}]+)"), 1)


def _vietnamese_score(found: Column, counts: Column, words: tuple[str, ...] | list[str], abbreviations: tuple[str, ...]) -> Column:
    """found: _lower_words() of the text, counts: its _letter_counts()."""

    def of(found: Column) -> Column:
        n = F.size(found)
        known = F.size(F.filter(found, lambda w: w.isin(*words)))
        short = F.size(F.filter(found, lambda w: w.isin(*[a for a in abbreviations if a not in words])))
        word_score = (known + F.when(n > 2, 0.5 * short).otherwise(0.0)) / n
        char_score = F.when(counts["letters"] > 0, counts["marked"] / counts["letters"]).otherwise(0.0)
        return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), word_score * 0.7 + char_score * 0.3))

    return let(found, of)


def vietnamese_score(text: Column, words: tuple[str, ...] | list[str] = K.VI_WORDS, abbreviations: tuple[str, ...] = K.VI_ABBREVIATIONS) -> Column:
    """0 to 1: 70 % the share of known words (abbreviations count half, with over two words), 30 % the share of marked letters."""
    return let(_letter_counts(text), lambda c: _vietnamese_score(_lower_words(text), c, words, abbreviations))


def _document_language(text: Column, found: Column, counts: Column, words: Column, score: Column) -> Column:
    markers = F.size(F.filter(found, lambda w: w.isin(*K.ENGLISH_MARKERS)))
    marked = counts["marked"] > 0
    return (
        F.when(text.isNull() | (words == 0) | (counts["letters"] == 0), "unknown")
        .when(marked & (markers / words > 0.2), "mixed")
        .when(marked & (score > 0.1), "vi")
        .when((counts["ascii"] / counts["letters"] > 0.9) & ~marked, "en")
        .otherwise("unknown")
    )


def document_language(text: Column) -> Column:
    """vi, en, mixed or unknown."""
    known = F.struct(_letter_counts(text).alias("c"), count_words(text).alias("words"), _lower_words(text).alias("found"))
    return let(known, lambda k: _document_language(text, k["found"], k["c"], k["words"], _vietnamese_score(k["found"], k["c"], K.VI_WORDS, K.VI_ABBREVIATIONS)))


def looks_like_table(text: Column) -> Column:
    rows = lambda lines: F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\s{2,}|\t|[|]")))
    return let(F.split(text, "\n", -1), lambda lines: (F.size(lines) >= 2) & (rows(lines) >= F.size(lines) * 0.5))


def mentions_image(text: Column) -> Column:
    return F.lower(text).rlike("|".join(map(re.escape, K.IMAGE_WORDS)))


def is_title(text: Column) -> Column:
    """Each run of letters starts with a capital and goes on in small letters, and there is one."""
    return text.rlike(r"\p{Lu}|\p{Lt}") & ~text.rlike(r"(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|(?<=[\p{Lu}\p{Ll}\p{Lt}])[\p{Lu}\p{Lt}]")


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}|\p{Lt}")


def looks_like_header(text: Column, words: Column | None = None) -> Column:
    """words: count_words() of the text, where it is known."""
    return ((count_words(text) if words is None else words) <= 15) & ~text.rlike(r"(?U)(^|\n)\s*(-|\d+\.|[a-zA-Z]\.)") & (is_upper(text) | is_title(text))


def looks_like_list(text: Column) -> Column:
    items = lambda lines: F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\A\s*(-|\d+\.|[a-zA-Z]\.)")))
    return let(F.split(text, "\n", -1), lambda lines: items(lines) >= F.size(lines) * 0.5)


def content_type(text: Column, words: Column | None = None) -> Column:
    """table, image, header, list or text: the first that fits."""
    return F.when(looks_like_table(text), "table").when(mentions_image(text), "image").when(looks_like_header(text, words), "header").when(looks_like_list(text), "list").otherwise("text")


def document_metadata(text: Column) -> Column:
    """struct of length, words, content_type, language, detected (the same) and score (Vietnamese); everything is counted once."""
    known = F.struct(_letter_counts(text).alias("c"), count_words(text).alias("words"), _lower_words(text).alias("found"))

    def of(k: Column) -> Column:
        score = _vietnamese_score(k["found"], k["c"], K.VI_WORDS, K.VI_ABBREVIATIONS)
        rated = let(score, lambda s: F.struct(_document_language(text, k["found"], k["c"], k["words"], s).alias("language"), s.alias("score")))
        return let(rated, lambda r: F.struct(F.length(text).cast("long").alias("length"), k["words"].alias("words"), content_type(text, k["words"]).alias("content_type"), r["language"].alias("language"), r["language"].alias("detected"), r["score"].alias("score")))

    return let(known, of)


def with_document_metadata(rows: DataFrame, text: str = "page_content") -> DataFrame:
    """rows with the fields of document_metadata() as columns."""
    return rows.withColumn("_about", document_metadata(F.col(text))).select(*rows.columns, "_about.*")


def chunk_language(text: Column) -> Column:
    """struct of language (vietnamese, mixed, english, unknown), vietnamese_ratio and confidence."""

    def of(c: Column) -> Column:
        n = c["letters"]
        ratio = F.when(n == 0, 0.0).otherwise(c["marked"] / n)
        language = F.when(n == 0, "unknown").when(ratio > 0.20, "vietnamese").when(ratio > 0.05, "mixed").otherwise("english")
        confidence = F.when(n == 0, 0.0).when(ratio > 0.20, F.least(ratio * 2, F.lit(1.0))).when(ratio > 0.05, 0.7).otherwise(1.0 - ratio)
        return F.struct(language.alias("language"), ratio.alias("vietnamese_ratio"), confidence.alias("confidence"))

    return let(_letter_counts(text), of)


def estimated_tokens(text: Column, about: Column | None = None) -> Column:
    """Characters by 3 (Vietnamese), 4 (English) or 3.5, rounded down. about: the text's chunk_language(), where it is known."""
    n = F.length(text)
    by = lambda c: F.when(c["language"] == "vietnamese", F.floor(n / 3)).when(c["language"] == "english", F.floor(n / 4)).otherwise(F.floor(n / 3.5))
    return (let(chunk_language(text), by) if about is None else by(about)).cast("long")


def _matches(line: Column, patterns: tuple[str, ...], flags: str) -> Column:
    return line.rlike(f"(?{flags})" + "|".join(f"(?:{p})" for p in patterns))


def heading_level(line: Column) -> Column:
    """1 to 4 for a stripped line that is a heading, by the first pattern that fits; else null."""
    out = F.when(line.rlike(f"(?iUu){K.HEADING_PATTERNS[0]}"), 1)
    for i, p in enumerate(K.HEADING_PATTERNS[1:], 1):
        out = out.when(line.rlike(f"(?iUu){p}"), i % 4 + 1)
    return out


def structure(text: Column) -> Column:
    """struct of what lines there are and structure_type: code, hierarchical, tabular, complex or simple."""

    def lines_of(lines: Column) -> Column:
        s = F.transform(lines, strip)
        return let(s, lambda stripped: F.struct(
            F.size(F.filter(stripped, lambda x: _matches(x, K.HEADING_PATTERNS, "iUu"))).alias("headings"),
            F.exists(stripped, lambda x: _matches(x, K.LIST_PATTERNS, "U")).alias("lists"),
            F.exists(lines, lambda x: x.rlike(r"\|[^|]*\|")).alias("tables"),
            F.exists(stripped, lambda x: _matches(x, tuple(f"^{re.escape(c)}" for c in K.CODE_STARTS), "U")).alias("code"),
            F.size(F.filter(stripped, lambda x: F.length(x) > 10)).cast("long").alias("paragraphs"),
        ))

    def of(s: Column) -> Column:
        kind = F.when(s["code"], "code").when(s["headings"] > s["paragraphs"] * 0.2, "hierarchical").when(s["tables"], "tabular").when((F.length(text) > 5000) & (s["paragraphs"] > 10), "complex").otherwise("simple")
        return F.struct(
            (s["headings"] > 0).alias("has_headings"), s["lists"].alias("has_lists"), s["tables"].alias("has_tables"), s["code"].alias("has_code"),
            s["paragraphs"].alias("paragraph_count"), kind.alias("structure_type"), chunk_language(text).alias("language_info"),
        )

    return let(let(F.filter(F.split(text, "\n", -1), lambda x: strip(x) != ""), lines_of), of)


def headings(text: Column) -> Column:
    """array of structs line_number (from 0), level and text, one per heading line."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.cast("int").alias("line_number"), heading_level(strip(x)).alias("level"), strip(x).alias("text")))
    return F.filter(numbered, lambda s: s["level"].isNotNull())


def embedding_input(text: Column, is_query: bool = False, max_tokens: int = 512) -> Column:
    return F.concat(F.lit("query: " if is_query else "passage: "), F.substring(text, 1, 4 * max_tokens))


def sanitize(text: Column, max_length: int | None = None) -> Column:
    t = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")
    return F.substring(t, 1, max_length) if max_length else t


def valid_patient_id(value: Column) -> Column:
    return F.coalesce(strip(value).rlike(r"\A[\p{L}\p{N}]{3,}\z"), F.lit(False))


def size_mb(n_bytes: Column) -> Column:
    """Mebibytes with two digits; ties go to the even digit."""
    return F.bround(n_bytes / 1048576.0, 2)


def preview(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Visible text of a page, by patterns: no scripts, styles, comments and tags; entities of the usual kinds; one blank between parts."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<![^>]*>", "")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def clean_response(text: Column) -> Column:
    """A model's answer as plain text: escapes undone, code blocks and tags dropped, white space collapsed."""
    t = F.coalesce(text, F.lit(""))
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'")):
        t = F.replace(t, F.lit(a), F.lit(b))
    for pattern, to in ((r"```[\s\S]*?```", ""), (r"`([^`]*)`", "$1"), (r"<[^>]+>", ""), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""), (r"(?U)\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


def guarded_response(text: Column, language: Column) -> Column:
    """The cleaned answer, or an apology where under five characters are left."""
    cleaned = clean_response(text)
    return F.when(F.length(strip(cleaned)) < 5, F.when(language == "vi", K.APOLOGY["vi"]).otherwise(K.APOLOGY["en"])).otherwise(cleaned)


def json_array(text: Column) -> Column:
    """The widest [ { ... } ] in a text, or null."""
    found = F.regexp_extract(text, r"(?s)(\[\s*\{.*\}\s*\])", 1)
    return F.when(found != "", found)


def required_json_array(text: Column) -> Column:
    """json_array(); the query fails where there is none."""
    return F.coalesce(json_array(text), F.raise_error(F.lit("no JSON array in the response")))


def template_variables(template: Column) -> Column:
    """The names in {{...}}, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(template, F.lit(r"\{\{([^}]+)\}\}"), 1), strip)))


#: Text to words, as a column: a word segmenter goes here, see segmenter().
Segment = Callable[[Column], Column]


def segmenter(split: Callable[[str], list[str]]) -> Segment:
    """A Python word segmenter as a function of columns; it runs on Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(split(t)) if t is not None else None)

    return run


def bm25_tokens(text: Column, segment: Segment | None = None) -> Column:
    """Lower-case runs of letters, digits and underscores.

    segment: cuts texts with a character beyond ASCII instead; its words in lower case, without blank ones and those of punctuation alone."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    if segment is None:
        return plain
    only = "[" + re.escape(K.PUNCTUATION_TOKENS) + "]"
    own = F.filter(F.transform(segment(text), F.lower), lambda w: (strip(w) != "") & ~w.rlike(rf"\A{only}+\z"))
    return F.when(text.rlike(r"[^\x00-\x80]"), own).otherwise(plain)


def chunk_tokens(text: Column, segment: Segment | None = None, about: Column | None = None) -> Column:
    """Tokens without stop words: Vietnamese ones keep their case, all others are in lower case. segment: cuts Vietnamese texts, else runs of letters do.
    about: the text's chunk_language(), where it is known."""
    cut = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1) if segment is None else F.filter(segment(text), lambda w: strip(w) != "")
    vi = F.filter(cut, lambda w: ~F.lower(w).isin(*K.VI_STOPWORDS))
    en = F.filter(bm25_tokens(text), lambda w: ~w.isin(*K.EN_STOPWORDS))
    return F.when((chunk_language(text) if about is None else about)["language"] == "vietnamese", vi).otherwise(en)


def dictionary_union(json: Column, category: str | None = None) -> Column:
    """The distinct words, sorted, of a dictionary {category: [words]} in JSON: of all categories but "metadata", or of one. What isn't a list is left out."""
    kinds = F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: (k != "metadata") if category is None else (k == category))
    lists = F.transform(F.map_values(kinds), lambda v: F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def dictionary_words(spark: SparkSession, path: str, category: str | None = None) -> list[str]:
    """dictionary_union() of a file, for vietnamese_score(words=..., abbreviations=...); without the file the default list. A dictionary is a setting of some hundred words."""
    try:
        return spark.read.text(path, wholetext=True).select(dictionary_union(F.col("value"), category).alias("w")).head()["w"]
    except AnalysisException:
        return sorted(K.VI_ABBREVIATIONS if category == "abbreviations" else K.VI_WORDS)

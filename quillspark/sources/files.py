"""Documents out of files: text, Markdown, CSV, HTML, DOCX and, with an extractor, PDF. Files are read by Spark, on any file system."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import constants as K
from quillspark.functions import text as T
from quillspark.sources import pdf_text

#: bytes -> (text, attributes) of each page or table.
Extractor = Callable[[bytes], list[tuple[str, dict[str, str]]]]
DOCUMENT = "path string, source_file string, file_extension string, part int, page_content string, attrs map<string,string>, error string"


def decode(data: bytes) -> tuple[str, str]:
    """The text and the first of four encodings that reads it."""
    for encoding in ("utf-8", "utf-8-sig", "cp1252", "iso-8859-1"):
        try:
            return data.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    raise AssertionError("iso-8859-1 reads everything")


def read_text(data: bytes) -> list[tuple[str, dict[str, str]]]:
    text, encoding = decode(data)
    return [(text, {"encoding": encoding})]


def read_csv(data: bytes) -> list[tuple[str, dict[str, str]]]:
    """All rows as one text, cells by tabs; the delimiter is sniffed from the first 1,024 characters, a comma if that fails."""
    text = decode(data)[0]
    try:
        delimiter = csv.Sniffer().sniff(text[:1024]).delimiter
    except csv.Error:
        delimiter = ","
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    return [("\n".join("\t".join(r) for r in rows), {"rows": str(len(rows)), "delimiter": delimiter})]


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str) -> str:
    """Visible text: lines stripped, parted at double blanks, put together by single ones."""
    parser = _Visible()
    parser.feed(html)
    parser.close()
    lines = (line.strip() for line in "".join(parser.parts).splitlines())
    return " ".join(p for p in (x.strip() for line in lines for x in line.split("  ")) if p)


def read_html(data: bytes) -> list[tuple[str, dict[str, str]]]:
    return [(html_text(decode(data)[0]), {})]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(data: bytes) -> list[tuple[str, dict[str, str]]]:
    """Each paragraph that isn't blank, with its style, and each table, cells by tabs and rows by lines."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p" and text_of(e).strip():
            style = e.find(f"{_W}pPr/{_W}pStyle")
            out.append((text_of(e), {"type": "paragraph", "style": style.get(f"{_W}val", "") if style is not None else ""}))
        elif e.tag == f"{_W}tbl":
            rows = ["\t".join(text_of(c) for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
            out.append(("\n".join(rows), {"type": "table"}))
    return out


def pdf_extractor(pages: Extractor, fallback: Extractor | None = None, tables: Callable[[bytes], list[list[list[list[str | None]]]]] | None = None) -> Extractor:
    """An extractor for PDF out of plug-ins: the text of each page that isn't blank; that of another reader where the first fails
    or finds none; and each table (tables gives those of each page, as rows of cells), cells by tabs and rows by lines."""

    def tried(f: Callable, data: bytes) -> list:
        try:
            return f(data) if f is not None else []
        except Exception:  # noqa: BLE001  the next reader is asked
            return []

    def run(data: bytes) -> list[tuple[str, dict[str, str]]]:
        out = []
        for method, f in (("pages", pages), ("fallback", fallback)):
            out = [(t, {"page": str(i), **a, "extraction_method": method}) for i, (t, a) in enumerate(tried(f, data)) if t.strip()]
            if out:
                break
        for page, some in enumerate(tried(tables, data)):
            out += [("\n".join("\t".join(c or "" for c in row) for row in t), {"type": "table", "page": str(page), "table_num": str(n), "extraction_method": "tables"}) for n, t in enumerate(some)]
        return out

    return run


EXTRACTORS: dict[str, Extractor] = {".pdf": pdf_extractor(pdf_text.pages), ".txt": read_text, ".md": read_text, ".csv": read_csv, ".html": read_html, ".htm": read_html, ".docx": read_docx}


def parse(path: str, data: bytes, known: dict[str, Extractor]) -> list[tuple]:
    """DOCUMENT rows of one file: none for an unknown kind, one with `error` for a file that can't be read."""
    name = path.rsplit("/", 1)[-1]
    ext = (re.search(r"\.[^.]+$", name) or [""])[0].lower()
    if ext not in known:
        return []
    try:
        parts = [(t, a) for t, a in known[ext](data) if t.strip()]
        return [(path, name, ext, i, t, a, None) for i, (t, a) in enumerate(parts)]
    except Exception as e:  # noqa: BLE001  any reader's fault concerns its file alone
        return [(path, name, ext, 0, None, {}, f"{type(e).__name__}: {e}")]


def load(spark: SparkSession, paths: str | list[str], extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """DOCUMENT rows of all files: one per text file, page, paragraph or table. A file that can't be read gives a row with `error`, unknown kinds give none.

    extractors: more kinds, or others; a PDF library goes here as {".pdf": f}. sources.raw has the same as a source for spark.read and readStream."""
    known = {**EXTRACTORS, **(extractors or {})}
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for path, content in zip(b["path"], b["content"], strict=True) for r in parse(path, bytes(content), known)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOCUMENT.replace("map<string,string>", "map").split(", ")])

    return found.mapInPandas(run, DOCUMENT)


def documents(loaded: DataFrame, extra: dict[str, object] | None = None) -> DataFrame:
    """Cleaned texts with their metadata, the time and the fields of extra, which win over others of their name; files with errors are left out."""
    rows = T.with_document_metadata(loaded.where("error is null").withColumn("page_content", T.clean(F.col("page_content"))))
    return rows.withColumns({"processing_timestamp": F.current_timestamp(), **{k: F.lit(v) for k, v in (extra or {}).items()}})


def upload_error(name: str = "filename", size: str = "size") -> F.Column:
    """Why a file isn't taken, or null."""
    ext = F.lower(F.regexp_extract(F.col(name), r"\.[^.]+$", 0))
    return F.when(F.coalesce(F.col(name), F.lit("")) == "", "a name is needed").when(~ext.isin(*K.ALLOWED_EXTENSIONS), "unsupported extension").when(F.col(size) > K.MAX_UPLOAD_BYTES, "too large")


def object_key(collection: str = "collection", name: str = "filename", at: str = "uploaded_at") -> F.Column:
    return F.concat(F.col(collection), F.lit("/"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.col(name))


def store(files: DataFrame, root: str) -> DataFrame:
    """Files (collection, filename, content, uploaded_at) as a table parted by collection, each under its object_key; what is told about each."""
    rows = files.withColumns({"storage_path": object_key(), "size": F.octet_length("content"), "file_extension": F.lower(F.regexp_extract("filename", r"\.[^.]+$", 0))})
    rows.write.mode("append").partitionBy("collection").parquet(root)
    return rows.select("storage_path", F.col("uploaded_at").alias("storage_time"), "size", "file_extension")


def stored_file(spark: SparkSession, root: str, collection: str, name: str) -> DataFrame:
    """The rows of a file, the newest first."""
    return spark.read.parquet(root).where((F.col("collection") == collection) & (F.col("filename") == name)).orderBy(F.col("uploaded_at").desc())

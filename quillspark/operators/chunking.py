"""Chunking: simple, hierarchical and semantic, chosen by the structure of a text.

Each strategy folds over the lines or paragraphs of one text, so texts are cut in one Arrow pass over the documents, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.window import Window

from quillspark.functions import constants as K
from quillspark.functions import text as T
from quillspark.shared import small_batches


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in estimated tokens, but min_chunk_size in characters."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    min_chunk_size: int = 50
    max_chunk_size: int = 1024
    keep_small_chunks: bool = True


@dataclass(frozen=True)
class Piece:
    index: int
    level: int | None
    strategy: str
    text: str


_ANY_VI = re.compile(f"[{K.VI_LETTERS}]+", re.I)
_LETTERS = re.compile(f"[a-zA-Z{K.VI_LETTERS}]+")
_LETTER = re.compile("[a-zA-Z]")
_HEADING = re.compile("|".join(f"(?P<h{i}>{p})" for i, p in enumerate(K.HEADING_PATTERNS)), re.I)
_CODE = re.compile("|".join(re.escape(c) for c in K.CODE_STARTS))
_TABLE = re.compile(r"\|[^|]*\|")
_BLANK_LINES = re.compile(r"\n\s*\n")


def estimate(text: str) -> int:
    """As functions.text.estimated_tokens."""
    n = len(text)
    if text.isascii():
        return n // 4 if _LETTER.search(text) else int(n / 3.5)
    letters, marked = n - len(_LETTERS.sub("", text)), n - len(_ANY_VI.sub("", text))
    ratio = marked / letters if letters else None
    return int(n / 3.5) if ratio is None or 0.05 < ratio <= 0.20 else n // 3 if ratio > 0.20 else n // 4


def heading_level(line: str) -> int | None:
    """As functions.text.heading_level, for a stripped line."""
    m = _HEADING.match(line)
    return int(m.lastgroup[1:]) % 4 + 1 if m else None


def structure_type(text: str) -> str:
    """As functions.text.structure: code, hierarchical, tabular, complex or simple."""
    lines = [(x, s) for x in text.split("\n") if (s := x.strip())]
    if any(_CODE.match(s) for _, s in lines):
        return "code"
    paragraphs = sum(len(s) > 10 for _, s in lines)
    if sum(heading_level(s) is not None for _, s in lines) > paragraphs * 0.2:
        return "hierarchical"
    if any(_TABLE.search(x) for x, _ in lines):
        return "tabular"
    return "complex" if len(text) > 5000 and paragraphs > 10 else "simple"


def split_recursively(text: str, config: ChunkConfig, separators: tuple[str, ...] = K.SEPARATORS) -> list[str]:
    """Pieces of at most chunk_size where separators allow: the coarsest separator that occurs cuts first, too long pieces are
    cut by finer ones, and short neighbours are put together again with up to chunk_overlap of what came before."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    if sep:
        cuts = text.split(sep)
        pieces = [p for p in [cuts[0], *(sep + c for c in cuts[1:])] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    short: list[tuple[str, int]] = []
    for p in pieces:
        n = estimate(p)
        if n < config.chunk_size:
            short.append((p, n))
            continue
        out += _joined(short, config)
        short = []
        out += split_recursively(p, config, finer) if finer else [p]
    return out + _joined(short, config)


def _joined(pieces: list[tuple[str, int]], config: ChunkConfig) -> list[str]:
    out, first, total = [], 0, 0
    for i, (_, n) in enumerate(pieces):
        if i > first and total + n > config.chunk_size:
            out.append("".join(p for p, _ in pieces[first:i]).strip())
            # pieces of one or two characters count as no tokens: without overlap they go as well
            while first < i and (total > config.chunk_overlap or total + n > config.chunk_size or not config.chunk_overlap):
                total -= pieces[first][1]
                first += 1
        total += n
    if first < len(pieces):
        out.append("".join(p for p, _ in pieces[first:]).strip())
    return [x for x in out if x]


def simple_pieces(text: str | None, config: ChunkConfig) -> list[str]:
    """split_recursively(), and what is shorter than min_chunk_size is put to the piece before it, or else kept or dropped."""
    out: list[str] = []
    for piece in split_recursively(text, config) if text else []:
        if len(piece) < config.min_chunk_size and out and len(out[-1]) + len(piece) < config.max_chunk_size:
            out[-1] += "\n" + piece
        elif len(piece) >= config.min_chunk_size or config.keep_small_chunks:
            out.append(piece)
    return out


def semantic_pieces(text: str | None, config: ChunkConfig) -> list[str]:
    """Paragraphs packed in order while their tokens fit max_chunk_size; one that is too long stays whole."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in filter(None, (x.strip() for x in _BLANK_LINES.split(text or ""))):
        n = estimate(p)
        if held and total + n > config.max_chunk_size:
            out.append("\n\n".join(held))
            held, total = [], 0
        held.append(p)
        total += n
    return [*out, "\n\n".join(held)] if held else out


def section_pieces(text: str | None) -> list[tuple[int | None, str]]:
    """Level (None before the first heading) and content of each section.

    A section begins at a heading whose level isn't deeper than all before it; blank lines before the first one are dropped."""
    out: list[tuple[int | None, list[str]]] = []
    lowest = None
    for line in (text or "").split("\n"):
        s = line.strip()
        level = heading_level(s) if s else None
        if level is not None and (lowest is None or level <= lowest):
            lowest = level
            out.append((level, [line]))
        elif out:
            out[-1][1].append(line)
        elif s:
            out.append((None, [line]))
    return [(level, "\n".join(lines)) for level, lines in out]


def hierarchical_pieces(text: str | None, config: ChunkConfig) -> list[Piece]:
    """Sections; those over max_chunk_size are cut simply, and their parts share the section's index. A text without headings is cut simply."""
    sections = section_pieces(text)
    if all(level is None for level, _ in sections):
        return _all_simple(text, config)
    out = []
    for i, (level, content) in enumerate(sections):
        if estimate(content) > config.max_chunk_size:
            out += [Piece(i, level, "hierarchical_split", p) for p in simple_pieces(content, config)]
        else:
            out.append(Piece(i, level, "hierarchical", content.strip()))
    return out


def _all_simple(text: str | None, config: ChunkConfig) -> list[Piece]:
    return [Piece(i, None, "simple", p) for i, p in enumerate(simple_pieces(text, config))]


def _all_semantic(text: str | None, config: ChunkConfig) -> list[Piece]:
    return [Piece(i, None, "semantic", p) for i, p in enumerate(semantic_pieces(text, config))]


def pieces(text: str | None, config: ChunkConfig = ChunkConfig()) -> list[Piece]:
    """A text by the strategy for its structure: hierarchical; semantic if complex or tabular; else simple. A blank text gives none."""
    if not text or not text.strip():
        return []
    kind = structure_type(text)
    return (hierarchical_pieces if kind == "hierarchical" else _all_semantic if kind in ("complex", "tabular") else _all_simple)(text, config)


def chunk_text(text: str | None, chunk_size: int = 512, chunk_overlap: int = 64, metadata: dict[str, object] | None = None) -> list[dict[str, object]]:
    """One text's chunks without Spark: page_content and metadata, what is given and what the strategy tells."""
    config = ChunkConfig(chunk_size=chunk_size, chunk_overlap=chunk_overlap)
    about = {**(metadata or {}), "original_length": len(text or ""), "structure_type": structure_type(text or "")}
    return [{"page_content": p.text, "metadata": {**about, "strategy": p.strategy, "chunk_index": p.index, "section_level": p.level, "token_count": estimate(p.text)}} for p in pieces(text, config)]


CHUNK = ["doc_id", "chunk_index", "section_level", "strategy", "original_length", "page_content"]
_FLUSH_CHARS = 4 << 20


def _chunked(docs: DataFrame, cut, *args: object) -> DataFrame:  # cut: text, *args -> pieces
    """CHUNK rows of docs (doc_id, page_content); what is made of a batch leaves in batches of some 4 million characters."""
    small_batches(docs.sparkSession)
    kinds = [ty.IntegerType(), ty.IntegerType(), ty.StringType(), ty.LongType(), ty.StringType()]
    out = ty.StructType([docs.schema["doc_id"], *[ty.StructField(c, k) for c, k in zip(CHUNK[1:], kinds, strict=True)]])

    def batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, *cols = zip(*rows, strict=True)
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, size = b.column("doc_id"), [], 0
            for i, scalar in enumerate(b.column("page_content")):
                text = scalar.as_py() or ""
                rows += [(i, p.index, p.level, p.strategy, len(text), p.text) for p in cut(text, *args)]
                size += len(text)
                if rows and size > _FLUSH_CHARS:
                    yield batch(ids, rows)
                    rows, size = [], 0
            if rows:
                yield batch(ids, rows)

    return docs.select("doc_id", "page_content").mapInArrow(run, out)


def chunk_simple(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    return _chunked(docs, _all_simple, config)


def chunk_semantic(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    return _chunked(docs, _all_semantic, config)


def chunk_hierarchical(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    return _chunked(docs, hierarchical_pieces, config)


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Each text by the strategy for its structure; see pieces()."""
    return _chunked(docs, pieces, config)


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section (from 0), section_level and content; see section_pieces()."""
    rows = _chunked(docs, lambda text: [Piece(i, level, "section", content) for i, (level, content) in enumerate(section_pieces(text))])
    return rows.select("doc_id", F.col("chunk_index").alias("section"), "section_level", F.col("page_content").alias("content"))


def with_metadata(chunks: DataFrame, segment: T.Segment | None = None) -> DataFrame:
    """Chunks with chunk_id, token_count, language_info and bm25_tokens; segment cuts Vietnamese texts into words."""
    c, about = F.col("page_content"), F.col("language_info")
    rows = chunks.select(*CHUNK, T.chunk_language(c).alias("language_info"))  # once for all that need it
    return rows.select(
        F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), c), 256).alias("chunk_id"), *CHUNK,
        T.estimated_tokens(c, about).alias("token_count"), "language_info", T.chunk_tokens(c, segment, about).alias("bm25_tokens"),
    )


def with_document_index(docs: DataFrame, order: str = "doc_id", parts: int = 200) -> DataFrame:
    """docs with document_index: 0, 1, ... by a numeric column, nulls first; rows of equal value in any order.

    The column's percentiles cut the rows into parts that are numbered apart; how many rows come before each part is a table of
    as many rows as there are parts, so no task sees all rows. Rows of one value are in one part."""
    cuts = docs.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10000)).head()[0]
    bounds = F.lit(sorted(set(cuts or []))).cast(ty.ArrayType(docs.schema[order].dataType))
    part = F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b < F.col(order))))
    rows = docs.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return rows.withColumn("_own", own).join(F.broadcast(counts), "_part").select(*docs.columns, (F.col("_before") + F.col("_own") - 1).alias("document_index"))

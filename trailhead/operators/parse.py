"""Parsers: bytes and a media type to normal text with sections; chunkers: text to spans."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing as H
from ..functions import text as X

#: Versions of parsers and chunkers, which are part of hashes.
PARAGRAPHS = "paragraph-v1"
SECTIONS = "markdown-section-v1"
WHITESPACE = "whitespace-v1"

#: Tags that end a line.
BREAKS = {"br", "p", "div", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6"}
_TAG = re.compile(r"<([^>]*)(>|$)")
_SPACES = re.compile(r"[^\S\n]+")


def html_text(page: str, compat: bool = False) -> str:
    """Text of a page: tags gone, breaks at block tags, scripts and styles left out, entities read, spaces joined.

    compat keeps a known fault: all text after the first script or style tag is lost.
    """
    out, at, hidden = [], 0, ""
    for m in _TAG.finditer(page):
        if not hidden:
            out.append(page[at : m.start()])
        at = m.end()
        tag = m[1].strip().lower()
        closing = tag.startswith("/")
        name = re.split(r"[ \t/]", tag[1:] if closing else tag, maxsplit=1)[0]
        if not m[2]:
            break
        if name in ("script", "style"):
            if not closing:
                hidden = name
            elif not compat:
                hidden = ""
        elif name in BREAKS and not closing and not hidden:
            out.append("\n")
    if not hidden:
        out.append(page[at:])
    text = html.unescape("".join(out))
    lines = [_SPACES.sub(" ", line) for line in text.split("\n")]
    return "\n".join(lines[:1] + [x[1:] if x.startswith(" ") else x for x in lines[1:]]).strip()


_STRING = re.compile(rb"\(((?:\\.|[^\\)])*)\)", re.DOTALL)
_SHOWN = re.compile(rb"\(((?:\\.|[^\\)])*)\)\s*Tj", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}


def pdf_text(content: bytes) -> str | None:
    """Strings that a PDF shows, or else all that look like text, joined by spaces; null without the header."""
    if not content.strip().startswith(b"%PDF-"):
        return None
    plain = lambda s: re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), s, flags=re.DOTALL)
    found = [plain(s) for s in _SHOWN.findall(content)]
    if not found:
        found = [s for s in map(plain, _STRING.findall(content)) if len(re.findall(rb"[A-Za-z]", s)) >= 3]
    return b" ".join(found).decode("utf-8", "replace")


@F.arrow_udf(T.StringType())
def _html(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from X.each_text(pages, html_text)


@F.arrow_udf(T.StringType())
def _pdf(files: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from X.each_text(files, pdf_text)


def html_column(page: Column) -> Column:
    return _html(page)


def parse(files: DataFrame, content: str = "content", media: str = "media_type") -> DataFrame:
    """Add text, confidence and low_confidence by media type; plain text where it is unknown."""
    is_html, is_pdf = F.col(media).isin("text/html", "application/xhtml+xml"), F.col(media) == "application/pdf"
    normal = X.for_hashing(F.when(~is_html & ~is_pdf, F.col(content)))
    text = F.when(is_html, X.nfc(_html(F.when(is_html, F.col(content).cast("string"))))).when(is_pdf, X.nfc(_pdf(F.when(is_pdf, F.col(content))))).otherwise(normal)
    out = files.withColumn("text", text)
    sure = F.when(is_pdf, F.when(F.col("text") == "", 0.1).otherwise(0.4)).when(is_html, 0.9).otherwise(1.0)
    return out.withColumns({"confidence": sure, "low_confidence": F.coalesce(is_pdf, F.lit(False))})


def readable(parsed: DataFrame, path: str = "relative_path") -> DataFrame:
    """Parsed files; one without text (bytes that aren't UTF-8, a PDF without its header) stops the job and is named."""
    text = F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("can't read "), F.col(path))))
    return parsed.withColumn("text", text)


def unreadable(parsed: DataFrame, path: str = "relative_path") -> DataFrame:
    """Paths of files without text, to look at them before."""
    return parsed.where("text is null").select(path)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def paragraphs(text: Column) -> Column:
    """Byte spans of paragraphs: parts between empty lines, trimmed of spaces, tabs and line ends; none empty.

    A text of no paragraph, but not empty, is one span.
    """
    parts = F.split(text, "\n\n", -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        lead = F.length(part) - F.length(F.ltrim(part, F.lit("\n \t")))
        body = F.octet_length(F.trim(part, F.lit("\n \t")))
        span = F.struct((acc["at"] + lead).alias("start"), (acc["at"] + lead + body).alias("end"))
        spans = F.when(body > 0, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.octet_length(part) + 2).cast("long").alias("at"), spans.cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    found = F.aggregate(parts, zero, step)["spans"]
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length(text).cast("long").alias("end")))
    return F.transform(F.array(found), lambda s: F.when((F.size(s) == 0) & (text != ""), whole).otherwise(s))[0]



def markdown_sections(text: str) -> list[tuple[int, str, int, int, list[str]]]:
    """Sections in the order in which they close: level, title, start, end (bytes), titles from the outermost on."""
    data, opened, closed, at = text.encode(), [], [], 0
    for line in data.split(b"\n"):
        m = re.match(rb"(#{1,6})(?:[ \t](.*))?$", line.rstrip(b" \t\r"), re.DOTALL)
        title = (m[2] or b"").decode().strip() if m else ""
        if title:
            level = len(m[1])
            while opened and opened[-1][0] >= level:
                closed.append((*opened.pop(), at))
            opened.append((level, title, at, [*(o[1] for o in opened), title]))
        at += len(line) + 1
    closed += [(*o, len(data)) for o in reversed(opened)]
    return [(level, title, start, end, titles) for level, title, start, titles, end in closed]


def section_spans(text: str) -> list[tuple[int, int, list[str]]]:
    """Bodies of the sections of levels 1 and 2, behind their heading line, without spaces and line ends at the end."""
    data, out = text.encode(), {}
    for level, _, start, end, titles in markdown_sections(text):
        line = data.find(b"\n", start)
        body = line + 1 if line >= 0 else start
        if level > 2 or body >= end:
            continue
        stop = body + len(data[body:end].rstrip(b"\n "))
        if stop > body:
            out.setdefault((body, stop), titles)
    return [(a, b, t) for (a, b), t in out.items()]


_SECTION = T.ArrayType(T.StructType([*SPAN.elementType.fields, T.StructField("titles", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_SECTION)
def _sections(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: [{"start": a, "end": b, "titles": h} for a, b, h in section_spans(t)], na_action="ignore")


def chunk(docs: DataFrame, project: str, snapshot: str, path: str = "relative_path", text: str = "text", media: str = "media_type") -> DataFrame:
    """One row for each chunk: scope, chunk_id, chunk_hash, source_id, path_key, chunker, span, titles, text, checksum.

    Markdown goes by section and, where it has none, by paragraph like all else; the media type alone decides.
    """
    titled = F.when(F.col(media) == "text/markdown", _sections(F.when(F.col(media) == "text/markdown", F.col(text))))
    plain = F.transform(paragraphs(F.col(text)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array().cast("array<string>").alias("titles")))
    found = docs.withColumn("_titled", titled)
    found = found.withColumn("_spans", F.when(F.size("_titled") > 0, F.col("_titled")).otherwise(plain))
    found = found.withColumn("chunker", F.when(F.col(media) == "text/markdown", SECTIONS).otherwise(PARAGRAPHS))
    found = found.withColumn("path_key", H.path_key(project, F.col(path)))
    # explode() would put a filter on the spans below, which would compute them again
    each = found.withColumn("_s", F.explode_outer("_spans")).drop("_titled", "_spans").where("_s is not null")
    each = each.withColumn("_text", X.byte_slice(F.col(text), F.col("_s.start"), F.col("_s.end")).cast("string"))
    each = each.withColumn("chunk_hash", H.chunk_hash(F.col("chunker"), F.col("path_key"), F.col("_s.start"), F.col("_s.end"), F.col("_text")))
    kept = [c for c in docs.columns if c not in (text, "project_id", "snapshot_id")]
    return each.select(
        F.lit(project).alias("project_id"),
        F.lit(snapshot).alias("snapshot_id"),
        H.chunk_id(project, F.col("chunk_hash")).alias("chunk_id"),
        "chunk_hash",
        H.source_id(F.col("path_key")).alias("source_id"),
        "path_key",
        "chunker",
        F.col("_s.start").alias("span_start"),
        F.col("_s.end").alias("span_end"),
        F.col("_s.titles").alias("titles"),
        F.col("_text").alias("text"),
        H.sha256(F.col("_text")).alias("text_checksum"),
        *kept,
    )


#: What \s is to Spark's regular expressions.
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\x0b\f\r")] = True


def _token_batch(batch: pa.RecordBatch, kept: int) -> pa.RecordBatch:
    """The words of a batch (chunk_id, span_start, text, kept columns), by one look at all its bytes."""
    texts = batch.column(2).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~_WHITE[data]
    # a word begins behind white space or where its text does
    opens, ends = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges], ends[edges - 1] = word[edges], word[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    number = np.arange(len(row)) - np.searchsorted(row, row)
    at = pc.add(batch.column(1).cast(pa.int64()).take(pa.array(row)), pa.array(start - offsets[row]))
    surface = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(np.append(0, np.cumsum(end - start))), pa.py_buffer(data[word])).cast(pa.string())
    chunk = batch.column(0).take(pa.array(row))
    token = pc.binary_join_element_wise(chunk, pa.array(number).cast(pa.string()), ":")
    more = [batch.column(3 + i).take(pa.array(row)) for i in range(kept)]
    return pa.RecordBatch.from_arrays([chunk, token, surface, at, pc.add(at, pa.array(end - start)), *more], names=[str(i) for i in range(5 + kept)])


def index_tokens(chunks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Tokens between white space, with absolute byte spans: chunk_id, token_id (chunk:number), surface, start, end, columns to keep.

    A row's words are found within its task; rows of one chunk id are chunks of their own.
    """
    given = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "span_start", "text", *keep).where("text is not null")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    names = ["chunk_id", "token_id", "surface", "start", "end", *keep]
    shape = ", ".join(f"`{n}` {k}" for n, k in zip(names, ["string", "string", "string", "bigint", "bigint", *(kinds[c] for c in keep)]))
    many = len(keep)

    def run(batches):
        for batch in batches:
            rows = max(1, batch.num_rows * X.PORTION_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                yield _token_batch(batch.slice(at, rows), many).rename_columns(names)

    return given.mapInArrow(run, shape)

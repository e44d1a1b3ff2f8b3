"""Text functions: normalisation, tokens with byte spans, snippets, redaction and small checks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the query language: letters, decimal digits, hyphen, underscore.
WORD = r"[\p{L}\p{Nd}_-]+"
SEGMENT = r"[\p{L}\p{Nd}_-]+|[^\p{L}\p{Nd}_-]+"


#: Bytes that Python has as objects at a time; a batch may be far larger.
PORTION_BYTES = 2 << 20


def each_text(batches: Iterator[pa.Array], fn: Callable[[object], str | None]) -> Iterator[pa.Array]:
    """fn of every value, nulls but for nulls; of a batch a portion at a time."""
    for a in batches:
        rows = max(1, len(a) * PORTION_BYTES // max(1, a.nbytes))
        some = (a.slice(at, rows).to_pylist() for at in range(0, len(a), rows))
        yield pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if x is None else fn(x) for x in xs], pa.string()) for xs in some)])


@F.arrow_udf(T.StringType())
def _nfc(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from each_text(parts, lambda x: unicodedata.normalize("NFC", x))


#: Characters that are composed already and take no part in compositions. One range, as every character of every text is tried.
COMPOSED = r"\x00-\x{2FF}"


def nfc(text: Column) -> Column:
    """Canonical composition. Only text with other characters than COMPOSED leaves the JVM."""
    # ASCII is told by its length, without looking at every character
    composed = (F.octet_length(text) == F.length(text)) | ~text.rlike(f"[^{COMPOSED}]")
    return F.when(composed, text).otherwise(_nfc(F.when(~composed, text)))


def for_hashing(content: Column) -> Column:
    """Text of UTF-8 bytes: without byte order mark, line ends as \\n, composed; null where the bytes aren't UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    text = F.when(text.startswith("\ufeff"), F.substring(text, 2, (1 << 31) - 1)).otherwise(text)
    return nfc(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def relative_path(path: Column) -> Column:
    """Forward slashes, without leading ./ and /."""
    return F.regexp_replace(F.replace(nfc(path), F.lit("\\"), F.lit("/")), r"^(?:\./|/)+", "")


def media_type(path: Column) -> Column:
    """Media type by suffix; null for files that aren't documents."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"\.(md|markdown)$"), "text/markdown")
        .when(low.rlike(r"\.(txt|text)$"), "text/plain")
        .when(low.rlike(r"\.html?$"), "text/html")
        .when(low.endswith(".pdf"), "application/pdf")
        .when(low.rlike(r"\.(ndjson|jsonl)$"), "application/x-ndjson")
    )


def tokens(text: Column) -> Column:
    """Query tokens in order, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda t: F.lower(t))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def nth_token_span(text: Column, n: Column, length: int | Column = 1) -> Column:
    """Byte span struct<start, end> of tokens n to n + length - 1 (from 0)."""
    segments = F.regexp_extract_all(text, F.lit(f"({SEGMENT})"), F.lit(1))

    def span(s: Column) -> Column:
        lead = F.when(s[0].rlike(f"^{WORD}$"), 0).otherwise(1)
        at = lead + 2 * n
        many = 2 * (F.lit(length) if isinstance(length, int) else length) - 1
        size = lambda part: F.octet_length(F.array_join(part, ""))
        start = size(F.slice(s, F.lit(1), at))
        return F.struct(start.cast("long").alias("start"), (start + size(F.slice(s, at + 1, many))).cast("long").alias("end"))

    return F.transform(F.array(segments), span)[0]


def byte_position(text: Column, phrase: Column | str) -> Column:
    """First byte of a phrase in a text, from 0; -1 where it isn't."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    at = F.position(p, text)
    before = F.substring(text, F.lit(1), at - 1)
    return F.when(at > 0, F.octet_length(before)).otherwise(-1).cast("long")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes of a text from start to end; they may cut a character."""
    return F.substring(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int"))


def snippet_span(text: Column, start: Column, end: Column, before: int = 40, after: int = 40) -> Column:
    """The window around a match in bytes: struct<start, end>."""
    before, after = before if before > 0 else 40, after if after > 0 else 40
    return F.struct(F.greatest(start - before, F.lit(0)).cast("long").alias("start"), F.least(end + after, F.octet_length(text)).cast("long").alias("end"))


#: What is redacted, in this order; the part that stays is the first groups, the rest becomes the mark.
REDACTED = "[REDACTED]"
REDACTIONS = [
    (r"(?i)(?<![A-Za-z0-9_])(bearer\s+)([a-z0-9._\-+=/]{8,})", "$1"),
    (r"(?i)(api[_-]?key|access[_-]?token|secret[_-]?key|auth[_-]?token)(\s*[=:]\s*)([^\s\"'\\]{8,})", "$1$2"),
    (r"(?i)(^|[^A-Za-z0-9_])(password|passwd|token|secret)(\s*[=:]\s*)([^\s\"'\\]{4,})", "$1$2$3"),
    (r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])", ""),
]


def redact(text: Column) -> Column:
    """struct<text, count>: the text after all four passes, and how many places were replaced."""
    state = F.struct(text.alias("text"), F.lit(0).alias("count"))
    for pattern, kept in REDACTIONS:
        state = F.transform(F.array(state), _pass(pattern, kept + REDACTED))[0]
    return state


def _pass(pattern: str, replacement: str):
    return lambda s: F.struct(
        F.regexp_replace(s["text"], pattern, replacement).alias("text"),
        (s["count"] + F.regexp_count(s["text"], F.lit(pattern))).alias("count"),
    )


def truncate(text: Column, most: int = 240) -> Column:
    """At most so many characters, with an ellipsis where some are cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


#: Phrases that try to give orders to whoever reads the text.
INJECTIONS = ["ignore all prior", "grant tool", "decisionallow", "approve all tools", "new policy:"]


def injected(text: Column) -> Column:
    """Whether a text, in any case, holds one of the phrases."""
    low = F.lower(text)
    out = F.lit(False)
    for needle in INJECTIONS:
        out = out | low.contains(needle)
    return out


def safe_id(text: Column) -> Column:
    """Letters, digits, hyphen and underscore; each other byte becomes an underscore."""
    return F.regexp_replace(F.decode(text.cast("binary"), "ISO-8859-1"), r"[^A-Za-z0-9_-]", "_")


def rune_span(text: Column, start: Column, end: Column) -> Column:
    """A byte span as a span of characters."""
    count = lambda n: F.length(F.substring(text.cast("binary"), F.lit(1), n.cast("int")).cast("string")).cast("long")
    return F.struct(count(start).alias("start"), count(end).alias("end"))

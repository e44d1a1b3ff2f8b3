"""Files as tables: documents by suffix, event lines, ignore patterns."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests as D
from ..functions import hashing as H
from ..functions import text as X

#: Folders that are never read.
IGNORED = [".git/", ".trailhead/", "vendor/", "node_modules/", "dist/", "build/", "target/", "bin/"]
DOCUMENTS = ["text/markdown", "text/plain", "text/html", "application/pdf"]

EVENT = "event_id string, occurred_start timestamp, occurred_end timestamp, ingested_at timestamp, message string, trust string"


def _glob(pattern: str) -> str:
    """A file pattern (*, ?, [...]) as a regular expression of one path part or more; * and ? stay within a part."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def ignore_patterns(lines: list[str] = (), extra: list[str] = ()) -> list[str]:
    """Default, file and extra patterns in order, without comments, empty lines and repeats."""
    found = [p.strip() for p in [*IGNORED, *lines, *extra]]
    return list(dict.fromkeys(p for p in found if p and not p.startswith("#")))


def ignore_regex(patterns: list[str]) -> str:
    """One regular expression that a relative path matches if any pattern ignores it.

    A pattern ignores its own path and all under it; one without a slash also ignores any part of that name; one that
    ends in a slash holds for folders only.
    """
    parts = []
    for p in patterns:
        p = p.replace("\\", "/")
        folder = p.endswith("/")
        p = p.removesuffix("/")
        exact = re.escape(p)
        if "/" in p:
            parts += [f"^{exact}(/|$)", *([] if folder else [f"^{_glob(p)}$"])]
        else:
            parts.append(f"(^|/){_glob(p)}/" if folder else f"(^|/){_glob(p)}(/|$)")
            if folder:
                parts.append(f"^{exact}$")
    return "|".join(f"(?:{p})" for p in parts) or "(?!)"


def clean_path(path: str) -> str:
    return posixpath.normpath("/" + path.replace("\\", "/")).lstrip("/")


def documents(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """Document files under a root: relative_path, content, media_type, source_type, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^\w+:/*", "/", root.rstrip("/"))
    path = F.regexp_replace(F.col("path"), rf"^\w+:/*{re.escape(base.lstrip('/'))}/", "")
    named = files.select(X.relative_path(path).alias("relative_path"), "content", F.length("content").alias("length"))
    named = named.withColumn("media_type", X.media_type(F.col("relative_path"))).where(F.col("media_type").isin(DOCUMENTS))
    kept = named.where(~F.col("relative_path").rlike(ignore_regex(ignore_patterns() if patterns is None else patterns)))
    return kept.withColumn("source_type", F.lit("file"))


def event_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events of NDJSON lines, blank ones skipped: the event's fields and payload_checksum of the trimmed line.

    A line without an event_id stops the job; one event may come in several lines (see identities()).
    """
    line = F.trim(F.col(value), F.lit(" \t\r\n"))
    read = lines.select(line.alias("line")).where("line <> ''").select("line", F.from_json("line", EVENT).alias("e"))
    known = F.when(F.coalesce("e.event_id", F.lit("")) == "", F.raise_error(F.lit("a line has no event_id"))).otherwise(F.col("e.event_id"))
    return read.select(known.alias("event_id"), "e.occurred_start", "e.occurred_end", "e.ingested_at", "e.message", "e.trust", H.sha256(F.col("line")).alias("payload_checksum"))


def events(spark: SparkSession, root: str) -> DataFrame:
    """Events of all .ndjson and .jsonl files under a root."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ndjson,jsonl}").text(root)
    return event_lines(text)


def event_stream(spark: SparkSession, root: str) -> DataFrame:
    """The same as a stream of files as they come."""
    return event_lines(spark.readStream.format("text").load(root))


def identities(found: DataFrame, event_id: str = "event_id", checksum: str = "payload_checksum") -> DataFrame:
    """One row for each event id; two payloads of one id stop the job."""
    each = found.groupBy(F.col(event_id).alias("id")).agg(F.min(checksum).alias("checksum"), F.max(checksum).alias("other"))
    same = F.when(F.col("checksum") == F.col("other"), F.col("checksum")).otherwise(F.raise_error(F.concat(F.lit("conflicting payload of event "), F.col("id"))))
    return each.select("id", same.alias("checksum"))


def _identity_line() -> Column:
    return F.concat(F.lit("\0"), "id", F.lit("\0"), "checksum")


def _identity_tree(ids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return D.leaves(ids, by, H.sha256(F.col("id")), ["id", "checksum"], _identity_line())


def batch_checksum(ids: DataFrame) -> DataFrame:
    """The checksum of a batch of identities, whatever their order; an empty batch has none."""
    found = D.root(_identity_tree(ids), [], F.lit(H.EVENT_BATCH + "\0"), "checksum")
    return found.where("n > 0").withColumnRenamed("n", "n_events")


def window_checksum(ids: DataFrame, start: Column, end: Column, basis: str = "occurred", by: tuple[str, ...] = ()) -> DataFrame:
    """The checksum of the identities of a window."""
    fields = (F.concat(F.lit("\0"), x) for x in (H.utc_text(start), H.utc_text(end), F.lit(basis)))
    found = D.root(_identity_tree(ids, by), by, F.concat(F.lit(H.EVENT_WINDOW), *fields, F.lit("\0")), "checksum")
    return found.where("n > 0").withColumnRenamed("n", "n_events")

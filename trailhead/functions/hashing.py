"""Content addresses as column expressions: NUL-joined labels and fields under SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label that begins each kind of hash.
SOURCE_LEAF = "trailhead/source-leaf/v1"
SOURCE_ROOT = "trailhead/source-root/v2"
CHUNK = "trailhead/chunk/v1"
CHUNK_SET = "trailhead/chunk-set/v2"
EVENT_BATCH = "trailhead/event-batch/v2"
EVENT_WINDOW = "trailhead/event-window/v2"


def _bytes(x: Column | str) -> Column:
    return (F.lit(x) if isinstance(x, str) else x).cast("binary")


def _zero() -> Column:
    return F.unhex(F.lit("00"))


def nul_joined(*parts: Column | str) -> Column:
    """The parts as bytes with a NUL between each two."""
    out = []
    for p in parts:
        out += [_zero(), _bytes(p)] if out else [_bytes(p)]
    return F.concat(*out)


def u64(n: Column) -> Column:
    """Eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def path_key(project: Column | str, relative: Column) -> Column:
    return sha256(nul_joined(project, relative))


def source_leaf(key: Column, source_type: Column | str, content: Column) -> Column:
    return sha256(nul_joined(SOURCE_LEAF, key, source_type, sha256(content.cast("binary"))))


def chunk_hash(chunker: Column | str, key: Column, start: Column, end: Column, text: Column) -> Column:
    return sha256(F.concat(nul_joined(CHUNK, chunker, key, u64(start)), u64(end), _zero(), F.unhex(sha256(text))))


def chunk_id(project: Column | str, digest: Column) -> Column:
    return F.concat(F.lit("chk_"), F.lit(project) if isinstance(project, str) else project, F.lit("_"), F.substring(digest, 1, 16))


def source_id(key: Column) -> Column:
    return F.substring(key, 1, 16)


def utc_text(ts: Column) -> Column:
    """RFC 3339 in UTC with as many decimals as the value has; the session time zone is UTC."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    decimals = F.regexp_replace(F.date_format(ts, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(whole, decimals, F.lit("Z"))

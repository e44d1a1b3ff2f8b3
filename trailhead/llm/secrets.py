"""Secret scan with corpus-wide ownership frequencies.

Each text is scanned for three plain kinds (assign, access, hex) and for any longer run of key-like characters with
high entropy (keylike). The values found are hashed; over the whole corpus each hash gets the number of distinct
repositories and of distinct owners that hold it. A value that many owners hold is a widely copied example; one that
few owners hold and that looks random is live-looking. The method adds a keylike span only where its value is
live-looking and no plain span covers it; plain spans stay whatever their frequency and carry it.

Defined results: null text counts as empty; a null repository or owner counts as one of its own; repeated rows give
repeated rows, and count once as repository and owner; an empty table gives no rows; further columns are ignored.
Offsets are code points, end exclusive. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ["assign", "access", "hex", "keylike"]
BASE = KINDS[:3]

#: The patterns of the plain kinds and the least lengths of what they find.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24, "keylike": 20}
WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]

HOT_VALUES = 10_000

LONG_HEX = re.compile(r"[0-9a-f]{24,}")
LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
KEYLIKE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
PLACEHOLDER = re.compile(r"example|sample|test|dummy|changeme|placeholder|your|xxxx|0000|1234", re.IGNORECASE)


def entropy(value: str) -> float:
    """Bits per character of a value's own distribution of characters."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def looks_random(value: str) -> bool:
    """Letters and digits mixed, no placeholder word, and at least 3 bits per character."""
    return (
        any(c.isdigit() for c in value)
        and any(c.isalpha() for c in value)
        and not PLACEHOLDER.search(value)
        and entropy(value) >= 3.0
    )


def _reach(spans):
    """(start, furthest end so far) of spans, in order of start."""
    end = 0
    for s, e in sorted(spans):
        end = max(end, e)
        yield s, end


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(kind, start, end, value) of all spans in order of start, then kind; kind as an index of KINDS."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                found.append((0, m.start(), m.end(), m[2]))
    if max(map(len, text.split()), default=0) >= 20:
        found += [(1, m.start(), m.end(), m[0]) for m in LONG_ACCESS.finditer(text)]
        found += [(2, m.start(), m.end(), m[0]) for m in LONG_HEX.finditer(text)]
        starts, furthest = zip(*_reach((s, e) for _, s, e, _ in found)) if found else ((), ())
        for m in KEYLIKE.finditer(text):
            before = bisect_left(starts, m.end())
            if not before or furthest[before - 1] <= m.start():
                found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda x: (x[1], x[0]))


SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("value_sha256", T.StringType()),
        T.StructField("random", T.BooleanType()),
    ]
)
ARROW_SPAN = pa.list_(
    pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value_sha256", pa.string()), ("random", pa.bool_())])
)


def _find():
    def fn(column: pa.Array):
        rows = []
        for text in common.strings(column):
            rows.append(
                [
                    {"start": s, "kind": k, "end": e, "value_sha256": hashlib.sha256(v.encode()).hexdigest(), "random": looks_random(v)}
                    for k, s, e, v in candidates(text)
                ]
            )
        return [pa.array(rows, ARROW_SPAN)]

    return fn


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each value, and its occurrences: value_sha256, n_repos, n_owners, n.

    Counted in three steps, so that no step gathers the rows of a value that a large part of the corpus holds.
    """
    places = found.groupBy("value_sha256", "owner", "repo").agg(F.count("*").alias("n"))
    owners = places.groupBy("value_sha256", "owner").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n"))
    return owners.groupBy("value_sha256").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n"))


def with_ownership(found: DataFrame) -> DataFrame:
    """found with n_repos and n_owners of its values.

    Values that hold more than one of HOT_VALUES parts of all occurrences (so at most HOT_VALUES of them) are
    broadcast, and their occurrences don't move; the others are joined, none of which is a hot key.
    """
    known = common.materialize(ownership(found), "ownership")
    total = known.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") > max(1000, total // HOT_VALUES)
    hot = F.broadcast(known.where(many).select("value_sha256", F.struct("n_repos", "n_owners").alias("hot")))
    both = found.join(hot, "value_sha256", "left")
    at_hand = both.where("hot is not null").select(*found.columns, "hot.n_repos", "hot.n_owners")
    rest = both.where("hot is null").drop("hot").join(known.where(~many).select("value_sha256", "n_repos", "n_owners"), "value_sha256")
    return at_hand.unionByName(rest)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", max_owners: int = 2) -> DataFrame:
    """One row per input row: doc_id and spans, an array of structs in order of start, then kind.

    A span has start, kind (its name), end, value_sha256, n_repos, n_owners and live: its value looks random and no
    more than max_owners owners hold it. Of keylike spans only live ones are returned.
    """
    picked = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text")
    )
    rows = common.with_columns(picked, ["text"], [T.StructField("found", T.ArrayType(SPAN))], _find, ["doc_id", "repo", "owner"])
    rows = common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    none = F.array().cast("array<struct<start:int,kind:string,end:int,value_sha256:string,n_repos:bigint,n_owners:bigint,live:boolean>>")
    each = rows.where(F.size("found") > 0).select("row", "doc_id", "repo", "owner", F.explode("found").alias("s"))
    each = each.select("row", "doc_id", "repo", "owner", "s.*")
    known = with_ownership(each)
    live = F.col("random") & (F.col("n_owners") <= max_owners)
    names = F.array(*map(F.lit, KINDS))
    span = F.struct("start", "kind", "end", "value_sha256", "n_repos", "n_owners", live.alias("live"))
    kept = known.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("all"))
    kept = kept.select(
        "doc_id",
        F.transform(
            F.filter("all", lambda s: (s["kind"] < len(BASE)) | s["live"]),
            lambda s: F.struct(
                s["start"].alias("start"), names[s["kind"]].alias("kind"), s["end"].alias("end"), s["value_sha256"].alias("value_sha256"),
                s["n_repos"].alias("n_repos"), s["n_owners"].alias("n_owners"), s["live"].alias("live"),
            ),
        ).alias("spans"),
    )
    return rows.where(F.size("found") == 0).select("doc_id", none.alias("spans")).unionByName(kept)


def _line(some: Column) -> Column:
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(spans: str = "spans") -> list[Column]:
    """n_assign, n_access, n_hex, base_sha256 and spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(BASE))
    return [*map(count, BASE), F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col(spans)).alias("spans")]


def findings(spans: str = "spans") -> list[Column]:
    """What the corpus says: live spans as text, and how many repositories and owners hold the value that most hold."""
    live = F.filter(spans, lambda s: s["live"])
    most = lambda name: F.coalesce(F.array_max(F.transform(spans, lambda s: s[name])), F.lit(0)).cast("long")
    return [_line(live).alias("live"), most("n_repos").alias("most_repos"), most("n_owners").alias("most_owners")]

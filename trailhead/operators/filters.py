"""Filters over chunks: scope, tombstones, metadata, time, trust."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema


@dataclass(frozen=True)
class Window:
    """A half-open range of time on one basis."""

    start: datetime
    end: datetime
    basis: str = "occurred"

    def __post_init__(self):
        if not self.start < self.end:
            raise ValueError("a window starts before it ends")
        if self.basis not in schema.BASES and not self.basis.startswith("adapter:"):
            raise ValueError(f"unknown basis {self.basis}")


@dataclass(frozen=True)
class Filters:
    """Empty fields filter nothing; a graph node is taken and ignored."""

    sense_id: str = ""
    concept_id: str = ""
    attestation_id: str = ""
    register: str = ""
    region: str = ""
    time_period: str = ""
    lexicon_source_id: str = ""
    source_authority: str = ""
    language: str = ""
    window: Window | None = None
    graph_node_id: str = ""

    def reasons(self) -> list[str]:
        """Codes that say which identity filters held."""
        return [f"{k}_filter" for k in ("sense", "concept", "attestation") if getattr(self, f"{k}_id")]


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Half-open ranges that share an instant."""
    return (start < other_end) & (other_start < end)


def in_window(temporal: Column, window: Window) -> Column:
    """Valid ranges of the same basis that overlap; no range is no match."""
    valid = temporal.isNotNull() & (temporal["start"] < temporal["end"]) & (temporal["basis"] == window.basis)
    return F.coalesce(valid & overlaps(temporal["start"], temporal["end"], F.lit(window.start), F.lit(window.end)), F.lit(False))


def condition(f: Filters) -> Column:
    out = F.lit(True)
    for name in ("sense", "concept", "attestation"):
        if value := getattr(f, f"{name}_id"):
            out = out & F.coalesce(F.array_contains(F.col(f"{name}_ids"), value), F.lit(False))
    for name in ("register", "region", "time_period", "lexicon_source_id", "source_authority", "language"):
        if value := getattr(f, name):
            out = out & (F.col(name) == value)
    if f.window:
        out = out & in_window(F.col("temporal"), f.window)
    return out


def scope(chunks: DataFrame, project: str, snapshot: str) -> DataFrame:
    """The visible chunks of one snapshot."""
    return chunks.where((F.col("project_id") == project) & (F.col("snapshot_id") == snapshot) & ~F.coalesce("tombstoned", F.lit(False)))


def without_tombstones(chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Chunks whose source isn't among the tombstoned ones."""
    return chunks.join(tombstones.select("source_id"), "source_id", "left_anti")


def trusted(level: Column, required: str) -> Column:
    """At least the required level, and never quarantined."""
    return (schema.trust_rank(level) >= schema.TRUST_RANK.get(required, -1)) & (level != "quarantined")


def _cells(start: Column, end: Column, cell_s: int) -> tuple[Column, Column]:
    """Cells of time that a range touches: the first, and the one behind the last."""
    size = cell_s * 1_000_000
    return F.floor(F.unix_micros(start) / size), F.floor((F.unix_micros(end) - 1) / size) + 1


def dyadic_cover(first: Column, behind: Column) -> Column:
    """Cells from first to before behind as array<struct<level, node>>: fewest runs of 2^level cells, at most two a level.

    Node n of a level is the run of cells from n * 2^level on. The runs of a range have no cell in common.
    """

    def of_level(level: Column) -> Column:
        two = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))
        # runs of this size that lie within; those that a run of twice the size doesn't hold
        low, high = F.ceil(first / two), F.floor(behind / two)
        node = lambda n: F.struct(level.cast("int").alias("level"), n.cast("long").alias("node"))
        return F.array(F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), node(low)), F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), node(high - 1)))

    levels = F.sequence(F.lit(0), F.ceil(F.log2((behind - first).cast("double"))).cast("int"))
    return F.array_compact(F.flatten(F.transform(levels, of_level)))


def overlap_join(left: DataFrame, right: DataFrame, cell_s: int = 60) -> DataFrame:
    """Pairs of ranges (start, end) that overlap: an equi-join of points with the dyadic runs that ranges are cut into.

    Two ranges overlap if the left one's start lies in the right one, or else the right one's start in the left one
    behind its own. A range is cut into runs of cells, at most two for each power of two up to its length, which have
    no cell in common, and a point is in one run of each power: the pair meets in one place or not at all. A range is
    log2(length) rows at most as a point (only powers that the other side has are asked for) and twice that as
    runs, however long it is. Null and empty ranges overlap nothing; ranges within a cell are told apart exactly.
    """

    def sides(df: DataFrame, side: str) -> DataFrame:
        renamed = df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)).where(f"{side}_start < {side}_end")
        first, behind = _cells(F.col(f"{side}_start"), F.col(f"{side}_end"), cell_s)
        return renamed.withColumns({"_first": first, "_behind": behind})

    def levels(df: DataFrame) -> list[int]:
        # a number for each power of two
        found = df.select(F.explode(dyadic_cover(F.col("_first"), F.col("_behind"))).alias("x")).agg(F.collect_set("x.level")).first()[0]
        return sorted(found)

    def keyed(df: DataFrame, asked: list[int], point: int) -> DataFrame:
        """A row for each place that a range can meet others in, as a point of the one kind and as runs of the other."""
        at = [F.struct(F.lit(point).alias("kind"), F.lit(k).alias("level"), F.call_function("shiftright", F.col("_first").cast("long"), F.lit(k)).alias("node")) for k in asked]
        runs = F.transform(dyadic_cover(F.col("_first"), F.col("_behind")), lambda x: F.struct(F.lit(1 - point).alias("kind"), x["level"].alias("level"), x["node"].alias("node")))
        return df.withColumn("_at", F.explode(F.concat(F.array(*at), runs) if at else runs)).select("*", "_at.kind", "_at.level", "_at.node").drop("_at", "_first", "_behind")

    a, b = sides(left, "l"), sides(right, "r")
    both = keyed(a, levels(b), 0).join(keyed(b, levels(a), 1), ["kind", "level", "node"])
    starts_within = F.when(F.col("kind") == 0, (F.col("r_start") <= F.col("l_start")) & (F.col("l_start") < F.col("r_end"))).otherwise((F.col("l_start") < F.col("r_start")) & (F.col("r_start") < F.col("l_end")))
    return both.where(starts_within).drop("kind", "level", "node")

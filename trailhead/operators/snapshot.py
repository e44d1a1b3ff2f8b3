"""Manifests and their differences; snapshot states, lifecycle phases, quotas and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests as D
from ..functions import hashing as H


def source_leaves(files: DataFrame, project: str, path: str = "relative_path", source_type: str = "source_type", content: str = "content") -> DataFrame:
    """path_key and leaf of each file."""
    key = H.path_key(project, F.col(path))
    return files.select(key.alias("path_key"), H.source_leaf(key, F.col(source_type), F.col(content)).alias("leaf"))


def source_tree(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The tree over a manifest: prefix of path keys, digest, n; its rows are few, whatever the number of leaves."""
    line = F.concat("path_key", F.lit("\0"), "leaf", F.lit("\0"))
    return D.leaves(leaves, by, F.col("path_key"), ["path_key", "leaf"], line)


def source_root(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The root of the tree over a manifest's leaves."""
    return tree_root(source_tree(leaves, by), by)


def tree_root(tree: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return D.root(tree, by, F.lit(H.SOURCE_ROOT + "\0"), "source_root").drop("n")


def chunk_set(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The root of the tree over a multiset of chunk hashes."""
    line = F.concat("chunk_hash", F.lit("\0"))
    tree = D.leaves(chunks, by, F.col("chunk_hash"), ["chunk_hash"], line)
    return D.root(tree, by, F.lit(H.CHUNK_SET + "\0"), "chunk_set_hash").drop("n")


def tree_changes(before: DataFrame, after: DataFrame, before_tree: DataFrame, after_tree: DataFrame) -> DataFrame:
    """path_key and status (added, removed or changed) of two manifests, given their trees.

    Only leaves under prefixes whose digests differ are read: none of equal manifests.
    """
    prefixes = D.differing(before_tree, after_tree)
    old, new = (x.where(D.under(F.col("path_key"), prefixes)) for x in (before, after))
    return diff_sources(old, new).where("status <> 'unchanged'")


def diff_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """path_key and status added, removed, changed or unchanged."""
    both = before.select("path_key", F.col("leaf").alias("old")).join(after.select("path_key", F.col("leaf").alias("new")), "path_key", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return both.select("path_key", status.alias("status"))


def diff_chunks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct chunk_hash and status added, removed or unchanged."""
    old = before.select("chunk_hash").distinct().withColumn("old", F.lit(True))
    new = after.select("chunk_hash").distinct().withColumn("new", F.lit(True))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("unchanged")
    return old.join(new, "chunk_hash", "full_outer").select("chunk_hash", status.alias("status"))


def to_process(diff: DataFrame) -> DataFrame:
    """Keys of sources that are new or changed."""
    return diff.where(F.col("status").isin("added", "changed")).select("path_key")


def counters(chunks: DataFrame, source: str = "source_id", **more: Column) -> DataFrame:
    """One row: chunks, sources, chars, and how many chunks each further condition holds for."""
    each = [F.count_if(c).alias(name) for name, c in more.items()]
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct(source).alias("sources"), F.sum(F.length("text")).alias("chars"), *each)


def lifecycle(status: Column, chunks: Column, tombstoned: Column, last_failed: Column, rebuilding: Column, active: Column) -> Column:
    """struct<phase, search_available, reasons> of a project's index."""
    empty = F.coalesce(active, F.lit("")).isin("") | (chunks == 0)
    ready = F.coalesce(status == "ready", F.lit(False))
    degraded = last_failed | (tombstoned > 0)
    phase = F.when(empty, "empty").when(~ready, "failed").when(rebuilding, "rebuilding").when(degraded, "degraded").otherwise("ready")
    usable = ~empty & ready
    code = lambda when, text: F.when(when, F.lit(text))
    reasons = F.array_compact(
        F.array(
            code(rebuilding, "rebuild_in_progress"),
            code(empty, "no_snapshot"),
            code(~empty & ~ready, "snapshot_not_ready"),
            code(usable & last_failed, "last_failed_retained"),
            code(usable & (tombstoned > 0), "tombstoned_sources_present"),
            F.when(usable, "search_available").otherwise("search_unavailable"),
        )
    )
    return F.struct(phase.alias("phase"), usable.alias("search_available"), reasons.alias("reasons"))


def quota(used: Column, limit: Column, soft_percent: int = 80) -> Column:
    """deny at the limit, ask from the soft share of it on, else allow; no limit allows."""
    soft = min(soft_percent, 100) if soft_percent > 0 else 80
    ask = F.greatest(F.floor(limit * soft / 100), F.lit(1))
    return F.when(limit <= 0, "allow").when(used >= limit, "deny").when(used >= ask, "ask").otherwise("allow")


def decide(decisions: Column) -> Column:
    """The strictest of an array of decisions."""
    return F.when(F.array_contains(decisions, "deny"), "deny").when(F.array_contains(decisions, "ask"), "ask").otherwise("allow")


MOVES = {"building": {"ready", "failed"}, "ready": {"superseded"}, "failed": set(), "superseded": set()}


def move(status: str, to: str, *, roots: bool = True, reason: str = "") -> str:
    """A snapshot's next state; ready needs its roots, failed a reason."""
    if to not in MOVES.get(status, ()):
        raise ValueError(f"a {status} snapshot can't become {to}")
    if to == "ready" and not roots:
        raise ValueError("a ready snapshot needs its roots and versions")
    if to == "failed" and not reason:
        raise ValueError("a failed snapshot needs a reason")
    return to

"""Stores as Parquet: scoped tables, vectors, postings, metadata documents, artifacts, bundles, histories.

Tables are partitioned by project and snapshot, so a scope is a partition and a snapshot, once written, never changes:
writing one again replaces its partition and nothing else.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.digests import LEAF_DIGITS
from ..operators import retrieve as R
from ..operators import snapshot as S

SCOPE = ["project_id", "snapshot_id"]


def spread(df: DataFrame) -> DataFrame:
    """The table dealt over all cores if it has fewer files than there are cores, else as it is.

    A file of one row group is one task, whatever its size; large tables have many files and aren't moved. The order
    of rows isn't kept.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def put(df: DataFrame, path: str, by: Sequence[str] = SCOPE) -> None:
    """Write rows, replacing the partitions they belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def scan(spark: SparkSession, path: str, project: str, snapshot: str | None = None) -> DataFrame:
    """The visible rows of a scope; only its partitions are read."""
    rows = spark.read.parquet(path).where(F.col("project_id") == project)
    if snapshot is not None:
        rows = rows.where(F.col("snapshot_id") == snapshot)
    return rows.where(~F.coalesce("tombstoned", F.lit(False))) if "tombstoned" in rows.columns else rows


#: Keys that are sent to all tasks, by estimate some 140 bytes each.
MOST_KEYS = 1 << 20


def by_keys(rows: DataFrame, keys: DataFrame, on: str, how: str, n: int | None = None) -> DataFrame:
    """Rows whose key is among n distinct keys (how: left_semi), or isn't (left_anti).

    The rows, which may hold texts, aren't moved; beyond MOST_KEYS, rows and keys meet in a shuffle. Without n the keys are counted.
    """
    n = keys.count() if n is None else n
    if not n and how == "left_anti":
        return rows
    return rows.join(F.broadcast(keys) if n <= MOST_KEYS else keys, on, how)


def get(spark: SparkSession, path: str, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows by key, tombstoned ones too."""
    return spark.read.parquet(path).join(keys, list(on))


def put_leaves(leaves: DataFrame, path: str, trees: str) -> None:
    """Write a snapshot's manifest, dealt by prefix and sorted by key, so that a prefix is in few row groups, and the tree over it."""
    spark = leaves.sparkSession
    scope = leaves.select(*SCOPE).distinct()
    # by hash: ranges would be drawn from a first pass that digests all contents
    ordered = leaves.repartition(F.substring("path_key", 1, LEAF_DIGITS)).sortWithinPartitions(*SCOPE, "path_key")
    put(ordered, path)
    written = spark.read.schema(leaves.schema).parquet(path).join(F.broadcast(scope), SCOPE, "left_semi")
    put(S.source_tree(written, SCOPE).coalesce(1), trees)


def put_vectors(df: DataFrame, path: str, version: str, vector: str = "embedding") -> None:
    """Vectors of one embedding version; a vector of another length than the first stops the write."""
    first = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).limit(1).collect()
    n = first[0]["n"] if first else 0
    same = F.when(F.size(vector) == n, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector hasn't {n} dimensions")))
    put(df.withColumns({vector: same, "embedding_version": F.lit(version), "dimension": F.lit(n)}), path, [*SCOPE, "embedding_version"])


def put_postings(chunks: DataFrame, path: str) -> None:
    """Postings in order of the token, so that a query's tokens touch few row groups."""
    index = R.postings(chunks)
    # a frequent word's postings are several tasks'
    index = index.repartitionByRange(*SCOPE, "token", "chunk_id").sortWithinPartitions(*SCOPE, "token", "chunk_id")
    index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#token", "true").partitionBy(*SCOPE).parquet(path)


def drop_project(spark: SparkSession, paths: Sequence[str], project: str, confirm: str) -> None:
    """Remove a project's partitions from tables; confirm has to repeat its id."""
    if confirm != project or not project:
        raise ValueError("the project's id has to be repeated")
    fs_of = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        where = fs_of(f"{path}/project_id={project}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class Metadata:
    """Metadata documents of any kind, append-only; the last write of a key counts."""

    spark: SparkSession
    path: str

    def put(self, kind: str, project: str, key: str, document: dict, deleted: bool = False) -> None:
        row = [(project, kind, key, json.dumps(document, sort_keys=True), deleted, uuid.uuid4().hex)]
        df = self.spark.createDataFrame(row, "project_id string, kind string, key string, payload string, deleted boolean, write_id string")
        df.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def list(self, kind: str, project: str) -> DataFrame:
        rows = self.spark.read.parquet(self.path).where((F.col("project_id") == project) & (F.col("kind") == kind))
        last = rows.groupBy("key").agg(F.max_by(F.struct("payload", "deleted"), F.struct("at", "write_id")).alias("x"))
        return last.where("not x.deleted").select("key", "x.payload").orderBy("key")

    def get(self, kind: str, project: str, key: str) -> dict | None:
        row = self.list(kind, project).where(F.col("key") == key).first()
        return json.loads(row["payload"]) if row else None

    def delete(self, kind: str, project: str, key: str) -> None:
        self.put(kind, project, key, {}, deleted=True)


def artifacts(spark: SparkSession, root: str, project: str) -> DataFrame:
    """Artifacts <root>/<project>/<id>: id, content, checksum; segments have to be safe names."""
    if not project or project in (".", "..") or "/" in project or "\\" in project:
        raise ValueError("a project id isn't a path")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(f"{root}/{project}")
    name = F.regexp_extract("path", r"([^/]+)\.bin$", 1)
    return files.select(name.alias("artifact_id"), "content", H.sha256(F.col("content")).alias("checksum"))


def verified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Artifacts whose content has the checksum that their record (artifact_id, checksum) gives; others stop the job."""
    both = found.join(expected.select("artifact_id", F.col("checksum").alias("expected")), "artifact_id")
    same = F.when(F.col("checksum") == F.col("expected"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("artifact altered: "), F.col("artifact_id"))))
    return both.select("artifact_id", same.alias("content"), "checksum")


def bundle_faults(chunks: DataFrame, snapshot: str, status: str, chunk_set_hash: str) -> DataFrame:
    """What is wrong with an exported snapshot, a row each: fault. None is sound."""
    by_id = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"))
    sums = chunks.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("snapshot_id") != snapshot).alias("foreign"),
        F.count_if((F.coalesce("chunk_id", F.lit("")) == "") | ~F.coalesce("chunk_hash", F.lit("")).rlike("^[0-9a-f]{64}$")).alias("incomplete"),
    )
    # one row each
    sums = sums.crossJoin(F.broadcast(by_id.agg(F.count_if(F.col("n") > 1).alias("twice")))).crossJoin(F.broadcast(S.chunk_set(chunks).withColumnRenamed("chunk_set_hash", "hash")))
    found = F.array_compact(
        F.array(
            F.when(F.lit(status) != "ready", F.lit("snapshot_not_ready")),
            F.when(F.col("n") == 0, F.lit("no_chunks")),
            F.when(F.col("foreign") > 0, F.lit("foreign_chunks")),
            F.when(F.col("incomplete") > 0, F.lit("incomplete_chunks")),
            F.when(F.col("twice") > 0, F.lit("duplicate_chunks")),
            F.when(F.col("hash") != chunk_set_hash, F.lit("chunk_set_hash_mismatch")),
        )
    )
    return sums.select(F.explode(found).alias("fault"))


def export_snapshot(spark: SparkSession, table: str, project: str, snapshot: str, out: str, status: str = "ready") -> str:
    """Write a snapshot's chunks and a manifest row beside them; returns the chunk set's hash."""
    rows = spark.read.parquet(table).where((F.col("project_id") == project) & (F.col("snapshot_id") == snapshot))
    rows.write.mode("overwrite").parquet(f"{out}/chunks")
    kept = spark.read.parquet(f"{out}/chunks")
    digest = S.chunk_set(kept).first()["chunk_set_hash"]
    manifest = spark.createDataFrame([(project, snapshot, status, digest, kept.count())], "project_id string, snapshot_id string, status string, chunk_set_hash string, n_chunks long")
    manifest.write.mode("overwrite").json(f"{out}/manifest")
    return digest


def import_snapshot(spark: SparkSession, bundle: str, table: str) -> tuple[str, str]:
    """Add an exported snapshot to a table if it is sound; returns its scope."""
    m = spark.read.json(f"{bundle}/manifest").first()
    rows = spark.read.parquet(f"{bundle}/chunks")
    faults = [r["fault"] for r in bundle_faults(rows, m["snapshot_id"], m["status"], m["chunk_set_hash"]).collect()]
    if faults:
        raise ValueError(f"the bundle isn't sound: {', '.join(faults)}")
    put(rows, table)
    return m["project_id"], m["snapshot_id"]


def lexicon(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Lexicon resources of a JSON file as tables: senses, concepts, attestations, variants; empty ids stop the job."""
    shape = "senses array<struct<id:string,lemma:string,concept_ids:array<string>>>, concepts array<struct<id:string,label:string>>, attestations array<struct<id:string,sense_id:string,text:string>>, variants array<struct<form:string,lemma:string>>"
    whole = spark.read.schema(shape).option("multiLine", True).json(path)
    out = {}
    for name in ("senses", "concepts", "attestations", "variants"):
        rows = whole.select(F.inline(name))
        if "id" in rows.columns:
            rows = rows.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", F.raise_error(F.lit(f"a row of {name} has no id"))).otherwise(F.col("id")))
        out[name] = rows
    return out


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def history(spark: SparkSession, path: str, limit: int = 20, at: str = "at") -> DataFrame:
    """The newest rows first."""
    return spark.read.parquet(path).orderBy(F.desc(at)).limit(limit)


class Workspace:
    """A folder's pointer to each project's active snapshot; changes are whole-file renames."""

    def __init__(self, root: str):
        self.file = os.path.join(root, "_active.json")
        os.makedirs(root, exist_ok=True)

    def load(self) -> dict[str, str]:
        try:
            with open(self.file, encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def activate(self, project: str, snapshot: str) -> str | None:
        """Point to a snapshot; returns the one before."""
        state = self.load()
        before = state.get(project)
        state[project] = snapshot
        part = f"{self.file}.{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(state, f, sort_keys=True)
        os.replace(part, self.file)
        return before


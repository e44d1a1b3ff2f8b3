"""The engine: ingest, search, query, pack, verify and replay over a folder of tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import languages as L
from ..functions import text as X
from ..functions import vectors as V
from ..operators import filters as FI
from ..operators import merge as M
from ..operators import pack as K
from ..operators import parse as P
from ..operators import ranking as RK
from ..operators import retrieve as R
from ..operators import snapshot as S
from ..sources import log as LG
from ..sources import postings as PO
from ..sources import tables as ST
from . import seek as SK
from .compile import Plan, compile_query


MODES = ("exact", "sparse", "full-text", "hybrid", "dense", "hybrid-dense", "query")


ROOTS = ("source_root", "chunk_set_hash")


def plan_id(query: str) -> str:
    """A plan's id from what it asks."""
    return "plan_" + hashlib.sha256(query.encode()).hexdigest()[:16]


@dataclass
class Engine:
    """Tables under root: chunks, leaves, trees (over the leaves), changes, index (positional postings), vectors, tombstones; the states of snapshots and which of them is active are in a log of
    commits.

    A snapshot is building until all of it is written, then ready with its roots, or failed with a reason; the one that
    becomes active supersedes the one before, in one commit. Several engines may write to one root: of two that begin
    a snapshot of one name one is refused, and of two activations the later commit holds.
    """

    spark: SparkSession
    root: str

    def __post_init__(self):
        self.log = LG.Log(self.spark, self.table("log"))

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    # --- writing

    def state(self, project: str, snapshot: str) -> dict | None:
        """A snapshot's state: status, roots, reason; None of an unknown one."""
        return self.log.get("snapshot", project, snapshot)

    def _move(self, project: str, snapshot: str, to: str, reason: str = "", **found: object) -> None:
        def decide(state: LG.State) -> LG.Change:
            known = state["snapshot", project, snapshot]
            S.move(known["status"], to, roots=all({**known, **found}.get(k) for k in ROOTS), reason=reason)
            return LG.Change().put("snapshot", project, snapshot, known | found | {"status": to, "reason": reason})

        self.log.commit(decide)

    def _begin(self, project: str, snapshot: str) -> None:
        def decide(state: LG.State) -> LG.Change:
            if ("snapshot", project, snapshot) in state:
                raise ValueError(f"there is a snapshot {snapshot} of project {project}")
            return LG.Change().put("snapshot", project, snapshot, {"status": "building"})

        self.log.commit(decide)

    def ingest(self, files: DataFrame, project: str, snapshot: str, language: str = "", trust: str = "project", enrich: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
        """Parse, chunk, hash and write a snapshot, then make it active; counts of sources by change.

        files: relative_path, content, media_type, source_type. enrich may fill the chunks' metadata columns. Nothing
        becomes active before all is written; a snapshot's name is used once. Sources that the snapshot before had and
        this one hasn't get tombstones; those that are back lose theirs. A file whose text can't be read stops it.

        Only files that are new or differ from the active snapshot are parsed: the chunks of the others are copied from
        there, as they would come out the same. All are parsed if language, trust or the chunkers differ from those it was
        made with, or where either snapshot is enriched. What changed is in the table changes, how many files were
        parsed in the snapshot's state. Hashes and the index are made over all of it.
        """
        made = {"language": language, "trust": trust, "chunkers": [P.SECTIONS, P.PARAGRAPHS], "enriched": enrich is not None}
        self._begin(project, snapshot)
        try:
            before = (self.log.get("active", project, "") or {}).get("snapshot")
            scope = {"project_id": F.lit(project), "snapshot_id": F.lit(snapshot)}
            ST.put_leaves(S.source_leaves(files, project).withColumns(scope), self.table("leaves"), self.table("trees"))
            (now, tree), (old, old_tree) = (tuple(self._scan(t, project, s or snapshot) for t in ("leaves", "trees")) for s in (snapshot, before))
            if not before:
                old, old_tree = old.limit(0), old_tree.limit(0)
            ST.put(S.tree_changes(old, now, old_tree, tree).withColumns(scope), self.table("changes"))
            changes = self.changes(project, snapshot)
            counts = {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count("*").alias("n")).collect()}
            touched = counts.get("added", 0) + counts.get("changed", 0)
            same_way = bool(before) and not enrich and self.state(project, before).get("made") == made
            some = files
            if same_way:
                key, binary = H.path_key(project, F.col("relative_path")), F.unhex("path_key").alias("_key")
                some = ST.by_keys(files.withColumn("_key", F.unhex(key)), S.to_process(changes).select(binary), "_key", "left_semi", touched).drop("_key")
            c = self._chunked(some, project, snapshot, language, trust)
            if enrich:
                c = enrich(c)
            if same_way:
                gone = changes.where(F.col("status").isin("changed", "removed")).select(binary)
                old = self._scan("chunks", project, before).withColumn("_key", F.unhex("path_key"))
                kept = ST.by_keys(old, gone, "_key", "left_anti", counts.get("changed", 0) + counts.get("removed", 0)).drop("_key")
                c = c.unionByName(kept.withColumn("snapshot_id", F.lit(snapshot)))
            ST.put(c, self.table("chunks"))
            written = self._scan("chunks", project, snapshot)
            PO.put(written, self.table("index"), [language])
            self._mark(changes, project, snapshot)
            roots = {"source_root": S.tree_root(tree).first()["source_root"], "chunk_set_hash": S.chunk_set(written).first()["chunk_set_hash"]}
            total = tree.agg(F.sum("n")).first()[0] or 0
        except Exception as e:
            self._move(project, snapshot, "failed", f"{type(e).__name__}: {e}"[:500])
            raise
        self._move(project, snapshot, "ready", **roots, made=made, parsed=touched if same_way else total)
        self.activate(project, snapshot)
        return counts | ({"unchanged": total - touched} if total > touched else {})

    def changes(self, project: str, snapshot: str) -> DataFrame:
        """path_key and status (added, changed or removed) of what a snapshot's ingest found."""
        rows = self.spark.read.schema("path_key string, status string, project_id string, snapshot_id string").parquet(self.table("changes"))
        return rows.where((F.col("project_id") == project) & (F.col("snapshot_id") == snapshot)).select("path_key", "status")

    @staticmethod
    def _chunked(files: DataFrame, project: str, snapshot: str, language: str, trust: str) -> DataFrame:
        """The chunks of files, with empty metadata."""
        parsed = P.readable(P.parse(files).select("relative_path", "text", "media_type"))
        c = P.chunk(parsed, project, snapshot)
        c = c.withColumns({"trust_level": F.lit(trust), "language": F.lit(language), "tombstoned": F.lit(False)})
        for name in ("sense_ids", "concept_ids", "attestation_ids"):
            c = c.withColumn(name, F.array().cast("array<string>"))
        for name in ("register", "region", "time_period", "lexicon_source_id", "source_authority"):
            c = c.withColumn(name, F.lit("").cast("string"))
        return c.withColumn("temporal", F.lit(None).cast("struct<start:timestamp,end:timestamp,basis:string,ingested_at:timestamp>"))

    def activate(self, project: str, snapshot: str) -> None:
        """Make a ready snapshot the active one; the one before is superseded."""

        def decide(state: LG.State) -> LG.Change:
            known = state.get(("snapshot", project, snapshot))
            if not known or known["status"] != "ready":
                raise ValueError(f"snapshot {snapshot} isn't ready")
            out = LG.Change().put("active", project, "", {"snapshot": snapshot})
            before = state.get(("active", project, ""), {}).get("snapshot")
            if before and before != snapshot and (old := state.get(("snapshot", project, before))):
                S.move(old["status"], "superseded")
                out.put("snapshot", project, before, old | {"status": "superseded", "reason": ""})
            return out

        self.log.commit(decide)

    # --- tombstones

    def _mark(self, changes: DataFrame, project: str, snapshot: str) -> None:
        """Write tombstones of removed sources, and take back those of sources that are there again."""
        removed = F.when(F.col("status") == "removed", True).when(F.col("status") == "added", False)
        rows = changes.select(F.substring("path_key", 1, 16).alias("source_id"), removed.alias("removed")).where("removed is not null")
        self._write_marks(rows, project, snapshot)

    def _write_marks(self, rows: DataFrame, project: str, why: str) -> None:
        rows.select("source_id", "removed", F.lit(project).alias("project_id"), F.lit(why).alias("why"), F.current_timestamp().alias("at")).write.mode("append").partitionBy("project_id").parquet(self.table("tombstones"))

    def remove(self, sources: DataFrame, project: str, why: str = "requested") -> None:
        """Hide sources (source_id) from all reading until an ingest brings them back."""
        self._write_marks(sources.select("source_id").distinct().withColumn("removed", F.lit(True)), project, why)

    def tombstones(self, project: str) -> DataFrame:
        """Sources that are removed now: the last mark of each counts."""
        rows = self.spark.read.schema("source_id string, removed boolean, why string, at timestamp, project_id string").parquet(self.table("tombstones")).where(F.col("project_id") == project)
        return M.last_wins(rows, ["source_id"], ["at", "removed"], ["removed", "why"]).where("removed").select("source_id", "why")

    def embed(self, project: str, version: str = "local-hash-v1", kind: str = "digest") -> None:
        """Write vectors of the active snapshot's chunks."""
        c = self.chunks(project).select(*ST.SCOPE, "chunk_id", V.embed(F.col("text"), kind).alias("embedding"))
        ST.put_vectors(c, self.table("vectors"), version)

    def repair(self, project: str, target: str = "all", version: str = "local-hash-v1", kind: str = "digest") -> int:
        """Write vectors (dense) or the index (sparse) of the active snapshot again; it stays active. Number of chunks."""
        if target not in ("all", "dense", "sparse"):
            raise ValueError(f"unknown target {target}")
        n = self.chunks(project).count()
        if not n:
            raise LookupError("the active snapshot has no chunks")
        if target != "sparse":
            self.embed(project, version, kind)
        if target != "dense":
            c = self._scan("chunks", project, self.active(project))
            PO.put(c, self.table("index"), [r[0] for r in c.select("language").distinct().limit(100).collect()])
        return n

    # --- reading

    def active(self, project: str) -> str:
        known = self.log.get("active", project, "")
        if known is None:
            raise LookupError(f"project {project} has no active snapshot")
        return known["snapshot"]

    def _scan(self, name: str, project: str, snapshot: str) -> DataFrame:
        return ST.scan(self.spark, self.table(name), project, snapshot)

    def chunks(self, project: str, tombstones: DataFrame | None = None) -> DataFrame:
        """Chunks of the active snapshot without those of removed sources, and without those of further tombstones."""
        c = ST.by_keys(self._scan("chunks", project, self.active(project)), self.tombstones(project).select("source_id"), "source_id", "left_anti")
        return FI.without_tombstones(c, tombstones) if tombstones is not None else c

    def index(self, project: str) -> PO.Index:
        """The positional index of the active snapshot."""
        return PO.Index(self.spark, self.table("index"), project, self.active(project))

    def search(self, project: str, query: str, mode: str = "hybrid", limit: int = 20, language: str = "", f: FI.Filters = FI.Filters(), rejected: Sequence[str] = (), embedding: tuple[str, str] = ("local-hash-v1", "digest"), rerank: bool = False, rank: str = "often") -> DataFrame:
        """Scored candidates in order, with a snippet's span where the query stands in the text.

        full-text and query are answered by the index; exact, sparse and hybrid look at the chunks that it says can hold
        a word of the query. rank is full-text's: often, or close for cover density. rerank orders the candidates anew
        by the overlap of text and query.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        if not query.strip():
            raise ValueError("the query is empty")
        c = self.chunks(project)
        if mode == "query":
            return M.top(self.query(project, query, language, f).candidates, limit)
        terms = [query, *L.adapter(language).expand(query)] if mode.startswith("hybrid") else [query]
        hits = None
        if "dense" in mode:
            version, kind = embedding
            fn = V.digest_embedding if kind == "digest" else V.rune_embedding
            v = ST.scan(self.spark, self.table("vectors"), project, self.active(project)).where(F.col("embedding_version") == version)
            hits = R.dense(v, fn(query), limit)
        if mode == "full-text":
            hits = RK.top(self.index(project), query, limit, rank)
            found = M.scored(R.of_hits(c, hits, "sparse", ["full_text"], f))
        elif mode == "dense":
            found = M.scored(R.of_hits(c, hits, "dense", ["dense_similarity"], f))
        elif mode == "exact":
            found = M.scored(R.exact(SK.narrow(self.index(project), c, [query.strip()]), query, f))
        elif mode == "sparse":
            found = M.scored(R.sparse(SK.narrow(self.index(project), c, query.lower().split()), query, limit, f))
        else:
            needles = [w for t in terms if t not in rejected for w in t.lower().split()]
            some = c if hits is not None else SK.narrow(self.index(project), c, needles)
            found = R.hybrid(some, terms, limit, f, rejected, hits)
        best = M.top(found, limit)
        out = self._with_snippets(best, c, query)
        return M.rerank(out, V.overlap_score(F.col("text"), query)) if rerank else M.top(out, limit)

    @staticmethod
    def _with_snippets(best: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
        """best is a search's few rows."""
        texts = chunks.select("chunk_id", "text").join(F.broadcast(best.select("chunk_id")), "chunk_id", "left_semi")
        both = best.join(texts, "chunk_id", "left").withColumn("_at", X.byte_position(F.col("text"), query.strip()))
        span = X.snippet_span(F.col("text"), F.col("_at"), F.col("_at") + len(query.strip().encode()))
        return both.withColumn("snippet", F.when(F.col("_at") >= 0, span)).drop("_at")

    def query(self, project: str, query: str, language: str = "", f: FI.Filters = FI.Filters(), rejected: Sequence[str] = ()) -> Plan:
        return compile_query(self.chunks(project), query, language, f, list(rejected), sparse_terms=True, index=self.index(project))

    # --- packs

    def pack(self, project: str, query: str, budget: K.Budget | None = None, language: str = "") -> DataFrame:
        """A pack of a hybrid search; the best hit is required. One row, with its checksum."""
        budget = budget or K.Budget(max_items=8, max_chars=4000)
        found = self.search(project, query, "hybrid", 20, language)
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*M.total_order()))
        drafts = found.withColumn("place", place).select(
            F.lit(f"pack_{self.active(project)}").alias("pack_id"), F.col("chunk_id").alias("id"), F.lit("source_text").alias("class"), "trust_level", "source_id",
            "span_start", "span_end", F.col("text_checksum").alias("checksum"), F.col("text").alias("surface"), F.col("merged_score").alias("score"),
            (F.col("place") == 1).alias("required"), "place",
        )
        # at most 20 rows; the search isn't made again for each use
        made = K.select(self.spark.createDataFrame(drafts.collect(), drafts.schema), budget)
        return made.withColumn("checksum", K.checksum(F.col("evidence"), F.col("rejected"), F.col("pack_id"), project, plan_id(query), instructions=budget.instructions))

    def verify(self, packs: DataFrame, project: str, query: str, budget: K.Budget | None = None) -> DataFrame:
        """pack_id, ok and flags of packs."""
        budget = budget or K.Budget()
        again = K.checksum(F.col("evidence"), F.col("rejected"), F.col("pack_id"), project, plan_id(query), instructions=budget.instructions)
        found = packs.withColumn("flags", K.flags(F.col("evidence"), F.col("checksum"), again))
        return found.select("pack_id", (F.size("flags") == 0).alias("ok"), "flags")

    def replay(self, packs: DataFrame, project: str) -> DataFrame:
        store = self.chunks(project).select("source_id", F.col("text_checksum").alias("checksum"), F.col("text").alias("surface"))
        return K.replay(packs, store)

    def inspect(self, packs: DataFrame, project: str) -> DataFrame:
        """A pack as a report: one row for each item, chosen or rejected, with a short redacted preview and its file's key."""
        taken = packs.select("pack_id", F.posexplode("evidence").alias("place", "item")).withColumn("reason", F.lit(None).cast("string"))
        refused = packs.select("pack_id", F.posexplode("rejected").alias("place", "r")).select("pack_id", "place", F.col("r.item").alias("item"), F.col("r.reason").alias("reason"))
        each = taken.unionByName(refused)
        keys = self.chunks(project).select(F.col("chunk_id").alias("id"), "path_key")
        flat = each.select("pack_id", F.col("reason").isNull().alias("chosen"), "place", "item.*", "reason")
        preview = X.redact(X.truncate(F.col("surface"), 240))["text"]
        rows = flat.join(keys, "id", "left").withColumn("preview", preview)
        return rows.select("pack_id", "chosen", "place", "id", "class", "trust_level", "source_id", "path_key", "span_start", "span_end", "checksum", "score", "reason", "preview", F.length("surface").alias("n_chars"))

    def metrics(self, project: str) -> dict[str, int]:
        """Counters of the active snapshot."""
        return S.counters(self.chunks(project)).first().asDict()

"""Evidence packs: choosing within a budget, checksum, verification, replay."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import hashing as H

#: The checksum's label, the estimator's name, classes that aren't evidence or are facts by themselves.
LABEL = "trailhead/evidence-pack/v1"
ESTIMATOR = "chars-div4-v1"
NOT_EVIDENCE = ["instruction", "policy"]
FACTUAL = ["source_text", "attestation"]

ITEM = "struct<id:string,class:string,trust_level:string,source_id:string,span_start:bigint,span_end:bigint,checksum:string,surface:string,score:double,required:boolean>"


@dataclass(frozen=True)
class Budget:
    """0 is no limit. An instruction reserve bounds what instructions take from max_chars."""

    max_items: int = 0
    max_chars: int = 0
    max_tokens: int = 0
    instruction_reserve: int = 0
    reject_floor: float = 0.3
    required_trust: str = "project"
    instructions: tuple[str, ...] = field(default=())

    def chars(self) -> int | None:
        """Bytes left for items; None without a limit. Instructions that take all leave zero, not no limit."""
        if self.max_chars <= 0:
            return None
        used = sum(len(x.encode()) for x in self.instructions)
        if self.instruction_reserve > 0:
            used = min(used, self.instruction_reserve)
        return max(0, self.max_chars - used)


def dedup(drafts: DataFrame, pack: str = "pack_id", place: str = "place") -> DataFrame:
    """One draft for each source, span and checksum: required ones first, then the best score, then the first.

    The one kept takes the place of the first.
    """
    key = [pack, "source_id", "span_start", "span_end", "checksum"]
    w = Window.partitionBy(*key)
    best = F.row_number().over(w.orderBy(F.desc("required"), F.desc("score"), place))
    return drafts.withColumns({"_n": best, "_p": F.min(place).over(w)}).where("_n = 1").drop("_n", place).withColumnRenamed("_p", place)


def _gate(x) -> Column:
    """Why an item may not be evidence at all, else null."""
    return F.when(x["class"].isin(NOT_EVIDENCE), "instruction_or_policy_not_evidence").when(x["trust_level"] == "quarantined", "quarantined")


def _survivors(rows: list[tuple], budget: Budget) -> list[int]:
    """Numbers of the rows (pack, rank, place, size) that can still be taken.

    A row is taken only if it fits when its turn comes, and then every earlier row that is no larger did fit and was
    taken too. So it can't be if those before it fill the budget. Rows of equal rank and place don't count as earlier.
    """
    out, chars = [], budget.chars()
    pack, before, sizes, waiting = object(), None, [], []
    for i in sorted(range(len(rows)), key=lambda i: ((rows[i][0] is not None, rows[i][0]), *rows[i][1:3])):
        p, rank, place, size = rows[i]
        if p != pack:
            pack, sizes, waiting = p, [], []
        elif before != (rank, place):
            for x in waiting:
                sizes.insert(bisect_right(sizes, x), x)
            waiting = []
        before = (rank, place)
        n = bisect_right(sizes, size)
        if budget.max_items > 0 and n >= budget.max_items:
            continue
        if chars is not None or budget.max_tokens > 0:
            used = sum(sizes[:n]) + size
            if (chars is not None and used > chars) or (budget.max_tokens > 0 and used // 4 > budget.max_tokens):
                continue
        out.append(i)
        waiting.append(size)
    return sorted(out)


def _pruned(drafts: DataFrame, budget: Budget, pack: str, place: str, held_rows: int = 20_000) -> DataFrame:
    """Drafts without those that can't be taken, as far as one task sees. Drafts have a _size, not the surface itself.

    What is left of a pack in a task has a bound by the budget, whatever the number of its drafts. Every pack keeps a row.
    """
    if budget.max_items <= 0 and budget.chars() is None and budget.max_tokens <= 0:
        return drafts
    gated = _reason(drafts, budget).isNotNull()
    plain = ~F.col("required") & ~gated & ~F.isnan("score") & F.col(place).isNotNull() & F.col("_size").isNotNull()
    names = drafts.columns
    marked = drafts.select(*names, plain.alias("_plain"), gated.alias("_gone"))

    def run(batches):
        held, rows = [], 0

        def pruned() -> pa.Table:
            t = pa.Table.from_batches(held)
            packs, plain, gone = (t[c].to_pylist() for c in (pack, "_plain", "_gone"))
            at = [i for i, x in enumerate(plain) if x]
            some = t.take(pa.array(at, pa.int64()))
            ranks = [-x for x in some["score"].to_pylist()]
            live = {at[i] for i in _survivors(list(zip(some[pack].to_pylist(), ranks, some[place].to_pylist(), some["_size"].to_pylist())), budget)}
            # one row of each pack stays, as a pack that takes nothing has a row too
            live.update({p: i for i, p in enumerate(packs)}.values())
            return t.take(pa.array([i for i in range(len(t)) if i in live or not (gone[i] or plain[i])], pa.int64()))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= held_rows:
                left = pruned()
                if len(left) > held_rows // 2:
                    yield from left.select(names).to_batches()
                    left = left.slice(0, 0)
                held, rows = left.to_batches(), len(left)
        if rows:
            yield from pruned().select(names).to_batches()

    return marked.mapInArrow(run, drafts.schema)


def _reason(x, budget: Budget) -> Column:
    """Why an item is rejected whatever room there is, else null."""
    return _gate(x).when(schema.trust_rank(x["trust_level"]) < schema.TRUST_RANK.get(budget.required_trust, -1), "trust_below_required")


#: Of an item, all but its surface; _size stands where the surface does, and _own is the draft's own place.
_LIGHT = "struct<id:string,class:string,trust_level:string,source_id:string,span_start:bigint,span_end:bigint,checksum:string,_size:bigint,score:double,required:boolean>"
_FIELDS = ["id", "class", "trust_level", "source_id", "span_start", "span_end", "checksum", "_size", "score", "required"]


def _light(drafts: DataFrame, pack: str, place: str) -> DataFrame:
    """Distinct drafts without their surfaces: pack, place, _own, and _draft, by which they are considered in order."""
    own = drafts.withColumns({"_size": F.octet_length("surface").cast("bigint"), "_own": F.col(place)}).select(pack, place, "_own", *_FIELDS)
    return dedup(own, pack, place)


def _draft(place: str) -> Column:
    return F.struct(
        (~F.col("required")).alias("later"),
        (-F.col("score")).alias("rank"),
        F.col(place).alias("place"),
        F.struct(*_FIELDS).cast(_LIGHT).alias("item"),
        F.col("_own").alias("own"),
    )


def _chosen(light: DataFrame, budget: Budget, pack: str, place: str) -> DataFrame:
    """One row for each pack: the drafts taken in order, bytes used, error, and the draft at which it ended with that."""
    packs = _pruned(light, budget, pack, place).groupBy(pack).agg(F.array_sort(F.collect_list(_draft(place))).alias("drafts"))
    draft = packs.schema["drafts"].dataType.elementType.simpleString()
    start = F.struct(F.array().cast(f"array<{draft}>").alias("taken"), F.lit(0).cast("bigint").alias("used"), F.lit(None).cast("string").alias("error"), F.lit(None).cast(draft).alias("stop"))

    def step(s: Column, d: Column) -> Column:
        x = d["item"]
        size = x["_size"]
        room = F.lit(True)
        if budget.max_items > 0:
            room = room & (F.size(s["taken"]) < budget.max_items)
        if budget.chars() is not None:
            room = room & (s["used"] + size <= budget.chars())
        tight = room
        if budget.max_tokens > 0:
            tight = tight & (F.floor((s["used"] + size) / 4) <= budget.max_tokens)
        fits = F.when(x["required"], room).otherwise(tight)

        def state(taken=None, used=None, error=None, stop=None) -> Column:
            return F.struct(
                (s["taken"] if taken is None else taken).alias("taken"),
                (s["used"] if used is None else used).cast("bigint").alias("used"),
                (s["error"] if error is None else error).cast("string").alias("error"),
                (s["stop"] if stop is None else stop).alias("stop"),
            )

        return (
            F.when(s["error"].isNotNull() | _reason(x, budget).isNotNull(), s)
            .when(fits, state(taken=F.concat(s["taken"], F.array(d)), used=s["used"] + size))
            .when(x["required"], state(error=F.lit("budget_exhausted_required"), stop=d))
            .otherwise(s)
        )

    return packs.select(pack, F.aggregate("drafts", start, step).alias("s")).select(pack, "s.*")


def _refused(light: DataFrame, chosen: DataFrame, budget: Budget, pack: str, place: str) -> DataFrame:
    """One row for each rejected draft: pack, _draft, reason. chosen has a row a pack and is broadcast."""
    listed = light.withColumn("_why", F.coalesce(_reason(light, budget), F.when(F.col("score") >= budget.reject_floor, "budget_trim"))).where("_why is not null")
    ends = F.broadcast(chosen.select(F.col(pack).alias("_pack"), "taken", "stop"))
    both = listed.withColumn("_draft", _draft(place)).join(ends, F.col(pack).eqNullSafe(F.col("_pack")))
    # what comes at or behind the required draft that ended the pack isn't looked at any more
    seen = F.col("stop").isNull() | (F.col("_draft") < F.col("stop"))
    return both.where(seen & ~F.array_contains("taken", F.col("_draft"))).select(pack, "_draft", F.col("_why").alias("reason"))


def rejections(drafts: DataFrame, budget: Budget, pack: str = "pack_id", place: str = "place") -> DataFrame:
    """One row for each draft that select() lists as rejected: pack, id, class, trust_level, source_id, span, checksum, score, required, reason.

    Neither texts nor lists of rejected drafts meet anywhere, so it may be asked of packs of any number of drafts.
    """
    light = _light(drafts, pack, place)
    found = _refused(light, _chosen(light, budget, pack, place), budget, pack, place)
    return found.select(pack, *(F.col(f"_draft.item.{c}").alias(c) for c in _FIELDS if c != "_size"), "reason")


def _with_surfaces(listed: DataFrame, drafts: DataFrame, pack: str, place: str) -> DataFrame:
    """Listed drafts (pack, _at, _draft, reason) with their surfaces again: pack, _at, item, reason."""
    texts = drafts.withColumns({"_size": F.octet_length("surface").cast("bigint"), "_own": F.col(place)}).select(F.col(pack).alias("_pack"), "_own", *_FIELDS, "surface")
    item = F.col("_draft.item")
    same = F.col(pack).eqNullSafe(F.col("_pack")) & F.col("_draft.own").eqNullSafe(F.col("_own"))
    for c in _FIELDS:
        same = same & item[c].eqNullSafe(F.col(c).cast(T.StructType.fromDDL(_LIGHT.removeprefix("struct<").removesuffix(">"))[c].dataType))
    full = F.struct(*(F.col("surface" if c == "_size" else c) for c in _FIELDS)).cast(ITEM)
    # drafts that are equal in all of this are one
    return listed.join(texts, same).select(pack, "_at", full.alias("item"), "reason").dropDuplicates([pack, "_at"])


def select(drafts: DataFrame, budget: Budget, pack: str = "pack_id", place: str = "place", rejects: bool = True) -> DataFrame:
    """One row for each pack: evidence and rejected items, bytes used, error.

    Drafts are taken required first, then by score, each if it still fits, so a later smaller one may follow one that
    doesn't. A required one that doesn't fit ends the pack with the error budget_exhausted_required. Packs are chosen
    by sizes alone; surfaces are joined to what is listed, so a row is bounded by the budget and by the rejected
    items. Without rejects none of these are listed; where they are many, rejections() has them in rows of their own.

    The drafts are read several times, so they should be a table or few rows.
    """
    light = _light(drafts, pack, place)
    chosen = _chosen(light, budget, pack, place)
    none = F.array().cast(f"array<{ITEM}>")
    bad = F.array().cast("array<struct<item:" + ITEM + ",reason:string>>")
    at = lambda trim, draft: F.struct(trim.alias("trim"), draft.alias("draft"))
    taken = chosen.select(pack, F.explode("taken").alias("_draft")).select(pack, at(F.lit(False), F.col("_draft")).alias("_at"), "_draft", F.lit(None).cast("string").alias("reason"))
    # the budget bounds what is taken
    evidence = _with_surfaces(F.broadcast(taken), drafts, pack, place).groupBy(F.col(pack).alias("_taken")).agg(F.array_sort(F.collect_list(F.struct("_at", "item"))).alias("evidence"))
    out = chosen.join(evidence, F.col(pack).eqNullSafe(F.col("_taken")), "left")
    rejected = bad
    if rejects:
        refused = _refused(light, chosen, budget, pack, place).select(pack, at(F.col("reason") == "budget_trim", F.col("_draft")).alias("_at"), "_draft", "reason")
        some = drafts.where(_reason(drafts, budget).isNotNull() | (F.col("score") >= budget.reject_floor))
        each = _with_surfaces(refused, some, pack, place)
        refused = each.groupBy(F.col(pack).alias("_refused")).agg(F.array_sort(F.collect_list(F.struct("_at", "item", "reason"))).alias("rejected"))
        out = out.join(refused, F.col(pack).eqNullSafe(F.col("_refused")), "left")
        rejected = F.coalesce(F.transform("rejected", lambda x: F.struct(x["item"].alias("item"), x["reason"].alias("reason"))), bad)
    return out.select(pack, F.coalesce(F.transform("evidence", lambda x: x["item"]), none).alias("evidence"), rejected.alias("rejected"), F.col("used").alias("used_bytes"), "error")


def _line(x: Column) -> list[Column]:
    span = F.concat(x["span_start"].cast("string"), F.lit(":"), x["span_end"].cast("string"))
    return [x["id"], x["class"], x["trust_level"], x["source_id"], span, x["checksum"], x["surface"]]


def _ended(parts: list[Column]) -> Column:
    return F.concat(*(F.concat(F.coalesce(p, F.lit("")), F.lit("\0")) for p in parts))


def checksum(evidence: Column, rejected: Column, pack_id: Column, project: str, plan_id: str, task_id: str = "", purpose: str = "", instructions: tuple[str, ...] = (), policies: tuple[str, ...] = (), requirements: tuple[str, ...] = ()) -> Column:
    """SHA-256 of all that a pack says, each field ended by a NUL."""
    ended = lambda xs: F.lit("".join(x + "\0" for x in xs))
    head = _ended([F.lit(LABEL), pack_id, F.lit(project), F.lit(task_id), F.lit(plan_id), F.lit(purpose), F.lit(ESTIMATOR)])
    taken = F.array_join(F.transform(evidence, lambda x: _ended(_line(x))), "")
    refused = F.array_join(F.transform(rejected, lambda r: _ended([*_line(r["item"]), r["reason"]])), "")
    return H.sha256(F.concat(head, ended(instructions), ended(policies), taken, refused, ended(requirements)))


def flags(evidence: Column, given: Column, computed: Column, claimed: Column | None = None, sense_authority: Column | None = None, tool_authority: Column | None = None) -> Column:
    """What is wrong with a pack: array of struct<code, evidence_id>.

    claimed and the authorities are arrays of evidence ids; source text and attestations count as claimed.
    """
    none = F.array().cast("array<string>")
    claimed, senses, tools = (F.coalesce(x, none) if x is not None else none for x in (claimed, sense_authority, tool_authority))

    def of(x: Column) -> Column:
        unsupported = (
            F.when((x["class"] == "sense_claim") & ~F.array_contains(senses, x["id"]), "unsupported_sense_as_fact")
            .when(x["class"] == "concept_mapping", "unsupported_concept_as_fact")
            .when(x["class"] == "model_inference", "unsupported_model_inference_as_fact")
            .when((x["class"] == "tool_output") & ~F.array_contains(tools, x["id"]), "unsupported_model_inference_as_fact")
        )
        no_ref = (F.coalesce(x["source_id"], F.lit("")) == "") | (x["span_end"] <= x["span_start"])
        missing = F.when(no_ref, "missing_source_ref").when(F.coalesce(x["checksum"], F.lit("")) == "", "missing_checksum")
        codes = F.array_compact(F.array(unsupported, missing))
        fact = x["class"].isin(FACTUAL) | F.array_contains(claimed, x["id"])
        return F.when(fact, F.transform(codes, lambda c: F.struct(c.alias("code"), x["id"].alias("evidence_id")))).otherwise(
            F.array().cast("array<struct<code:string,evidence_id:string>>")
        )

    wrong = F.when(given != computed, F.array(F.struct(F.lit("pack_checksum_mismatch").alias("code"), F.lit(None).cast("string").alias("evidence_id"))))
    return F.concat(F.coalesce(wrong, F.array().cast("array<struct<code:string,evidence_id:string>>")), F.flatten(F.transform(evidence, of)))


def replay(packs: DataFrame, surfaces: DataFrame, pack: str = "pack_id") -> DataFrame:
    """Evidence read again by (source_id, checksum): pack, place, id, surface, ok.

    ok is false where the surface is gone or isn't what the pack holds.
    """
    each = packs.select(pack, F.posexplode("evidence").alias("place", "x")).select(pack, "place", "x.*")
    stored = surfaces.select("source_id", "checksum", F.col("surface").alias("stored")).dropDuplicates(["source_id", "checksum"])
    found = each.join(stored, ["source_id", "checksum"], "left")
    same = F.col("stored").isNotNull() & ((F.col("surface") == "") | (F.col("surface") == F.col("stored")))
    ok = F.col("class").isin(NOT_EVIDENCE) | F.coalesce(same, F.lit(False))
    return found.select(pack, "place", "id", F.coalesce("stored", "surface").alias("surface"), ok.alias("ok"))

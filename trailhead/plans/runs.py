"""Models behind HTTP, agent runs over packs, and their append-only traces."""

from __future__ import annotations

import hashlib
import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .control import Policy

TIMEOUT_S = 60
LONG_OUTPUT_BYTES = 256


def post_json(url: str, body: object, timeout: float = TIMEOUT_S) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def http_embedding(text: Column, base_url: str, dimension: int = 0, batch: int = 64, post: Callable[[str, object], dict] = post_json) -> Column:
    """Vectors from POST <base>/v1/embed, a request for each batch of texts.

    A count or dimension that doesn't fit stops the job.
    """
    if not base_url:
        raise ValueError("the embedder needs a base URL")
    url = base_url.rstrip("/") + "/v1/embed"

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = []
            for at in range(0, len(s), batch):
                some = [x or "" for x in s.iloc[at : at + batch]]
                vectors = post(url, {"texts": some})["vectors"]
                if len(vectors) != len(some):
                    raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
                if dimension and any(len(v) != dimension for v in vectors):
                    raise ValueError(f"a vector hasn't {dimension} dimensions")
                out += vectors
            yield pd.Series(out, index=s.index)

    return run(text)


class Traces:
    """Events in an append-only table."""

    SCHEMA = "event_id string, project_id string, run_id string, type string, payload string, n long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, project: str, run: str, events: list[tuple[str, dict]]) -> None:
        rows = [(uuid.uuid4().hex, project, run, kind, json.dumps(payload, sort_keys=True), i) for i, (kind, payload) in enumerate(events)]
        df = self.spark.createDataFrame(rows, self.SCHEMA).withColumn("event_ts", F.current_timestamp())
        df.coalesce(1).write.mode("append").parquet(self.path)

    def of(self, project: str, run: str | None = None) -> DataFrame:
        """In order of time, then place in the run, then id."""
        rows = self.spark.read.parquet(self.path).where(F.col("project_id") == project)
        rows = rows if run is None else rows.where(F.col("run_id") == run)
        return rows.orderBy("event_ts", "n", "event_id")


@dataclass(frozen=True)
class Tool:
    run: Callable[[bytes], bytes]
    side_effect: str = ""


@dataclass
class Run:
    """One run: pack, model, tool if asked for, verification."""

    id: str
    status: str = "pending"
    text: str = ""
    tool_status: str = ""
    artifact: str = ""
    verified: bool = False
    error: str = ""
    events: list[tuple[str, dict]] = field(default_factory=list)


def run_agent(pack: Mapping, complete: Callable[[Mapping], tuple[str, str]], verify: Callable[[], bool], policy: Policy = Policy(), tools: Mapping[str, Tool] | None = None, tool_input: bytes = b"", store: Callable[[str, bytes], None] | None = None) -> Run:
    """Complete over a pack; complete gives a text and the tool it asks for ('' for none).

    A tool runs only if the policy allows it; output of LONG_OUTPUT_BYTES or more goes to the store. Whatever fails
    ends the run as failed; the tool's own failure is only its status.
    """
    out = Run("run_" + hashlib.sha256(str(pack.get("checksum", "")).encode()).hexdigest()[:16])
    note = lambda kind, **payload: out.events.append((kind, payload))
    note("run_started", pack_id=pack.get("pack_id", ""))
    out.status = "running"
    try:
        out.text, wanted = complete(pack)
        if not out.text:
            raise ValueError("the model gave no text")
        note("model_call", status="completed")
        if wanted:
            tool = (tools or {}).get(wanted)
            if tool is None:
                raise LookupError(f"no tool named {wanted}")
            decision = policy.decide(wanted, tool.side_effect)
            note("policy_decision", tool=wanted, decision=decision)
            out.tool_status = {"ask": "needs_approval", "deny": "denied"}.get(decision, "running")
            if decision == "allow":
                _execute(out, wanted, tool, tool_input, store, note)
        out.verified = verify()
        note("pack_verified", status="ok" if out.verified else "flagged")
        out.status = "completed"
        note("run_finished", status=out.status)
    except Exception as e:
        out.status, out.error = "failed", str(e)
        note("run_failed", error=out.error)
    return out


def _execute(out: Run, name: str, tool: Tool, given: bytes, store, note) -> None:
    try:
        result = tool.run(given)
    except Exception as e:
        out.tool_status, out.error = "failed", str(e)
        return
    if store and len(result) >= LONG_OUTPUT_BYTES:
        out.artifact = f"{out.id}_{name}_out"
        store(out.artifact, result)
    out.tool_status = "completed"
    note("tool_executed", tool=name, bytes=len(result))

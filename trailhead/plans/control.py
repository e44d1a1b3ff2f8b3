"""The control plane in Python: policy decisions, schedules, jobs, readiness, failure injection."""

from __future__ import annotations

import fnmatch
import json
import os
import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime, timedelta

DECISIONS = ("allow", "ask", "deny")
SIDE_EFFECTS = ("write", "external")


@dataclass(frozen=True)
class Policy:
    """Rules (tool or *, decision), the first that fits; else side effects ask, and the rest gets the default."""

    rules: Sequence[tuple[str, str]] = ()
    default: str = "deny"

    def decide(self, tool: str, side_effect: str = "") -> str:
        for name, decision in self.rules:
            if name in (tool, "*"):
                if decision not in DECISIONS:
                    raise ValueError(f"unknown decision {decision}")
                return decision
        return "ask" if side_effect in SIDE_EFFECTS else self.default or "deny"


@dataclass(frozen=True)
class Schedule:
    """Once at a time, at intervals, or at events of a type (a pattern)."""

    id: str
    project: str
    owner: str
    query: str
    kind: str
    next_run: datetime | None = None
    interval_s: int = 0
    event_type: str = ""
    enabled: bool = True
    last_job: str = ""

    def __post_init__(self):
        needs = {"once_at": self.next_run, "interval": self.interval_s > 0, "on_event": self.event_type}
        if not all((self.id, self.project, self.owner, self.query)) or not needs.get(self.kind):
            raise ValueError("the schedule is incomplete")

    def fired(self, at: datetime, job: str) -> Schedule:
        """The schedule after a run: an interval moves on past now, a single one is done."""
        if self.kind == "once_at":
            return replace(self, enabled=False, last_job=job)
        if self.kind == "interval":
            step = timedelta(seconds=self.interval_s)
            following = (self.next_run or at) + step
            return replace(self, next_run=following if following > at else at + step, last_job=job)
        return replace(self, last_job=job)


class Schedules:
    """Schedules in a folder, a JSON file each."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(root, exist_ok=True)

    def put(self, s: Schedule) -> None:
        _write(os.path.join(self.root, f"{s.id}.json"), asdict(s))

    def list(self, project: str | None = None) -> list[Schedule]:
        found = [_schedule(_read(os.path.join(self.root, n))) for n in sorted(os.listdir(self.root)) if n.endswith(".json")]
        return [s for s in found if project in (None, s.project)]

    def delete(self, schedule: str) -> None:
        os.remove(os.path.join(self.root, f"{schedule}.json"))

    def due(self, now: datetime) -> list[Schedule]:
        timed = [s for s in self.list() if s.enabled and s.kind in ("once_at", "interval")]
        return sorted((s for s in timed if s.next_run is None or s.next_run <= now), key=lambda s: (s.next_run or now, s.id))

    def tick(self, start: Callable[[Schedule], str], now: datetime | None = None) -> list[str]:
        """Start what is due; ids of what was started."""
        now = now or datetime.now(UTC)
        return self._start(self.due(now), start, now)

    def fire(self, start: Callable[[Schedule], str], project: str, event_type: str, now: datetime | None = None) -> list[str]:
        """Start what waits for events of a type."""
        waiting = [s for s in self.list(project) if s.enabled and s.kind == "on_event" and fnmatch.fnmatchcase(event_type, s.event_type)]
        return self._start(waiting, start, now or datetime.now(UTC))

    def _start(self, some: list[Schedule], start: Callable[[Schedule], str], now: datetime) -> list[str]:
        for s in some:
            self.put(s.fired(now, start(s)))
        return [s.id for s in some]


@dataclass
class Job:
    id: str
    status: str = "running"
    started: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    error: str = ""
    result: object = None


class Jobs:
    """Background runs in threads; a cancelled run's Spark jobs are interrupted by their tag."""

    def __init__(self, root: str, spark=None, workers: int = 4):
        self.root, self.spark = root, spark
        os.makedirs(root, exist_ok=True)
        self.jobs: dict[str, Job] = {}
        self.lock = threading.Lock()
        self.pool = ThreadPoolExecutor(workers)

    def start(self, run: Callable[[], object]) -> str:
        job = Job(uuid.uuid4().hex)
        self._put(job)
        self.pool.submit(self._run, job, run)
        return job.id

    def _run(self, job: Job, run: Callable[[], object]) -> None:
        try:
            if self.spark is not None:
                self.spark.addTag(job.id)
            result, status, error = run(), "completed", ""
        except Exception as e:
            result, status, error = None, "failed", str(e)
        with self.lock:
            if job.status == "running":
                job.status, job.error, job.result = status, error, result
        self._put(job)

    def _put(self, job: Job) -> None:
        with self.lock:
            self.jobs[job.id] = job
        _write(os.path.join(self.root, f"{job.id}.json"), {k: v for k, v in asdict(job).items() if k != "result"})

    def cancel(self, job: str) -> Job:
        with self.lock:
            found = self.jobs[job]
            if found.status == "running":
                found.status = "cancelled"
        if self.spark is not None:
            self.spark.interruptTag(job)
        self._put(found)
        return found

    def wait(self) -> None:
        self.pool.shutdown(wait=True)

    def list(self) -> list[Job]:
        """The newest first."""
        return sorted(self.jobs.values(), key=lambda j: (j.started, j.id), reverse=True)


def readiness(probes: Mapping[str, Callable[[], object]], inject: Mapping[str, bool] | None = None) -> dict[str, str]:
    """Each backend's state: ok, or what its probe raised. inject names those that are to fail."""
    out = {}
    for name, probe in probes.items():
        try:
            if (inject or {}).get(name):
                raise RuntimeError("failure injected")
            probe()
            out[name] = "ok"
        except Exception as e:
            out[name] = str(e) or type(e).__name__
    return out


def _write(path: str, value: object) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, default=str, sort_keys=True)
    os.replace(part, path)


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _schedule(d: dict) -> Schedule:
    at = d.get("next_run")
    return Schedule(**{**d, "next_run": datetime.fromisoformat(at) if at else None})

import shutil
import subprocess
import sys
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest

import __spark_entry__ as entry
from trailhead.plans import control

ROOT = Path(entry.__file__).parent


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_point_without_the_text_operators(tmp_path):
    for name in ("trailhead", "__spark_entry__.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_phrase' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_policy():
    p = control.Policy([("search", "allow"), ("write", "deny")])
    assert (p.decide("search"), p.decide("write", "write"), p.decide("other", "external"), p.decide("other")) == ("allow", "deny", "ask", "deny")
    assert control.Policy([("*", "ask")]).decide("x") == "ask" and control.Policy(default="allow").decide("x") == "allow"
    with pytest.raises(ValueError):
        control.Policy([("x", "maybe")]).decide("x")


def test_schedules(tmp_path):
    now = datetime(2024, 1, 1, tzinfo=UTC)
    s = control.Schedules(str(tmp_path))
    s.put(control.Schedule("once", "p", "o", "q", "once_at", now))
    s.put(control.Schedule("later", "p", "o", "q", "once_at", now + timedelta(hours=1)))
    s.put(control.Schedule("often", "p", "o", "q", "interval", now - timedelta(hours=5), 60))
    s.put(control.Schedule("event", "p", "o", "q", "on_event", event_type="index.*"))
    assert s.tick(lambda x: "j", now) == ["often", "once"] and s.tick(lambda x: "j", now) == []
    assert {x.id: x.next_run for x in s.list()}["often"] == now + timedelta(seconds=60)
    assert s.fire(lambda x: "j", "p", "index.ready", now) == ["event"] and s.fire(lambda x: "j", "q", "index.ready", now) == []
    s.delete("event")
    assert [x.id for x in s.list("p")] == ["later", "often", "once"]
    with pytest.raises(ValueError):
        control.Schedule("x", "p", "o", "q", "interval")


def test_jobs_and_readiness(tmp_path):
    def fail():
        raise RuntimeError("no")

    j = control.Jobs(str(tmp_path))
    a, b = j.start(lambda: 5), j.start(fail)
    j.wait()
    assert j.jobs[a].result == 5 and (j.jobs[b].status, j.jobs[b].error) == ("failed", "no") and len(j.list()) == 2
    assert control.readiness({"a": lambda: 1, "b": fail, "c": lambda: 1}, {"c": True}) == {"a": "ok", "b": "no", "c": "failure injected"}

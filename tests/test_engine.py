import hashlib

import pytest
from pyspark.sql import functions as F

from trailhead.operators import filters as FI
from trailhead.operators.pack import Budget
from trailhead.plans import engine as E
from trailhead.plans import runs
from trailhead.plans.control import Policy
from trailhead.plans.engine import Engine
from trailhead.sources import files as SF
from trailhead.streaming import events as SE


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    docs = root / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("runners run in the park\n\nriver bank erosion\n")
    (docs / "b.md").write_text("# Title\nRunners run here, too.\n## Part\nThe bank of the river.\n")
    e = Engine(spark, str(root / "store"))
    assert e.ingest(SF.documents(spark, str(docs)), "p", "s1", language="en") == {"added": 2}
    (docs / "a.txt").write_text("runners run in the park\n\nriver bank erosion again\n")
    assert e.ingest(SF.documents(spark, str(docs)), "p", "s2", language="en") == {"changed": 1, "unchanged": 1}
    e.embed("p")
    return e


def test_search_modes(engine):
    texts = {m: [r["text"] for r in engine.search("p", "bank", m, language="en").collect()] for m in ("exact", "sparse", "hybrid", "query", "hybrid-dense", "dense")}
    assert all(any("erosion again" in t for t in x) for x in texts.values())
    assert len(texts["dense"]) == len(texts["hybrid-dense"]) == 4
    first = engine.search("p", "in the park", "exact").first()
    assert first["merged_score"] == 1 and first["snippet"]["start"] == 0
    with pytest.raises(ValueError):
        engine.search("p", " ", "exact")
    with pytest.raises(LookupError):
        engine.search("nobody", "x")


def test_filters_and_tombstones(engine, spark):
    assert engine.search("p", "bank", "exact", f=FI.Filters(language="de")).count() == 0
    gone = engine.chunks("p").select("source_id").distinct()
    assert engine.chunks("p", gone).count() == 0


def files(spark, texts):
    rows = [(k, v if isinstance(v, bytes) else v.encode(), "text/plain", "file") for k, v in texts.items()]
    return spark.createDataFrame(rows, "relative_path string, content binary, media_type string, source_type string")


def test_states_names_and_activation(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.state("p", "s1") is None
    e.ingest(files(spark, {"a": "one"}), "p", "s1")
    assert e.state("p", "s1")["status"] == "ready" and all(e.state("p", "s1")[k] for k in ("source_root", "chunk_set_hash"))
    with pytest.raises(ValueError):
        e.ingest(files(spark, {"a": "two"}), "p", "s1")
    # bytes that aren't UTF-8 are named and stop the ingest; what was active stays
    with pytest.raises(Exception, match="can't read b"):
        e.ingest(files(spark, {"a": "one", "b": b"\xff\xfe\xfa"}), "p", "s2")
    assert e.state("p", "s2")["status"] == "failed" and "can't read b" in e.state("p", "s2")["reason"] and e.active("p") == "s1"
    for name in ("s2", "s9"):
        with pytest.raises(ValueError):
            e.activate("p", name)
    e.ingest(files(spark, {"a": "one"}), "p", "s3")
    assert e.state("p", "s1")["status"] == "superseded" and e.active("p") == "s3"
    assert e.state("p", "s1")["source_root"] == e.state("p", "s3")["source_root"]
    with pytest.raises(ValueError):
        e.activate("p", "s1")


def test_removed_sources_are_hidden_until_they_are_back(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.ingest(files(spark, {"a": "red boat", "b": "blue boat"}), "p", "s1")
    found = lambda: sorted(r["text"] for r in e.search("p", "boat", "full-text").collect())
    assert found() == ["blue boat", "red boat"] and e.tombstones("p").count() == 0
    e.remove(e.chunks("p").where("text = 'red boat'"), "p")
    assert found() == ["blue boat"] and e.metrics("p")["sources"] == 1
    assert e.query("p", "boat").candidates.count() == 1
    e.ingest(files(spark, {"b": "blue boat"}), "p", "s2")
    assert e.tombstones("p").count() == 1
    e.ingest(files(spark, {"a": "red boat", "b": "blue boat"}), "p", "s3")
    assert found() == ["blue boat", "red boat"] and e.tombstones("p").count() == 0
    ranked = e.search("p", "red boat", "sparse", rerank=True).collect()
    assert [r["merged_score"] for r in ranked] == [108.0, 9.0]


def test_pack_verify_replay(engine):
    packs = engine.pack("p", "bank", Budget(max_items=2, max_chars=400))
    assert len(packs.first()["evidence"]) == 2
    assert engine.verify(packs, "p", "bank").first()["ok"]
    altered = packs.withColumn("checksum", F.lit("0" * 64))
    assert engine.verify(altered, "p", "bank").first()["flags"][0]["code"] == "pack_checksum_mismatch"
    assert all(r["ok"] for r in engine.replay(packs, "p").collect())


def test_inspect_metrics_and_repair(engine):
    packs = engine.pack("p", "bank", Budget(max_items=1, max_chars=400))
    rows = engine.inspect(packs, "p").collect()
    assert [r["chosen"] for r in rows].count(True) == 1 and any(r["reason"] == "budget_trim" for r in rows)
    assert all(r["path_key"] and r["preview"] for r in rows)
    assert engine.metrics("p")["sources"] == 2
    assert engine.repair("p") == engine.metrics("p")["chunks"] and engine.active("p") == "s2"


def test_runs_and_traces(engine, spark, tmp_path):
    pack = engine.pack("p", "bank", Budget(max_items=2, max_chars=400)).first().asDict()
    kept = {}
    tools = {"look": runs.Tool(lambda x: b"y" * 300), "send": runs.Tool(lambda x: x, "external"), "bad": runs.Tool(lambda x: 1 / 0)}

    def go(tool, policy=Policy([("look", "allow"), ("bad", "allow"), ("no", "deny")]), text="done"):
        return runs.run_agent(pack, lambda p: (text, tool), lambda: True, policy, tools, b"in", kept.__setitem__)

    r = go("look")
    assert (r.status, r.tool_status, r.verified) == ("completed", "completed", True) and len(kept[r.artifact]) == 300
    assert go("send").tool_status == "needs_approval" and go("send", Policy([("send", "deny")])).tool_status == "denied"
    assert go("bad").tool_status == "failed" and go("bad").status == "completed"
    assert go("none").status == "failed" and go("", text="").status == "failed"
    t = runs.Traces(spark, f"{tmp_path}/t")
    t.append("p", r.id, r.events)
    assert [x["type"] for x in t.of("p", r.id).collect()] == ["run_started", "model_call", "policy_decision", "tool_executed", "pack_verified", "run_finished"]


def test_http_embedding(spark):
    fake = lambda url, body: {"vectors": [[float(len(t)), 1.0] for t in body["texts"]]}
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(runs.http_embedding(F.col("t"), "http://x/", 2, post=fake)).collect()] == [[2.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="3 dimensions"):
        df.select(runs.http_embedding(F.col("t"), "http://x", 3, post=fake)).collect()
    with pytest.raises(ValueError):
        runs.http_embedding(F.col("t"), "")


def test_streams(spark, tmp_path):
    rows = [("e1", "c1", "2024-01-01 10:05:00"), ("e1", "c1", "2024-01-01 10:05:00"), ("e2", "c2", "2024-01-01 10:59:00"), ("e3", "c3", "2024-01-01 12:30:00")]
    events = spark.createDataFrame(rows, "event_id string, payload_checksum string, at string").withColumn("ingested_at", F.col("at").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = SE.window_counts(SE.distinct_events(stream), "ingested_at", delay=None).writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert [(str(r["window_start"]), r["n_events"]) for r in spark.table("win").orderBy("window_start").collect()] == [("2024-01-01 10:00:00", 2)]
    assert SE.sessions(events, "ingested_at", "1 hour").count() == 2
    assert SE.conflicts(events).count() == 0
    known = spark.createDataFrame([("s", 1), ("s", 2)], "source_id string, version int")
    late = spark.createDataFrame([("s", 0), ("t", 0)], "source_id string, version int")
    assert {(r["source_id"], r["version"]) for r in SE.late_version(known, late).collect()} == {("s", 3), ("t", 1)}


def test_conflicts_are_exact(spark):
    events = spark.range(4000).selectExpr("id AS event_id", "explode(array(sha2(concat('a', id), 256), sha2(concat('b', id), 256))) AS payload_checksum")
    more = spark.range(4000, 4100).selectExpr("id AS event_id", "'same' AS payload_checksum")
    got = SE.conflicts(events.unionByName(more).unionByName(more))
    assert got.columns == ["event_id", "versions"] and sorted(r["event_id"] for r in got.collect()) == list(range(4000))
    assert got.where("versions < 2").count() == 0


def test_rows_are_not_moved_to_few_keys(spark, monkeypatch):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, keys = spark.range(100).withColumn("text", F.lit("x")), spark.range(10, 30).select("id")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        for most, moved in ((20, False), (19, True)):
            monkeypatch.setattr(E.ST, "MOST_KEYS", most)
            for how, n in (("left_semi", 20), ("left_anti", 80)):
                for given in (None, 20):
                    got = E.ST.by_keys(rows, keys, "id", how, given)
                    assert ("SortMergeJoin" in plan(got)) == moved and got.count() == n
        assert E.ST.by_keys(rows, keys.limit(0), "id", "left_anti").count() == 100
        assert E.ST.by_keys(rows, keys.limit(0), "id", "left_semi").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_contents_are_digested_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    key = F.udf(lambda x: seen.add(1) or hashlib.sha256(str(x).encode()).hexdigest())
    leaves = spark.range(500).select(key("id").alias("path_key"), F.lit("l").alias("leaf"), F.lit("p").alias("project_id"), F.lit("s").alias("snapshot_id"))
    E.ST.put_leaves(leaves, f"{tmp_path}/l", f"{tmp_path}/t")
    assert seen.value == 500 and spark.read.parquet(f"{tmp_path}/l").select("path_key").distinct().count() == 500


def test_an_ingest_parses_changed_files_only(spark, tmp_path, monkeypatch):
    given = []
    parse = E.P.parse
    monkeypatch.setattr(E.P, "parse", lambda df: given.append(df.select("relative_path").collect()) or parse(df))
    e = Engine(spark, str(tmp_path))
    first = {f"f{i}": f"red boat {i}\n\nblue boat {i}\n" for i in range(12)} | {"empty": ""}
    second = first | {"f3": "green boat", "new": "white boat"}
    del second["f5"]
    rows = lambda: sorted(map(str, e.chunks("p").drop("snapshot_id").select(sorted(set(e.chunks("p").columns) - {"snapshot_id"})).collect()))
    found = lambda q: {r["text"] for r in e.search("p", q, "full-text", 50).collect()}
    e.ingest(files(spark, first), "p", "s1")
    assert e.ingest(files(spark, second), "p", "s2") == {"added": 1, "changed": 1, "removed": 1, "unchanged": 11}
    assert sorted(r[0] for r in given[1]) == ["f3", "new"] and e.state("p", "s2")["parsed"] == 2 and e.state("p", "s1")["parsed"] == 13
    copied = rows()
    assert len(copied) == 22 and found("green") == {"green boat"} and found("white") == {"white boat"} and len(found("red")) == 10
    assert e.ingest(files(spark, second), "p", "s3") == {"unchanged": 13} and e.state("p", "s3")["parsed"] == 0 and rows() == copied
    # another way of making it: all are parsed, and again when it goes back
    e.ingest(files(spark, second), "p", "s4", language="en", enrich=lambda c: c.withColumn("region", F.lit("x")))
    assert e.state("p", "s4")["parsed"] == 13 and e.chunks("p").where("language <> 'en' OR region <> 'x'").count() == 0
    e.ingest(files(spark, second), "p", "s5")
    assert e.state("p", "s5")["parsed"] == 13 and rows() == copied
    assert all(len({e.state("p", s)[k] for s in ("s2", "s3", "s5")}) == 1 for k in E.ROOTS)

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailhead.functions import hashing as H
from trailhead.functions import text as X
from trailhead.functions import vectors as V
from trailhead.operators import parse as P
from trailhead.operators import snapshot as S
from trailhead.sources import files as SF
from trailhead.sources import tables as ST


def sha(*parts):
    return hashlib.sha256(b"\0".join(p.encode() if isinstance(p, str) else p for p in parts)).hexdigest()


def over(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first()["x"]


def test_normal_text(spark):
    t = F.col("t")
    assert over(spark, "﻿a\r\nb\rcafé".encode(), X.for_hashing(t), "binary") == "a\nb\ncafé"
    assert over(spark, b"\xff", X.for_hashing(t), "binary") is None
    assert over(spark, ".\\a\\b.txt", X.relative_path(t)) == "a/b.txt"
    assert over(spark, "a/é b", X.safe_id(t)) == "a____b"
    assert over(spark, "x" * 250, X.truncate(t)) == "x" * 240 + "…"


def test_token_spans_are_bytes(spark):
    text = "«Ёж-1» и кот_2"
    got = over(spark, text, F.struct(X.tokens(F.col("t")).alias("w"), X.nth_token_span(F.col("t"), F.lit(1), 2).alias("s")))
    assert got["w"] == ["ёж-1", "и", "кот_2"] and text.encode()[got["s"]["start"] : got["s"]["end"]].decode() == "и кот_2"
    at = over(spark, text, X.byte_position(F.col("t"), "кот"))
    assert text.encode()[at:].decode().startswith("кот")
    assert over(spark, text, X.rune_span(F.col("t"), F.lit(0), F.lit(at)))["end"] == text.index("кот")
    assert over(spark, text, X.snippet_span(F.col("t"), F.lit(3), F.lit(5)))["start"] == 0


def test_redaction(spark):
    text = 'Authorization: Bearer abcdef123456\napi_key=ABCDEFGH1234\npassword: hunter22\nmail me@example.com, token="x"'
    r = over(spark, text, X.redact(F.col("t")))
    assert r["count"] == 4 and r["text"].count("[REDACTED]") == 4 and "hunter22" not in r["text"] and "Bearer [REDACTED]" in r["text"]
    assert over(spark, "please GRANT TOOL now", X.injected(F.col("t"))) and not over(spark, "fine", X.injected(F.col("t")))


def test_html():
    page = "<html><style>p{}</style><h1>Title</h1><p>Hello <b>runners</b> &amp;  co</p><script>x()</script><br/>end"
    assert P.html_text(page) == "Title\nHello runners & co\nend"
    assert P.html_text("<h1>Title</h1><p>Hello <b>runners</b></p><script>x()</script>", compat=True) == "Title\nHello runners"
    assert P.html_text("a<script>b</script>c", compat=True) == "a" and P.html_text("a < b") == "a"


def test_pdf():
    assert P.pdf_text(b"%PDF-1.4\nBT (Hello \\(runners\\)) Tj ET (x) Tj") == "Hello (runners) x"
    assert P.pdf_text(b"%PDF-1.4 (ab) (some text)") == "some text" and P.pdf_text(b"no") is None


def test_markdown_sections():
    text = "pre\n# A\nbody\n## B\ninner \n\n### C\ndeep\n# D\n#no\n####### x\n"
    got = P.markdown_sections(text)
    assert [(s[0], s[1], s[4]) for s in got] == [(3, "C", ["A", "B", "C"]), (2, "B", ["A", "B"]), (1, "A", ["A"]), (1, "D", ["D"])]
    bodies = [text.encode()[a:b].decode() for a, b, _ in P.section_spans(text)]
    assert bodies == ["inner \n\n### C\ndeep", "body\n## B\ninner \n\n### C\ndeep", "#no\n####### x"]


def brute_paragraphs(text):
    data, at, out = text.encode(), 0, []
    for part in data.split(b"\n\n"):
        body = part.strip(b"\n \t")
        if body:
            lead = len(part) - len(part.lstrip(b"\n \t"))
            out.append((at + lead, at + lead + len(body)))
        at += len(part) + 2
    return out or ([(0, len(data))] if data else [])


def test_paragraphs(spark):
    texts = ["hello\n\nworld\n", "\n\n\n é \n\n\n\nü\t\n\n", " \n\n ", "", "one", "a\n\n\nb\n\n \t\n\nçé ç\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(P.paragraphs(F.col("t")).alias("s")).collect()
    assert [[(x["start"], x["end"]) for x in r["s"]] for r in rows] == [brute_paragraphs(t) for t in texts]


def plain_root(head, rows):
    """The root of the tree over (key, line), rows of a leaf in the order given."""
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def up(label, nodes):
        return digest(label + "".join(f"{p}\0{d}\0" for p, d in sorted(nodes.items())))

    leaves = {}
    for k, line in rows:
        leaves[k[:3]] = leaves.get(k[:3], "") + line
    leaves = {p: digest("trailhead/tree-leaf/v1\0" + x) for p, x in leaves.items()}
    inner = {a: up("trailhead/tree-node/v1\0", {p: d for p, d in leaves.items() if p[0] == a}) for a in {p[0] for p in leaves}}
    return up(head, inner)


def test_trees_differ_only_where_leaves_do(spark, tmp_path):
    made = lambda rows: spark.createDataFrame([("p", s, hashlib.sha256(k.encode()).hexdigest(), v) for s, k, v in rows], "project_id string, snapshot_id string, path_key string, leaf string")
    one = [("s1", f"k{i}", "v") for i in range(3000)]
    two = [("s2", k, "w" if k == "k7" else v) for _, k, v in one if k != "k9"] + [("s2", "new", "v")]
    same = [("s3", k, v) for _, k, v in one]
    for rows in (one, two, same, [("s4", "k1", "v")]):
        ST.put_leaves(made(rows), f"{tmp_path}/leaves", f"{tmp_path}/trees")
    leaves, trees = ({s: ST.scan(spark, f"{tmp_path}/{t}", "p", s) for s in ("s1", "s2", "s3", "s4", "s5")} for t in ("leaves", "trees"))
    roots = {s: S.tree_root(trees[s]).first()["source_root"] for s in trees}
    assert roots["s1"] == roots["s3"] == S.source_root(made(one)).first()["source_root"] and len(set(roots.values())) == 4
    assert roots["s5"] == S.source_root(made(one).limit(0)).first()["source_root"]
    changes = lambda a, b: {(r["path_key"], r["status"]) for r in S.tree_changes(leaves[a], leaves[b], trees[a], trees[b]).collect()}
    key = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert changes("s1", "s2") == {(key("k7"), "changed"), (key("k9"), "removed"), (key("new"), "added")}
    assert changes("s1", "s3") == set() and len(changes("s1", "s4")) == 2999 and len(changes("s5", "s1")) == 3000
    # leaves of three prefixes in two manifests; of equal ones none at all
    plan = S.tree_changes(leaves["s1"], leaves["s2"], trees["s1"], trees["s2"])
    assert all(p in plan._jdf.queryExecution().optimizedPlan().toString() for p in (key("k7")[:3], key("k9")[:3], key("new")[:3]))
    assert "parquet" not in S.tree_changes(leaves["s1"], leaves["s3"], trees["s1"], trees["s3"])._jdf.queryExecution().optimizedPlan().toString().lower()


def test_chunks_hashes_and_one_edit(spark):
    def of(files):
        f = spark.createDataFrame([(p, bytearray(c.encode()), m, "file") for p, c, m in files], "relative_path string, content binary, media_type string, source_type string")
        return P.chunk(P.parse(f).select("relative_path", "text", "media_type"), "p", "s"), S.source_leaves(f, "p")

    files = [("a.txt", "hello\n\nworld\n", "text/plain"), ("doc.md", "# Hi\n\nSection body.\n", "text/markdown")]
    c, leaves = of(files)
    got = {r["text"]: r for r in c.collect()}
    assert set(got) == {"hello", "world", "\nSection body."}
    key = sha("p", "a.txt")
    w = got["world"]
    want = hashlib.sha256(b"\0".join([b"trailhead/chunk/v1", b"paragraph-v1", key.encode(), (7).to_bytes(8, "big") + (12).to_bytes(8, "big"), hashlib.sha256(b"world").digest()])).hexdigest()
    assert (w["path_key"], w["chunk_hash"], w["chunk_id"], w["source_id"]) == (key, want, f"chk_p_{want[:16]}", key[:16])
    leaf = {r["path_key"]: r["leaf"] for r in leaves.collect()}
    assert leaf[key] == sha("trailhead/source-leaf/v1", key, "file", hashlib.sha256(b"hello\n\nworld\n").hexdigest())
    root = S.source_root(leaves).first()["source_root"]
    assert root == plain_root("trailhead/source-root/v2\0", [(k, f"{k}\0{v}\0") for k, v in sorted(leaf.items())])
    assert S.source_root(of(files[::-1])[1]).first()["source_root"] == root
    changed = of([("a.txt", "hello\n\nworld!\n", "text/plain"), files[1]])[1]
    assert sorted(r["status"] for r in S.diff_sources(leaves, changed).collect()) == ["changed", "unchanged"]
    assert S.to_process(S.diff_sources(leaves, changed)).count() == 1
    hashes = sorted(r["chunk_hash"] for r in c.collect())
    assert S.chunk_set(c).first()["chunk_set_hash"] == plain_root("trailhead/chunk-set/v2\0", [(h, h + "\0") for h in hashes])


def test_ignore_patterns():
    import re

    rx = SF.ignore_regex(SF.ignore_patterns(["*.log", "# note", "docs/*.md", "secret", "tmp/"], ["a/b"]))
    hit = lambda p: re.search(rx, SF.clean_path(p)) is not None
    assert all(map(hit, [".git/x", "x/app.log", "docs/a.md", "x/secret/y", "secret", "tmp/f", "a/b/c", "vendor/m.go", "logs.log/z"]))
    assert not any(map(hit, ["docs/x/a.md", "secrets", "a/bc", "src/main.txt", "tmpx/f", "x.logs"]))


def test_files_are_found(spark, tmp_path):
    for name, text in {"a.md": "# A\nx", "b/c.TXT": "t", "b/d.bin": "z", "node_modules/e.md": "n", "f.html": "<p>h"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_text(text)
    got = {r["relative_path"]: r["media_type"] for r in SF.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "text/markdown", "b/c.TXT": "text/plain", "f.html": "text/html"}


def test_events(spark, tmp_path):
    line = lambda i, m: json.dumps({"event_id": i, "message": m, "occurred_start": "2026-07-13T10:00:00Z"})
    lines = [line("evt-002", "dense vectors upserted"), "", "  " + line("evt-001", "index snapshot committed") + " "]
    (tmp_path / "e.ndjson").write_text("\n".join(lines))
    ev = SF.events(spark, str(tmp_path))
    assert ev.count() == 2
    ids = SF.identities(ev.select("event_id", "payload_checksum"))
    once = SF.batch_checksum(ids).first()
    both = SF.batch_checksum(SF.identities(ev.unionByName(ev).select("event_id", "payload_checksum"))).first()
    sums = sorted((json.loads(x)["event_id"], hashlib.sha256(x.strip().encode()).hexdigest()) for x in lines if x)
    assert once == both and once["checksum"] == plain_root("trailhead/event-batch/v2\0", [(hashlib.sha256(i.encode()).hexdigest(), f"\0{i}\0{c}") for i, c in sums])
    w = SF.window_checksum(ids, F.lit("2026-07-13 10:00:00").cast("timestamp"), F.lit("2026-07-13 11:30:00.5").cast("timestamp")).first()["checksum"]
    assert w == plain_root("trailhead/event-window/v2\x002026-07-13T10:00:00Z\x002026-07-13T11:30:00.5Z\0occurred\0", [(hashlib.sha256(i.encode()).hexdigest(), f"\0{i}\0{c}") for i, c in sums])
    clash = ev.unionByName(ev.withColumn("payload_checksum", F.lit("other")))
    with pytest.raises(Exception, match="conflicting payload"):
        SF.identities(clash).collect()
    with pytest.raises(Exception, match="no event_id"):
        SF.event_lines(spark.createDataFrame([('{"message": "x"}',)], "value string")).collect()


def test_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, v array<float>")
    q = F.array(F.lit(1.0), F.lit(0.0))
    got = {r["k"]: (r["c"], r["l"], r["d"]) for r in df.select("k", V.cosine(F.col("v"), q).alias("c"), V.l2_score(F.col("v"), q).alias("l"), V.dot(F.col("v"), q).alias("d")).collect()}
    assert got["a"] == (1, 1, 1) and got["b"][0] == pytest.approx(0.7071068) and got["c"] == (0, 0, 0)
    e = V.digest_embedding("text")
    assert len(e) == 32 and sum(x * x for x in e) == pytest.approx(1, abs=1e-5)
    assert V.rune_embedding("ab") == pytest.approx([(97 % 31) / 31, (98 % 31) / 31, 0, 0, 0, 0, 0, 0])


def test_states_and_quotas(spark):
    def phase(status="ready", n=5, gone=0, failed=False, rebuilding=False, active="s"):
        r = spark.range(1).select(S.lifecycle(F.lit(status), F.lit(n), F.lit(gone), F.lit(failed), F.lit(rebuilding), F.lit(active)).alias("r")).first()["r"]
        return r["phase"], r["search_available"], r["reasons"]

    assert phase() == ("ready", True, ["search_available"])
    assert phase(n=0) == ("empty", False, ["no_snapshot", "search_unavailable"])
    assert phase(status="building") == ("failed", False, ["snapshot_not_ready", "search_unavailable"])
    assert phase(gone=1, failed=True) == ("degraded", True, ["last_failed_retained", "tombstoned_sources_present", "search_available"])
    assert phase(rebuilding=True) == ("rebuilding", True, ["rebuild_in_progress", "search_available"])
    q = spark.createDataFrame([(0, 0), (7, 10), (8, 10), (10, 10), (1, 1), (0, 1)], "u long, m long").select(S.quota(F.col("u"), F.col("m")).alias("d"))
    assert [r["d"] for r in q.collect()] == ["allow", "allow", "ask", "deny", "deny", "allow"]
    assert S.move("building", "ready") == "ready"
    for bad in (("ready", "failed"), ("building", "failed")):
        with pytest.raises(ValueError):
            S.move(*bad)


def test_stores(spark, tmp_path):
    root = str(tmp_path)
    c = spark.createDataFrame([("p", "s1", "c1", "x", H_OF("x")), ("p", "s1", "c2", "y", H_OF("y")), ("q", "s1", "c1", "z", H_OF("z"))], "project_id string, snapshot_id string, chunk_id string, text string, chunk_hash string")
    ST.put(c, f"{root}/c")
    ST.put(c.where("project_id = 'p'").limit(1), f"{root}/c")
    assert ST.scan(spark, f"{root}/c", "p").count() == 1 and ST.scan(spark, f"{root}/c", "q").count() == 1
    digest = ST.export_snapshot(spark, f"{root}/c", "q", "s1", f"{root}/b")
    assert ST.import_snapshot(spark, f"{root}/b", f"{root}/c2") == ("q", "s1") and ST.scan(spark, f"{root}/c2", "q").count() == 1
    rows = spark.read.parquet(f"{root}/b/chunks")
    faults = lambda df, **k: {r["fault"] for r in ST.bundle_faults(df, **dict(snapshot="s1", status="ready", chunk_set_hash=digest) | k).collect()}
    assert faults(rows) == set()
    assert faults(rows.unionByName(rows)) == {"duplicate_chunks", "chunk_set_hash_mismatch"}
    assert faults(rows.limit(0)) == {"no_chunks", "chunk_set_hash_mismatch"} and faults(rows, status="building", snapshot="s2") == {"snapshot_not_ready", "foreign_chunks"}
    m = ST.Metadata(spark, f"{root}/m")
    m.put("source", "p", "k", {"a": 1})
    m.put("source", "p", "k", {"a": 2})
    m.put("source", "p", "l", {})
    m.delete("source", "p", "l")
    assert m.get("source", "p", "k") == {"a": 2} and [r["key"] for r in m.list("source", "p").collect()] == ["k"]
    ST.drop_project(spark, [f"{root}/c"], "q", confirm="q")
    assert ST.scan(spark, f"{root}/c", "q").count() == 0
    w = ST.Workspace(f"{root}/w")
    assert w.activate("p", "s1") is None and w.activate("p", "s2") == "s1" and w.load() == {"p": "s2"}
    ST.put_postings(c, f"{root}/post")
    assert spark.read.parquet(f"{root}/post").where("token = 'x'").count() == 1
    v = spark.createDataFrame([("p", "s", "c1", [1.0, 2.0]), ("p", "s", "c2", [1.0])], "project_id string, snapshot_id string, chunk_id string, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        ST.put_vectors(v, f"{root}/v", "v1")


def H_OF(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_time_text(spark):
    t = spark.createDataFrame([("2024-01-02 03:04:05.120000",), ("2024-01-02 03:04:05",)], "t string").select(H.utc_text(F.col("t").cast("timestamp")).alias("x"))
    assert [r["x"] for r in t.collect()] == ["2024-01-02T03:04:05.12Z", "2024-01-02T03:04:05Z"]


def test_token_spans_stay_in_their_rows(spark):
    rows = [(f"c{i % 5}", i, t) for i, t in enumerate(["", " ", "a", "é b c\td ", "\n\nx", "no end", "ü", None, "a\x0bb  c", "日本 語"])]
    c = spark.createDataFrame(rows, "chunk_id string, span_start long, text string").repartition(2)
    found = P.index_tokens(c, ["span_start"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hash" not in plan
    want = []
    for chunk, at, text in rows:
        for n, m in enumerate(re.finditer(rb"[^ \t\n\x0b\f\r]+", (text or "").encode())):
            want.append((chunk, f"{chunk}:{n}", m[0].decode(), at + m.start(), at + m.end(), at))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_composed_texts_stay_in_the_jvm(spark):
    texts = ["plain", "n\u00e9 \u00dcn\u00ef \u02ff", "\u041a\u0438\u0439 \u0451\u0436", "e\u0301", "\u0438\u0306", "\u212b", "\u0395\u03bb\u0301", "\u65e5\u672c", "\u0483", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.nfc(F.col("t")).alias("n"), (~F.col("t").rlike(f"[^{X.COMPOSED}]")).alias("here")).collect()
    assert [r["n"] for r in got] == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert [r["here"] for r in got] == [True] * 2 + [False] * 7 + [None]


def test_pdf_texts_are_objects_a_portion_at_a_time():
    held = []
    parts = [pa.array([b"%PDF-1.4 (" + b"x" * 50_000 + b") Tj"] * 300 + [None, b"none"])]
    spy = lambda x: held.append(x) or P.pdf_text(x)
    out = next(X.each_text(iter(parts), spy))
    assert out.to_pylist() == ["x" * 50_000] * 300 + [None, None] and len(held) == 301

import os

import pytest
from pyspark.sql import functions as F

from trailhead.sources import connector as C
from trailhead.sources import files as SF


@pytest.fixture
def docs(spark, tmp_path):
    C.register(spark)
    root = tmp_path / "docs"
    for name, text in {"a.txt": "one", "b/c.MD": "# two", "b/d.html": "<p>x", "vendor/e.txt": "no", "f.exe": "no", "g.txt": "", "h": "no", ".git/i.txt": "no", "ü/j.text": "vier"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def rows(df):
    return sorted((r["relative_path"], bytes(r["content"]), r["length"], r["media_type"], r["source_type"]) for r in df.collect())


def test_documents_are_those_of_the_listing(spark, docs, tmp_path):
    found = spark.read.format("trailhead_documents").load(docs)
    # Spark's binaryFile leaves empty files out
    assert rows(found.where("length > 0")) == rows(SF.documents(spark, docs)) and len(rows(found)) == 5
    assert rows(spark.read.format("trailhead_documents").load(f"file://{docs}")) == rows(found)
    small = spark.read.format("trailhead_documents").option("partBytes", 1).load(docs)
    assert rows(small) == rows(found) and small.rdd.getNumPartitions() >= 4
    every = spark.read.format("trailhead_documents").option("ignore", "b/").load(docs)
    assert {r[0] for r in rows(every)} == {"a.txt", "g.txt", "vendor/e.txt", "ü/j.text"}
    (tmp_path / "none").mkdir()
    assert spark.read.format("trailhead_documents").load(f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("trailhead_documents").load(f"{tmp_path}/nowhere").collect()


def test_filters_reach_the_listing(spark, docs):
    found = spark.read.format("trailhead_documents").load(docs)
    for where in ("relative_path LIKE '%.txt'", "media_type = 'text/html'", "relative_path IN ('a.txt', 'g.txt')", "relative_path LIKE 'b/%' AND length > 4"):
        assert [r for r in rows(found.where(where)) if r[2]] == rows(SF.documents(spark, docs).where(where)), where
    # files that a filter leaves out aren't opened
    reader = C.DocumentReader(docs, SF.ignore_patterns(), 1)
    assert list(reader.pushFilters([C.DS.StringEndsWith(("relative_path",), ".txt"), C.DS.GreaterThan(("length",), 1)])) == [C.DS.GreaterThan(("length",), 1)]
    assert [n for p in reader.partitions() for _, n in p.paths] == ["a.txt", "g.txt"]


def test_streams_go_on_at_their_offset(spark, tmp_path):
    C.register(spark)
    root = tmp_path / "in"
    (root / "day").mkdir(parents=True)

    def put(name, ids, at):
        (root / name).write_text("\n".join(f'{{"event_id":"{i}"}}' for i in ids))
        os.utime(root / name, (at, at))

    def run():
        lines = spark.readStream.format("trailhead_events").option("settle", 0).load(str(root))
        out = SF.event_lines(lines).select("event_id").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
        out.trigger(availableNow=True).start().awaitTermination()
        return sorted(r[0] for r in spark.read.schema("event_id string").parquet(f"{tmp_path}/out").collect())

    put("day/b.ndjson", ["e1", "e2"], 1000)
    put("a.txt", ["no"], 1000)
    assert run() == ["e1", "e2"]
    put("a.jsonl", ["e3"], 2000)
    put("c.JSONL", [], 2000)
    assert run() == ["e1", "e2", "e3"] and run() == ["e1", "e2", "e3"]
    assert run() == sorted(r["event_id"] for r in SF.events(spark, str(root)).select(F.col("event_id")).collect())
    # a file that may still be written isn't taken
    put("d.jsonl", ["e4"], 4102444800)
    assert run() == ["e1", "e2", "e3"]
    reader = C.EventReader(str(root), 0, 1)
    assert len(reader.partitions(reader.initialOffset(), reader.latestOffset())) == 3
    assert [len(b) for b in C.EventReader._lines(__import__("io").BytesIO(b"x" * (3 << 20) + b"\ny\n\nz"), "f")] == [4]

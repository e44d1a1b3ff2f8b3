import random

from pyspark.sql import functions as F

from trailhead.streaming import identity as I

SCHEMA = "event_id string, payload_checksum string, ingested_at timestamp, version string"


def table(spark, rows):
    shaped = [(i, c, None if t is None else str(t), "clash") for i, c, t in rows]
    return spark.createDataFrame(shaped, "event_id string, payload_checksum string, t string, version string").select("event_id", "payload_checksum", F.timestamp_seconds(F.col("t").cast("long")).alias("ingested_at"), "version")


def plain(batches):
    """Brute force: versions by id, a micro-batch after another."""
    out, known, latest = set(), {}, {}
    for rows in batches:
        least = {}
        for i, c, t in rows:
            if i is not None and c is not None:
                t = -1 if t is None else t
                least[i, c] = min(least.get((i, c), t), t)
        before = dict(latest)
        for (i, c), t in sorted(least.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
            if c not in known.setdefault(i, []):
                known[i].append(c)
                out.add((i, c, len(known[i]), len(known[i]) > 1, i in before and -1 < t < before[i]))
                latest[i] = max(latest.get(i, -1), t)
    return out


def test_micro_batches_equal_brute_force_and_the_batch_result(spark, tmp_path):
    rng = random.Random(5)
    hot = lambda: rng.choice(["hot", "hot", f"e{rng.randrange(12)}", None if rng.random() < 0.1 else "x"])
    rows = [(hot(), rng.choice([f"c{rng.randrange(6)}", None if rng.random() < 0.1 else "c0"]), None if rng.random() < 0.03 else rng.randrange(300)) for _ in range(300)]
    in_order = sorted(rows, key=lambda r: -1 if r[2] is None else r[2])
    late = [("hot", "c9", 5), ("e1", "c9", 1), ("new", "c1", 0), ("hot", "c0", 2)]
    batches = [[r for r in in_order if (-1 if r[2] is None else r[2]) < 100], [r for r in in_order if r[2] is not None and r[2] >= 100]]
    for k, batch in enumerate([*batches, late]):
        table(spark, batch).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        # every run is a query of its own that goes on at the checkpoint
        I.run_available(spark, I.stream_versions(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
        got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
        assert len(got) == len(set(got)) and set(got) == plain([*batches, late][: k + 1])
        if k == 1:
            assert set(got) == {tuple(r) for r in I.versions(table(spark, rows)).collect()}
    assert ("new", "c1", 1, False, False) in got and [r[2:] for r in got if r[:2] == ("hot", "c9")] == [(7, True, True)]


def test_an_empty_table(spark):
    assert I.versions(table(spark, [("a", "b", 1)]).where("false")).count() == 0

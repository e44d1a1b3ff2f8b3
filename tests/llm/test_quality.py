import math
import random
import zlib

import zstandard
from pyspark.sql import functions as F

from trailhead.llm import common, quality

GOOD = ["river", "stone", "walked", "slowly", "across", "bridge", "morning", "window", "garden", "letter"]


def good(rnd):
    return " ".join(rnd.choice(GOOD) for _ in range(rnd.randrange(20, 120)))


def bad(rnd):
    return " ".join(rnd.choice(GOOD).upper() + "!!" if rnd.random() < 0.5 else rnd.choice(["$$$", "click", "%%%"]) for _ in range(rnd.randrange(20, 120)))


def data(spark, n=600):
    rnd = random.Random(2)
    rows = [(i, good(rnd) if i % 4 else bad(rnd), int(bool(i % 4))) for i in range(n)]
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = data(spark)
    model = quality.train(docs, labels)
    got = quality.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(common.held_out(F.col("doc_id")))
    rows = got.select("quality", "score", quality.predicted(F.col("score"))).collect()
    assert len(rows) > 80 and sum(r["quality"] == r["predicted"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_held_out_labels_are_never_read(spark):
    docs, labels = data(spark)
    wrong = labels.withColumn("quality", F.when(common.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, labels) == quality.train(docs, wrong)
    held = {r["doc_id"] for r in docs.where(common.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_whole_texts_count(spark):
    model = quality.train(*data(spark))
    z = model.compressors()
    rnd = random.Random(3)
    a, b = " ".join(good(rnd) for _ in range(60)).encode(), " ".join(bad(rnd) for _ in range(60)).encode()
    assert quality.difference(a, z, 1024) > quality.difference(a + b, z, 1024) > quality.difference(b, z, 1024)


def test_edge_rows(spark):
    docs, labels = data(spark)
    model = quality.train(docs, labels)
    rows = [(1, None), (2, ""), (3, "word " * 200_000), (3, "word " * 200_000), (None, "x")]
    out = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(out) == 5 and out[0]["score"] == out[1]["score"] and out[2]["score"] == out[3]["score"]
    empty_docs, empty_labels = docs.limit(0), labels.limit(0)
    none = quality.train(empty_docs, empty_labels)
    assert quality.score(empty_docs, none).count() == 0
    assert {r["score"] for r in quality.score(docs.limit(3), none).collect()} == {0.5}
    only = quality.train(docs, labels.where("quality = 1"))
    assert quality.score(docs.limit(1), only).first()["score"] > 0.99


def test_scores_equal_plain_python(spark):
    """Compressed sizes of each block under either dictionary, then the logistic curve; columns in another case are replaced."""
    docs, labels = data(spark)
    model = quality.train(docs, labels)
    rnd = random.Random(4)
    texts = [rnd.choice([good, bad])(rnd) * rnd.choice([1, 5]) for _ in range(40)] + ["", "é" * 2000]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, SCORE int")
    level, block = model.settings.level, model.settings.block_bytes
    for r in quality.score(table, model).collect():
        b, sizes = texts[r["doc_id"]].encode(), []
        for dictionary in (model.good, model.bad):
            z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(z.compress(b[i : i + block])) for i in range(0, len(b), block)))
        x = (sizes[1] - sizes[0]) / sum(sizes) if sum(sizes) else 0.0
        assert abs(r["score"] - 1 / (1 + math.exp(-(model.slope * x + model.intercept)))) < 1e-9


def test_repeated_and_conflicting_labels(spark):
    docs, labels = data(spark)
    again = labels.unionByName(labels.where("quality = 1"))
    assert quality.train(docs, again).good == quality.train(docs, labels).good
    both = labels.unionByName(spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, quality int"))
    assert quality.train(docs, both).good == quality.train(docs, labels.where("doc_id <> 1")).good

"""Row numbers stay those of their rows when a later scan packs the files into other partitions."""

import random

import pytest

import corpus_pipeline as cp
from trailhead.llm import common, substrings

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def other_splits(spark, monkeypatch):
    """After the named table is written, files are packed one to a partition, as other cores would have it."""
    real = common.materialize

    def after(name):
        def materialize(df, given):
            out = real(df, given)
            if given == name:
                spark.conf.set(SPLIT, "4m")
            return out

        monkeypatch.setattr(common, "materialize", materialize)

    yield after
    spark.conf.unset(SPLIT)


def documents(spark, tmp_path):
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(48)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(0, 48, 3)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(16).write.parquet(f"{tmp_path}/d")
    return spark.read.parquet(f"{tmp_path}/d")


def test_substrings(spark, tmp_path, other_splits):
    docs = documents(spark, tmp_path)
    other_splits("repeats")
    got = {r["doc_id"]: bytes(r["kept"]) for r in substrings.remove_repeats(docs).collect()}
    want = {r["doc_id"]: b"" if r["doc_id"] >= 100 else r["text"].encode() for r in docs.collect()}
    assert got == want


def test_near_duplicates(spark, tmp_path, other_splits):
    docs = documents(spark, tmp_path)
    other_splits("sets")
    kept = cp.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(48))

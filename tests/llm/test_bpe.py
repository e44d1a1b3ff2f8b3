import gc
import random
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailhead.llm import bpe, common
from trailhead.llm.queries import tokenizer_file

PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "中", "😀", "1", "23", "٣", "½", "<|endoftext|>", "<|", "　", "\xa0", "\x85", "\x1c", "!", "??", "_", "\r\n", "aaaa", "İ", "'", "ll", "Ⅷ"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(tokenizer_file())


def test_equals_the_library_on_random_texts(reference):
    rnd, e = random.Random(7), bpe.encoder(tokenizer_file())
    for _ in range(4000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 16)))
        want = reference.encode(text, add_special_tokens=False).ids
        ids = e.encode(text)
        assert ids.tolist() == want, text
        assert e.decode(ids) == reference.decode(want, skip_special_tokens=False) == text


def test_caches_stay_bounded(monkeypatch):
    for name, most in (("CACHED_CHUNK_BYTES", 2000), ("CACHED_PIECE_BYTES", 2000), ("CACHED_PAIRS", 5)):
        monkeypatch.setattr(bpe, name, most)
    e = bpe.Encoder(bpe.Vocabulary(tokenizer_file()))
    for k in range(3):
        e.encode(" ".join(f"word{i},{k}" for i in range(100)))
        for cache in (e.chunks, e.pieces):
            for half in (cache.young, cache.old):
                assert sum(bpe.ENTRY_BYTES + len(a) + len(b) for a, b in half.items()) <= 2000
        assert len(e.pairs) <= 5 and e.chunks.young


def test_caches_go_when_other_work_begins():
    e = bpe.encoder(tokenizer_file())
    e.encode("some words to keep")
    common.begin(f"bpe {tokenizer_file()}")
    assert e.chunks.young
    common.begin()
    assert not e.chunks.young and not e.pieces.young and not e.pairs


def test_vocabulary_goes_when_other_work_begins():
    held = weakref.ref(bpe.encoder(tokenizer_file()))
    common.begin(f"bpe {tokenizer_file()}")
    assert held()
    common.begin()
    gc.collect()
    assert held() is None


def test_texts_come_in_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text"))
    try:
        spark.conf.set(key, "10000")
        got = [r["n"] for r in common.map_texts(rows, sizes, "n long").collect()]
        assert sum(got) == 2500 and max(got) == common.BATCH_ROWS
        # a bound of the session's own stays
        spark.conf.set(key, "700")
        got = [r["n"] for r in common.map_texts(rows, sizes, "n long").collect()]
        assert sum(got) == 2500 and max(got) == 700
        spark.conf.set(key, "10000")
        assert bpe.encode(rows, tokenizer_file()).count() == 2500 and spark.conf.get(key) == str(common.BATCH_ROWS)
    finally:
        spark.conf.set(key, before)


def test_invalid_utf8_is_replaced_as_the_library_does(reference):
    ids = [130, 131, 64]
    assert bpe.encoder(tokenizer_file()).decode(__import__("numpy").array(ids)) == reference.decode(ids, skip_special_tokens=False)


def test_columns_nulls_long_texts_and_repeats(spark, reference):
    long = "wörd " * 30000 + "x" * 50000
    rows = [(1, None, "keep"), (2, "", "keep"), (3, "Ab <|endoftext|> c", "keep"), (3, "Ab <|endoftext|> c", "keep"), (None, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(docs, tokenizer_file(), decoded="decoded").collect()
    assert len(out) == 5 and out[0].asDict().keys() == {"doc_id", "text", "ids", "decoded"}
    for r in out:
        assert r["ids"] == reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    back = bpe.decode(bpe.encode(docs, tokenizer_file()).select("doc_id", "ids"), tokenizer_file())
    assert sorted(x["text"] for x in back.collect()) == sorted((r[1] or "") for r in rows)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file()).count() == 0

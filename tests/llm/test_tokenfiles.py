import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trailhead.llm import common, queries, tokenfiles
from trailhead.llm.queries import tokenizer_file

PARTS = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "中", "😀", "1", "23", "½", "<|endoftext|>", "<|", "　", "\xa0", "\x85", "\x1c", "!", "??", "_", "\r\n", "aaaa", "'", "\x1f"]


PLAIN = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "'", "é", "Ёж", "ſ", "1", "23", "!", "??", "_", "-", "S", "'S"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


def test_parts_have_the_ids_of_whole_texts(library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHED_BYTES", 4000)
    rnd, e = random.Random(3), tokenfiles.Encoder(tokenizer_file())
    assert e.split
    for _ in range(400):
        some = PARTS if rnd.random() < 0.5 else PLAIN
        texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 16))) for _ in range(10)]
        got = [np.frombuffer(e.encode(x), "<u4").tolist() for x in texts]
        assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)], texts
        assert ["".join(tokenfiles.units(x)) for x in texts] == texts
        for known in (e.pieces, e.units):
            assert known.room > -1000 and len(known) + len(known.old) < 20
    assert e.pieces.old and e.units.old
    e.forget()
    assert not e.pieces and not e.pieces.old


def test_texts_of_a_portion_are_encoded_together(library):
    rnd, e = random.Random(5), tokenfiles.Encoder(tokenizer_file())
    plain = [*PLAIN, "'re", "'ve", "'d", "l", "v", "e", "   "]
    for _ in range(300):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choice(plain if rnd.random() < 0.8 else PARTS) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 30))]
        whole = pa.array(["not asked for", *texts], pa.string())
        ids, n = e.encode_all(whole[1:], (2).to_bytes(4, "little"))
        want = [[*library.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
        assert n.tolist() == [len(x) for x in want], texts
        assert ids.tolist() == sum(want, []), texts


def test_pieces_are_those_of_the_pre_tokenizer(library):
    rnd = random.Random(6)
    for _ in range(2000):
        texts = ["".join(rnd.choice(["'", "s", "r", "e", "l", " ", " ", "\n", "1", "!", "é", "x"]) for _ in range(rnd.randint(0, 8))) for _ in range(4)]
        raw = [x.encode() for x in texts]
        starts = np.cumsum([0, *map(len, raw)])
        want = [int(at) + len(x[:a].encode()) for at, x in zip(starts, texts) for _, (a, _) in library.pre_tokenizer.pre_tokenize_str(x)]
        if starts[-1]:
            assert tokenfiles.pieces(np.frombuffer(b"".join(raw), np.uint8), starts[:-1]).tolist() == want, texts


def test_a_piece_is_looked_up_once_for_all_texts_of_a_portion():
    class Counted(tokenfiles.Known):
        asked = 0

        def __getitem__(self, part):
            self.asked += 1
            return super().__getitem__(part)

    e = tokenfiles.Encoder(tokenizer_file())
    e.pieces = Counted(e.pieces.encode)
    _, n = e.encode_all(pa.array(["a word and another word"] * 1000))
    assert n.sum() >= 5000 and e.pieces.asked == 4


def test_other_vocabularies_are_not_split():
    plain = {"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}, "added_tokens": [], "model": {"type": "BPE"}}
    assert tokenfiles.splittable(plain)
    for change in ({"model": {"type": "WordPiece"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [{"content": "<x>", "rstrip": True}]}):
        assert not tokenfiles.splittable(plain | change)


def rows_of(n):
    rnd = random.Random(n)
    return [(i, " ".join(rnd.choice(["one", "two", "three", "\n"]) for _ in range(rnd.randint(0, 30)))) for i in rnd.sample(range(10 * n), n)]


def expected(rows, library):
    out, before = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return out


def test_query_equals_the_library(spark, library, tmp_path):
    rows = [*rows_of(700), (-5, None), (-4, ""), (None, "no id"), (100_001, "wörd  " * 30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_token_files(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows, library)


def test_rows_of_one_id_and_clashing_columns(spark, library):
    rows = [(7, "same")] * 30 + [(7, "other"), (7, None), (8, "x")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, file int, Start string")
    path = common.folder(spark, "t")
    tokenfiles.write(docs, path, tokenizer_file(), 2)
    got = sorted((r["start"], r["doc_id"], r["ids"]) for r in tokenfiles.read(spark, path).collect())
    assert len(got) == 33 and got[-1][1] == 8
    at = 0
    for start, _, ids in got:
        assert start == at and ids[-1] == 2
        at += len(ids)
    assert sorted(x[2] for x in got) == sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows)


def test_empty_table(spark):
    path = common.folder(spark, "t")
    tokenfiles.write(spark.createDataFrame([], "doc_id string, text string"), path, tokenizer_file(), 2)
    assert tokenfiles.checksums(tokenfiles.read(spark, path)).count() == 0


def scanned(df):
    """Rows that the scans of a plan that ran gave out."""
    df.collect()
    nodes, out = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        x = nodes.pop()
        if x.nodeName().startswith("AdaptiveSparkPlan"):
            nodes.append(x.executedPlan())
        elif x.nodeName().startswith("Scan orc"):
            out += x.metrics().apply("numOutputRows").value()
        else:
            nodes += [x.children().apply(i) for i in range(x.children().size())]
            if hasattr(x, "plan") and "QueryStage" in x.nodeName():
                nodes.append(x.plan())
    return out


def test_metadata_prune_rows(spark):
    docs = spark.range(12_000).selectExpr("id * 2 as doc_id", "concat('text ', id) as text")
    path = common.folder(spark, "t")
    tokenfiles.write(docs, path, tokenizer_file(), 2)
    whole, one, absent = tokenfiles.read(spark, path), tokenfiles.read(spark, path, [4242]), tokenfiles.read(spark, path, [4243])
    assert one.count() == 1 and absent.count() == 0
    assert scanned(whole) == 12_000
    # the row index leaves one group of rows; the Bloom filter none of an id that lies between others
    assert 0 < scanned(one) <= tokenfiles.STRIDE_ROWS
    assert scanned(absent) == 0

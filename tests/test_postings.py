import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixtures import TOWN, chunks, plain_answer
from pyspark.sql import functions as F

from trailhead.functions import text as X
from trailhead.operators import filters as FI
from trailhead.operators import ranking as R
from trailhead.plans import seek as SK
from trailhead.plans.compile import compile_query
from trailhead.sources import postings as P

SCOPED = "project_id string, snapshot_id string, chunk_id string, source_id string, span_start long, span_end long, text string, text_checksum string, trust_level string"


def made(spark, texts, snapshot="s"):
    rows = [("p", snapshot, str(i), f"d{i}", 0, len((t or "").encode()), t, "", "external") for i, t in texts]
    return spark.createDataFrame(rows, SCOPED)


def decoded(index, tokens):
    """chunk id to token to places, straight from the blocks."""
    out = {}
    named = {r["segment"]: r["ids"] for r in index.segments().collect()}
    for r in index.blocks(tokens).collect():
        docs, tfs, sizes, places = P.decode(r["n"], r["cf"], r["lists"])
        assert len(docs) == r["n"] and len(places) == r["cf"] and r["most"] == P.part(tfs, sizes).max()
        for doc, tf, size, end in zip(docs, tfs, sizes, np.cumsum(tfs)):
            out.setdefault((named[r["segment"]][doc], size), {})[r["token"]] = places[end - tf : end].tolist()
    return out


WORDS = ["boat", "Boat", "river", "oars", "rivers", "boats", "x-ray", "_a", "straße", "İx", "ёлка", "елка", "7"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    some = [(i, rnd.choice([" ", ", ", "  ", "\n"]).join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 40)))) for i in range(300)]
    return [*some, (900, None), (901, ""), (902, "?!"), (903, "boat " * 5000), (904, "ΟΔΟΣ ΟΔΟΣΑ")]


@pytest.fixture(scope="module")
def indexed(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")  # many segments
    try:
        c = made(spark, texts).unionByName(made(spark, [(1, "another boat")], "other"))
        P.put(c.repartition(3, "chunk_id"), path, ["en", "ru"])
        P.put(c.repartition(3, "chunk_id"), path, ["en", "ru"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    return P.Index(spark, path, "p", "s")


def test_numbers_as_bytes():
    rnd = random.Random(0)
    values = np.array([0, 1, 127, 128, 2**14 - 1, 2**14, 2**21, 2**28, 2**31 - 1, *(rnd.randrange(2 ** rnd.randrange(1, 32)) for _ in range(500))])
    data, size = P.packed(values)
    assert P.unpacked(data).tolist() == values.tolist() and size.sum() == len(data) and size[:4].tolist() == [1, 1, 1, 2]
    assert len(P.packed(values[:0])[0]) == len(P.unpacked(np.empty(0, np.uint8))) == 0


def test_blocks_hold_every_place(spark, texts, indexed):
    c = made(spark, texts)
    want = {}
    for r in c.select("chunk_id", X.tokens(F.col("text")).alias("w")).collect():
        for place, w in enumerate(r["w"] or []):
            want.setdefault((r["chunk_id"], len(r["w"])), {}).setdefault(w, []).append(place)
    vocabulary = {w for x in want.values() for w in x}
    assert decoded(indexed, sorted(vocabulary)) == want
    assert {(r["token"], r["df"], r["cf"]) for r in indexed.words().collect()} == {(w, sum(w in x for x in want.values()), sum(len(x.get(w, ())) for x in want.values())) for w in vocabulary}
    assert indexed.segments().count() > 5
    assert sorted(i for r in indexed.segments().collect() for i in r["ids"]) == sorted(str(i) for i, _ in texts)


QUERIES = [
    "boat", "boat river", "boat | oars", "boat -river", "-river boat", "(boat OR rivers) -oars", '"boat"', '"oat"', '"at, ri"', '"river oars"', '"r oar"', '"Boat river" | x-ray', 'boat -"river oars"',
    '~"boats rivers"', '~"river boat"', '~"oars"', "lang:en rivers", "lang:ru елка", "lang:ru ёлка", 'lang:ru ~"елка boat"', "nowhere", 'boat -nowhere', '"nowhere at all"', '"?"', '"ΟΔΟΣ"', "straße", "_a 7", "i̇x",
]


def rows(df):
    return sorted((r["chunk_id"], round(r["merged_score"], 9), r["priority"], r["reasons"], tuple(map(str, r["contributions"])), r["match_span"]) for r in df.collect())


@pytest.mark.parametrize("query", QUERIES)
def test_queries_equal_the_scan(spark, texts, indexed, query):
    c = made(spark, texts)
    scan, index = (compile_query(c, query, sparse_terms=True, index=i) for i in (None, indexed))
    assert rows(index.candidates) == rows(scan.candidates)
    if len(query) > 12:
        assert sorted(map(tuple, index.explain().collect())) == sorted(map(tuple, scan.explain().collect()))
    # the texts' tokens aren't computed
    assert ("regexp_extract_all" in index.matched._jdf.queryExecution().optimizedPlan().toString()) == (query in ('"?"', '"ΟΔΟΣ"'))


def test_some_of_the_queries_find_something_and_not_all(spark, texts, indexed):
    counts = [compile_query(made(spark, texts), q, index=indexed).candidates.count() for q in QUERIES]
    assert sum(0 < n < 250 for n in counts) > 15


def test_filters_and_phrases_of_common_pieces(spark, texts, indexed, monkeypatch):
    c = made(spark, texts).withColumn("language", F.when(F.col("chunk_id").cast("int") % 2 == 0, "en").otherwise("de"))
    f = FI.Filters(language="en")
    want = rows(compile_query(c, '"r oar" | boat', f=f).candidates)
    assert want and rows(compile_query(c, '"r oar" | boat', f=f, index=indexed).candidates) == want
    monkeypatch.setattr(SK, "MOST_WORDS", 1)
    assert rows(compile_query(c, '"r oar" | boat', f=f, index=indexed).candidates) == want


RUSSIAN = ["улица", "сад", "сад | роза", "улица -ремонт", '"узкой улице"', '~"узкая улица"', '~"улица узкая"', "(сад OR ель) -мельница", "зелёная", "~улица играли", "тихое озеро"]


def test_russian_queries_equal_a_plain_walk(spark, tmp_path):
    town = FI.scope(chunks(spark, TOWN), "town", "first").cache()
    for languages in ((), ("ru",)):
        path = f"{tmp_path}/{len(languages)}"
        P.put(town, path, languages)
        index = P.Index(spark, path, "town", "first")
        for q in RUSSIAN:
            assert sorted(r["chunk_id"] for r in compile_query(town, q, "ru", index=index).candidates.collect()) == plain_answer(TOWN, q, "ru"), q


def scanned(df):
    """Rows that the scans of a plan gave out, after it ran."""
    df.collect()
    nodes, out = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        x = nodes.pop()
        if x.nodeName().startswith("AdaptiveSparkPlan"):
            nodes.append(x.executedPlan())
        elif x.nodeName().startswith("Scan parquet"):
            out += x.metrics().apply("numOutputRows").value()
        else:
            nodes += [x.children().apply(i) for i in range(x.children().size())]
            if "QueryStage" in x.nodeName():
                nodes.append(x.plan())
    return out


def test_only_the_row_groups_of_the_words_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "ROW_GROUP_BYTES", 16 << 10)
    texts = [(i, " ".join(f"w{(i * 37 + k) % 20000:05d}" for k in range(40))) for i in range(1000)]
    P.put(made(spark, texts), str(tmp_path))
    index = P.Index(spark, str(tmp_path), "p", "s")
    whole = spark.read.parquet(f"{tmp_path}/blocks").count()
    one = index.blocks(["w00037"])
    assert one.count() and scanned(one.select("lists")) < whole / 20
    few = index.blocks([f"w{k:05d}" for k in (*range(6), *range(15000, 15006))])
    assert few.count() >= 12 and scanned(few.select("lists")) < whole / 8


def test_an_index_takes_little_besides_its_lists(spark, tmp_path):
    """No shuffle of the blocks, Bloom filters in proportion to their row groups, no lemmas that nobody reads."""
    texts = [(i, " ".join(f"w{(i * 37 + k) % 20000:05d}" for k in range(40))) for i in range(1000)]
    c = made(spark, texts)
    P.put(c, str(tmp_path), ["", "xx"])
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 4 << 20
    assert not (tmp_path / "lemmas").exists() and P.Index(spark, str(tmp_path), "p", "s").words().count() == len({w for _, t in texts for w in t.split()})
    few = len(list((tmp_path / "blocks").rglob("*.parquet")))
    assert few == P.BUCKETS * c.rdd.getNumPartitions()  # each task's own


def test_order_of_codes(monkeypatch):
    rnd = np.random.default_rng(3)
    for most in (1, 1 << 16, 1 << 20, 1 << 31):
        codes = rnd.integers(0, most, 5000).astype(np.int32)
        assert P._order(codes).tolist() == np.argsort(codes, kind="stable").tolist()
    assert len(P._order(codes[:0])) == 0


def test_empty_table(spark, tmp_path):
    P.put(made(spark, []), str(tmp_path), ["en"])
    index = P.Index(spark, str(tmp_path), "p", "s")
    assert index.words().count() == index.segments().count() == 0
    assert compile_query(made(spark, []), '"a b" OR ~"c d" OR e', "en", index=index).candidates.count() == 0
    assert R.top(index, "a b").count() == 0 and R.cover_density(index, "a b").count() == 0


def score(words, tokens):
    return sum(float(x) for x in [tokens.count(w) / (1 + np.log(len(tokens))) for w in words]) if tokens else 0.0


@pytest.mark.parametrize("query", ["boat river", "BOAT", "ёлка x-ray 7", "boat nowhere"])
def test_top_equals_scoring_everything(spark, texts, indexed, query, monkeypatch):
    words = R.query_words(query)
    each = {r["chunk_id"]: r["w"] or [] for r in made(spark, texts).select("chunk_id", X.tokens(F.col("text")).alias("w")).collect()}
    want = [(round(-x, 9), i) for x, i in sorted((-round(score(words, w), 9), i) for i, w in each.items() if all(x in w for x in words))]
    for first, limit in ((16, 20), (1, 5), (2, 1), (1, 10_000)):
        monkeypatch.setattr(R, "FIRST_SEGMENTS", first)
        got = [(round(r["raw"], 9), r["chunk_id"]) for r in R.top(indexed, query, limit).collect()]
        assert got == want[:limit]


def test_blocks_that_cannot_reach_the_bar_are_not_read(spark, tmp_path, monkeypatch):
    """200 segments of 10 chunks; in a few of them the words stand more often."""
    rnd = random.Random(2)
    texts = [(i, " ".join(["red", "blue"] * (1 + 6 * (i // 10 in (17, 90, 91)) * rnd.randint(1, 3)) + ["x"] * rnd.randint(20, 60))) for i in range(2000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        P.put(made(spark, texts).coalesce(1), str(tmp_path))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    index = P.Index(spark, str(tmp_path), "p", "s")
    blocks = index.blocks(["red", "blue"]).count()
    monkeypatch.setattr(R, "FIRST_SEGMENTS", 2)
    read = R.reaching(index, ["blue", "red"], 25).count()
    assert blocks == 400 and read <= 12
    want = sorted((-round(score(["blue", "red"], t.split()), 9), str(i)) for i, t in texts)[:25]
    assert [(round(r["raw"], 9), r["chunk_id"]) for r in R.top(index, "red blue", 25).collect()] == [(round(-x, 9), i) for x, i in want]


def brute_covers(tokens, words):
    """All stretches that hold all words, those out that hold another."""
    at = [i for i, w in enumerate(tokens) if w in words]
    whole = [(a, b) for a in at for b in at if a <= b and set(words) <= set(tokens[a : b + 1])]
    return [(a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole)]


def test_cover_density_equals_brute_force(spark, texts, indexed):
    for query in ("boat river", "oars", "boat river x-ray", "boat nowhere"):
        words = R.query_words(query)
        want = {}
        for r in made(spark, texts).where("chunk_id <> '903'").select("chunk_id", X.tokens(F.col("text")).alias("w")).collect():
            if found := brute_covers(r["w"] or [], words):
                want[r["chunk_id"]] = (len(found), round(sum(len(words) / (b - a + 1) for a, b in found), 9))
        got = {r["chunk_id"]: (r["covers"], round(r["raw"], 9)) for r in R.cover_density(indexed, query).where("chunk_id <> '903'").collect()}
        assert got == want
    best = R.top(indexed, "boat", 1, "close").first()
    assert (best["chunk_id"], best["raw"]) == ("903", 5000.0)
    with pytest.raises(ValueError):
        R.top(indexed, "boat", 1, "else")


def test_index_files_are_zstd(spark, tmp_path):
    c = spark.createDataFrame([("p", "s", "c0", "a b a"), ("p", "s", "c1", "b")], "project_id string, snapshot_id string, chunk_id string, text string")
    P.put(c, str(tmp_path))
    found = sorted(tmp_path.rglob("*.parquet"))
    assert found and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in found} == {"ZSTD"}

import math
import random
import re

import pytest
from fixtures import MARKS, TOWN, at, chunks, plain_answer
from pyspark.sql import functions as F

from trailhead.functions import languages as L
from trailhead.functions import vectors as V
from trailhead.operators import filters as FI
from trailhead.operators import merge as M
from trailhead.operators import retrieve as R
from trailhead.plans.compile import compile_query


@pytest.fixture(scope="module")
def town(spark):
    return FI.scope(chunks(spark, TOWN), "town", "first").cache()


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def hybrid(c, term, language="en", f=FI.Filters(), **how):
    return R.hybrid(c, [term, *L.adapter(language).expand(term)], 20, f, **how)


def asked(c, text, language="ru", **how):
    return ids(compile_query(c, text, language, **how).candidates)


def test_searches(town):
    e = town.select("chunk_id", V.embed(F.col("text"), "rune").alias("embedding"))
    texts = {c: t for c, _, t, *_ in TOWN}
    assert set(ids(R.exact(town, "boats"))) == {c for c, t in texts.items() if "boats" in t}
    assert ids(R.sparse(town, "Bridge runners"))[0] == "race"
    assert ids(R.dense(e, V.rune_embedding(texts["quay"])))[0] == "quay"
    assert ids(hybrid(town, "running")) == ["race"] and ids(R.exact(town, "running")) == []
    french = ids(hybrid(town, "pont", f=FI.Filters(language="fr")))
    assert french == ["course"]
    one = FI.Filters(**{f"{k}_id": MARKS[f"{k}_ids"][0] for k in ("sense", "concept", "attestation")}, **{k: v for k, v in MARKS.items() if not k.endswith("_ids")})
    assert set(ids(hybrid(town, "boats", f=one))) == {"quay", "hull"} and ids(hybrid(town, "grain", f=one)) == []
    morning = FI.Filters(window=FI.Window(at(9), at(9, 30)))
    assert ids(hybrid(town, "alarm", f=morning)) == ["alarm"]
    assert {"lane", "repair"} <= set(ids(hybrid(town, "улица", "ru")))


def test_sense_filter_leaves_its_reason(town):
    out = M.scored(R.exact(town, "boats", FI.Filters(sense_id="hull"))).collect()
    assert {r["chunk_id"] for r in out} == {"quay", "hull"} and all(r["reasons"] == ["exact_phrase", "sense_filter"] for r in out)
    assert ids(R.exact(town, "boats", FI.Filters(graph_node_id="any"))) == ids(R.exact(town, "boats"))
    assert ids(R.exact(town, "  ")) == []


QUERIES = ["улица", "сад", "птица", "сад | роза", "улица -ремонт", '"узкой улице"', '~"узкая улица"', '~"улица узкая"', "(сад OR ель) -мельница", "зелёная", "~улица играли", "тихое озеро"]


@pytest.mark.parametrize("text", QUERIES)
def test_queries_equal_a_plain_walk(town, text):
    assert sorted(asked(town, text)) == plain_answer(TOWN, text, "ru")


def test_the_queries_find_something_and_not_all(town):
    answers = {q: plain_answer(TOWN, q, "ru") for q in QUERIES}
    assert answers["улица"] == ["lane", "repair"] and answers['~"узкая улица"'] == ["lane"] and answers['~"улица узкая"'] == []
    assert answers["зелёная"] == ["spruce"] and "roses" not in answers["сад"] and sum(map(bool, answers.values())) >= 9


def test_query_scores_snippets_and_explain(town):
    plan = compile_query(town, "улица играли", "ru")
    (r,) = plan.candidates.collect()
    assert r["chunk_id"] == "lane" and [c["retriever"] for c in r["contributions"]] == ["term", "term"]
    assert r["merged_score"] == pytest.approx(sum(c["weight"] * c["norm"] for c in r["contributions"]))
    span = r["match_span"]
    assert r["text"].encode()[span["start"] : span["end"]].decode() in ("улице", "играли")
    counts = [(x["kind"], x["matches"]) for x in plan.explain().orderBy("leaf").collect()]
    assert counts == [("term", len(plain_answer(TOWN, w, "ru"))) for w in ("улица", "играли")]
    assert plan.canonical == "(AND улица играли)"
    # without a language words are only lower-cased
    assert ids(compile_query(town, "улица", "").candidates) == plain_answer(TOWN, "улица", "") == ["repair"]
    m = compile_query(town, '~"узкая улица"', "ru").candidates.first()
    assert m["text"].encode()[m["match_span"]["start"] : m["match_span"]["end"]].decode() == "узкой улице"
    assert m["reasons"] == ["lemma_match", "morph_phrase"]
    refused = compile_query(town, "улица", "ru", rejected=["улице"])
    assert "улице" in refused.leaves[0].rejected and ids(refused.candidates) == ["repair"]


def test_sparse_terms_add_a_contribution(town):
    plain, more = (compile_query(town, "quay", "en", sparse_terms=x).candidates.first() for x in (False, True))
    assert [c["retriever"] for c in plain["contributions"]] == ["term"] and [c["retriever"] for c in more["contributions"]] == ["term", "sparse"]
    assert more["merged_score"] == plain["merged_score"]


def test_query_is_one_scan(spark, tmp_path, town):
    town.write.parquet(f"{tmp_path}/c")
    c = spark.read.parquet(f"{tmp_path}/c")
    plan = compile_query(c, '(run OR "the park") -bank', "en").candidates._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan and "Python" not in plan


def test_tombstones(spark):
    c = FI.scope(chunks(spark, TOWN, tombstoned=("quay",)), "town", "first")
    assert ids(R.exact(c, "boats")) == ["hull"]
    gone = spark.createDataFrame([("w5",)], "source_id string")
    assert ids(R.exact(FI.without_tombstones(c, gone), "boats")) == []


def test_merge_and_normalise(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 5.0)], "chunk_id string, raw double")
    assert [r["norm"] for r in M.normalize(df).orderBy("chunk_id").collect()] == [0, 0.5, 1]
    assert {r["norm"] for r in M.normalize(df.withColumn("raw", F.lit(2.0))).collect()} == {0}
    one = spark.createDataFrame([("x", "s", 0, 5, "k")], "chunk_id string, source_id string, span_start long, span_end long, text_checksum string")
    parts = one.withColumns({"contributions": F.array(M.contribution("exact", F.lit(1), F.lit(1), [])), "place": F.lit(0)}).unionByName(
        one.withColumns({"contributions": F.array(M.contribution("sparse", F.lit(1), F.lit(1), [])), "place": F.lit(1)})
    )
    r = M.merge(parts).collect()
    assert len(r) == 1 and r[0]["merged_score"] == 1.75 and r[0]["priority"] == 0 and len(r[0]["contributions"]) == 2


def test_sparse_cuts_before_it_filters(town):
    assert ids(R.sparse(town, "boats pont", limit=1, f=FI.Filters(language="ru"))) == []


def test_full_text(town):
    hits = R.full_text(R.postings(town), "Boats boats").collect()
    assert [r["chunk_id"] for r in hits] == ["hull", "quay"]
    assert [r["raw"] for r in hits] == [pytest.approx(1 / (1 + math.log(n))) for n in (1, 6)]


def test_overlap_join_equals_all_pairs(spark):
    import random

    rnd = random.Random(3)
    rows = [[(i, at(rnd.randrange(20), rnd.randrange(60)), rnd.randrange(1, 300)) for i in range(60)] for _ in range(2)]
    made = [spark.createDataFrame(r, "id long, start timestamp, m int").select("id", "start", (F.col("start") + F.expr("make_interval(0,0,0,0,0,m)")).alias("end")) for r in rows]
    got = {(r["l_id"], r["r_id"]) for r in FI.overlap_join(*made).collect()}
    from datetime import timedelta

    want = {(a, b) for a, s, m in rows[0] for b, t, n in rows[1] if s < t + timedelta(minutes=n) and t < s + timedelta(minutes=m)}
    assert got == want and FI.overlap_join(*made).count() == len(want)


def united(chunks, terms, limit, f, dense_hits):
    """The same by a scan for each term and retriever."""
    parts = [x for t in terms for x in (R.exact(chunks, t, f), R.sparse(chunks, t, limit, f))]
    if dense_hits is not None:
        parts.append(R.of_hits(chunks, dense_hits, "dense", ["dense_similarity"], f))
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("place", F.struct(F.lit(i), "chunk_id"))
        out = p if out is None else out.unionByName(p)
    return M.merge(out, keep=("chunk_id", "trust_level"))


@pytest.mark.parametrize("limit", [1, 3, 20])
def test_hybrid_reads_once_and_equals_a_scan_for_each(spark, limit):
    import random

    rnd = random.Random(limit)
    rows = [(f"c{rnd.randrange(10**6):06}", f"s{i % 7}", i, i + 9, " ".join(rnd.choice(["river", "Bank", "bank", "boat", "x"]) for _ in range(6)), f"k{i % 50}", "project", rnd.choice(["en", "de"])) for i in range(150)]
    c = spark.createDataFrame(rows, "chunk_id string, source_id string, span_start int, span_end int, text string, text_checksum string, trust_level string, language string")
    hits = c.orderBy("chunk_id").limit(9).select("chunk_id", F.col("span_start").cast("double").alias("raw"))
    whole = lambda df: sorted((tuple(map(str, r)) for r in df.select("chunk_id", "trust_level", *M.KEY, "contributions", F.round("merged_score", 9), "priority", "reasons").collect()))
    for f in (FI.Filters(), FI.Filters(language="en")):
        for terms, dense in ((["river bank", "boat"], None), (["Bank river x", "nowhere", " "], hits), ([" "], hits)):
            got = R.hybrid(c, terms, limit, f, dense_hits=dense)
            assert whole(got) == whole(united(c, terms, limit, f, dense))
    assert R.hybrid(c, ["river"], limit, rejected=["river"]).count() == 0
    plan = R.hybrid(c, ["river bank", "boat", "x"], limit)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "WindowGroupLimit" in plan


def test_dyadic_covers_are_short_and_hold_each_cell_once(spark):
    import random

    rnd = random.Random(1)
    rows = [(a, a + n) for a in (0, 1, 7, -5, -64, 12345, -(1 << 30)) for n in (1, 2, 3, 8, 31, 100)] + [(a := rnd.randrange(-(1 << 24), 1 << 24), a + rnd.randrange(1, 1 << 25)) for _ in range(40)]
    found = spark.createDataFrame(rows, "a long, b long").withColumn("x", FI.dyadic_cover(F.col("a"), F.col("b"))).collect()
    for r in found:
        runs = sorted((x["node"] << x["level"], (x["node"] + 1) << x["level"]) for x in r["x"])
        assert runs[0][0] == r["a"] and runs[-1][1] == r["b"] and all(p[1] == q[0] for p, q in zip(runs, runs[1:]))
        assert len(runs) <= max(1, 2 * math.log2(r["b"] - r["a"]))


@pytest.mark.parametrize("cell_s", [1, 60, 86400])
def test_overlap_join_of_ranges_from_seconds_to_decades(spark, cell_s):
    import random
    from datetime import datetime, timedelta

    rnd = random.Random(cell_s)
    start = datetime(1960, 1, 1)
    length = lambda: timedelta(seconds=rnd.choice([0, 0.000001, 1, 50, 3600, 90_000, 10**7, 8 * 10**8, -5]))
    side = lambda: [(i, s := start + timedelta(seconds=rnd.choice([0, 60, 86400, rnd.randrange(10**9)])), s + length()) for i in range(70)]
    rows = side(), side()
    a, b = (spark.createDataFrame([*r, (99, None, start), (98, start, None)], "id long, start timestamp, end timestamp") for r in rows)
    want = sorted((x, y) for x, s, e in rows[0] for y, t, u in rows[1] if s < u and t < e and s < e and t < u)
    got = sorted((r["l_id"], r["r_id"]) for r in FI.overlap_join(a, b, cell_s).collect())
    assert got == want and len(want) > 100
    assert FI.overlap_join(a.limit(0), b).count() == FI.overlap_join(a, b.limit(0)).count() == 0


def test_postings_are_counted_without_a_shuffle(spark):
    rnd = random.Random(5)
    rows = [("p", "s", f"c{i}", " ".join(rnd.choice(["a", "Bb", "bb", "c-c", "ß"]) for _ in range(rnd.randrange(9)))) for i in range(60)] + [("p", "s", "none", None), ("p", "s", "bare", " .,")]

    def plain(rows):
        out = {}
        for _, _, chunk, text in rows:
            for w in re.findall(r"[\w-]+", (text or "").lower()):
                out[w, chunk] = out.get((w, chunk), 0) + 1
        return out

    def found(rows):
        return R.postings(spark.createDataFrame(rows, "project_id string, snapshot_id string, chunk_id string, text string").repartition(3))

    once = found(rows)
    assert "Exchange hash" not in once._jdf.queryExecution().executedPlan().toString()
    got = once.collect()
    assert {(r["token"], r["chunk_id"]): r["tf"] for r in got} == plain(rows) and len(got) == len(plain(rows))
    assert {r["chunk_id"]: r["n_tokens"] for r in got} == {c: len(t.split()) for _, _, c, t in rows if t and c != "bare"}
    # ids that are there twice, and null ones, are put together
    again = [*rows, *rows[:20], ("p", "s", None, "a a"), ("p", "s", None, "a b")]
    got = found(again).collect()
    assert {(r["token"], r["chunk_id"]): r["tf"] for r in got} == plain(again) and len(got) == len(plain(again))

import hashlib
import random

from pyspark.sql import functions as F

from trailhead import catalogue
from trailhead.operators import pack as K

SCHEMA = "pack_id string, id string, class string, trust_level string, source_id string, span_start long, span_end long, checksum string, surface string, score double, required boolean, place long"


def drafts(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = dict(pack_id="k", id=f"i{i}", trust_level="project", source_id=f"s{i}", span_start=0, required=False, surface="text", score=0.5, place=i) | {"class": "source_text"} | r
        d.setdefault("checksum", hashlib.sha256(d["surface"].encode()).hexdigest())
        d.setdefault("span_end", len(d["surface"].encode()))
        full.append(tuple(d[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(full, SCHEMA)


def one(spark, rows, **budget):
    return K.select(drafts(spark, rows), K.Budget(**budget)).first()


def test_budget_trims_optional_items(spark):
    r = one(spark, [dict(id="req", score=0.1, required=True), dict(id="opt1", score=0.9), dict(id="opt2", score=0.8)], max_items=2, max_chars=100, instructions=("do it",))
    assert [x["id"] for x in r["evidence"]] == ["req", "opt1"] and [(x["item"]["id"], x["reason"]) for x in r["rejected"]] == [("opt2", "budget_trim")]


def test_a_later_smaller_item_may_fit(spark):
    r = one(spark, [dict(id="a", surface="x" * 6, score=0.9), dict(id="b", surface="y" * 9, score=0.8), dict(id="c", surface="é" * 2, score=0.1)], max_chars=10)
    assert [x["id"] for x in r["evidence"]] == ["a", "c"] and r["used_bytes"] == 10


def test_required_item_too_large(spark):
    r = one(spark, [dict(surface="x" * 50, required=True), dict(surface="y")], max_items=1, max_chars=10)
    assert r["error"] == "budget_exhausted_required"


def test_gates_and_floor(spark):
    rows = [{"class": "policy", "id": "p"}, dict(id="q", trust_level="quarantined"), dict(id="u", trust_level="untrusted"), dict(id="low", surface="z" * 90, score=0.2), dict(id="ok")]
    r = one(spark, rows, max_chars=20)
    assert [x["id"] for x in r["evidence"]] == ["ok"]
    assert {x["item"]["id"]: x["reason"] for x in r["rejected"]} == {"p": "instruction_or_policy_not_evidence", "q": "quarantined", "u": "trust_below_required"}


def test_duplicates(spark):
    same = dict(source_id="s", checksum="k", span_end=4)
    r = one(spark, [dict(id="x", score=0.9, **same), dict(id="y", score=0.1, required=True, **same), dict(id="z", score=0.5)])
    assert [x["id"] for x in r["evidence"]] == ["y", "z"]


def test_instructions_may_take_all(spark):
    assert one(spark, [dict()], max_chars=4, instructions=("abcdef",))["evidence"] == []
    assert len(one(spark, [dict()], max_chars=8, instructions=("abcdef",), instruction_reserve=4)["evidence"]) == 1
    assert one(spark, [dict()], max_tokens=1)["evidence"][0]["id"] == "i0"


def test_greedy_equals_a_plain_loop(spark):
    rnd = random.Random(4)
    rows = [dict(pack_id=f"k{rnd.randrange(6)}", surface="w" * rnd.randrange(1, 40), score=rnd.random(), required=rnd.random() < 0.05) for _ in range(200)]
    got = {r["pack_id"]: r for r in K.select(drafts(spark, rows), K.Budget(max_items=6, max_chars=120)).collect()}
    for k, r in got.items():
        mine = sorted((not d["required"], -d["score"], i, d) for i, d in enumerate(rows) if d["pack_id"] == k)
        taken, used, error = [], 0, None
        for later, _, i, d in mine:
            fits = len(taken) < 6 and used + len(d["surface"]) <= 120
            if fits:
                taken.append(f"i{i}")
                used += len(d["surface"])
            elif not later:
                error = "budget_exhausted_required"
                break
        assert (r["error"] or [x["id"] for x in r["evidence"]]) == (error or taken)


def test_checksum_flags_and_replay(spark):
    rows = [dict(id="a"), {"id": "b", "class": "sense_claim"}, {"id": "c", "class": "concept_mapping"}, {"id": "d", "class": "model_inference"}, {"id": "e", "checksum": ""}, dict(id="f", source_id="")]
    packs = K.select(drafts(spark, rows), K.Budget())
    packs = packs.withColumn("checksum", K.checksum(F.col("evidence"), F.col("rejected"), F.col("pack_id"), "p", "plan"))
    r = packs.first()
    body = "".join("\0".join([x["id"], x["class"], x["trust_level"], x["source_id"], f"{x['span_start']}:{x['span_end']}", x["checksum"], x["surface"]]) + "\0" for x in r["evidence"])
    assert r["checksum"] == hashlib.sha256(f"trailhead/evidence-pack/v1\0k\0p\0\0plan\0\0chars-div4-v1\0{body}".encode()).hexdigest()
    claimed = F.array(*map(F.lit, "bcd"))
    found = packs.select(K.flags(F.col("evidence"), F.col("checksum"), F.lit("other"), claimed).alias("f")).first()["f"]
    assert {(x["code"], x["evidence_id"]) for x in found} == {
        ("pack_checksum_mismatch", None), ("unsupported_sense_as_fact", "b"), ("unsupported_concept_as_fact", "c"),
        ("unsupported_model_inference_as_fact", "d"), ("missing_checksum", "e"), ("missing_source_ref", "f"),
    }
    good = packs.select(K.flags(F.col("evidence"), F.col("checksum"), F.col("checksum"), claimed, F.array(F.lit("b"))).alias("f")).first()["f"]
    assert "b" not in {x["evidence_id"] for x in good}
    sum_of = hashlib.sha256(b"text").hexdigest()
    store = spark.createDataFrame([("s0", sum_of, "text"), ("s1", sum_of, "altered")], "source_id string, checksum string, surface string")
    assert {r["id"]: r["ok"] for r in K.replay(packs, store).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False}


def plain_packs(rows, items, chars):
    """pack: [(id, used after)] by a plain loop over (pack, id, score, text)."""
    out = {}
    for pack, i, _, text in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        taken = out.setdefault(pack, [])
        used = taken[-1][1] if taken else 0
        if len(taken) < items and used + len(text.encode()) <= chars:
            taken.append((str(i), used + len(text.encode())))
    return out


def test_registered_packs_read_every_document(spark, tmp_path):
    rnd = random.Random(3)
    docs = [(i, "é" * rnd.randrange(1, 900), rnd.choice(["en", "en", "de"]), "s") for i in rnd.sample(range(3000), 1500)] + [(5000, "x" * 5000, "fr", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_packs([(lang, i, (i * 7919) % 1000 / 1000, text) for i, text, lang, _ in docs], 8, 4000)
    got = {}
    for r in catalogue.pack_greedy(spark, str(tmp_path)).collect():
        got.setdefault(r["pack_id"], []).append((r["id"], r["used_after"]))
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert any(int(i) >= 400 for v in want.values() for i, _ in v)
    assert {r["pack_id"] for r in catalogue.verify_flags(spark, str(tmp_path)).collect()} == {"en", "de", "fr"}
    assert {r["pack_id"]: r["n_ok"] for r in catalogue.pack_replay(spark, str(tmp_path)).collect()} == {k: len(v) for k, v in want.items() if v}
    assert {r["pack_id"] for r in catalogue.pack_checksum(spark, str(tmp_path)).collect()} == {"en", "de"}


def test_few_drafts_of_a_large_pack_meet():
    rnd = random.Random(9)
    for _ in range(60):
        # ranks repeat, sizes too
        rows = [(rnd.choice("ab"), rnd.randrange(40) / 40, i, rnd.randrange(1, 60)) for i in range(400)]
        items, chars = rnd.choice([(3, 90), (8, 0), (0, 100), (5, 400)])
        left = K._survivors([(p, -s, i, n) for p, s, i, n in rows], K.Budget(max_items=items, max_chars=chars))
        some = [(p, i, s, "x" * n) for p, s, i, n in (rows[k] for k in left)]
        every = [(p, i, s, "x" * n) for p, s, i, n in rows]
        assert plain_packs(some, items or 10**9, chars or 10**9) == plain_packs(every, items or 10**9, chars or 10**9)
        assert len(left) < len(rows) / 2


def test_rejections_are_rows_and_texts_stay_out_of_python(spark):
    rnd = random.Random(8)
    kinds = [{}] * 8 + [{"class": "policy"}, dict(trust_level="untrusted"), dict(trust_level="quarantined")]
    rows = [dict(pack_id=f"k{rnd.randrange(5)}", surface="w" * rnd.randrange(1, 40), score=rnd.randrange(10) / 10, required=rnd.random() < 0.04) | rnd.choice(kinds) for _ in range(300)]
    # two packs of 40 copies each among them, and one that takes nothing
    rows += [rows[0] | dict(source_id="same", score=rnd.random()) for _ in range(40)] + [dict(pack_id="none", surface="x" * 500)]
    given, budget = drafts(spark, rows).repartition(7), K.Budget(max_items=5, max_chars=90, reject_floor=0.3)
    packs = K.select(given, budget)
    # what the Arrow function is given
    line = next(x for x in packs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x)
    assert "score" in line and "surface" not in line
    listed = {r["pack_id"]: [(x["item"]["id"], x["reason"]) for x in r["rejected"]] for r in packs.collect()}
    assert listed["none"] == [("i340", "budget_trim")]
    each = {}
    for r in K.rejections(given, budget).collect():
        each.setdefault(r["pack_id"], []).append((r["id"], r["reason"]))
    assert {k: sorted(v) for k, v in each.items()} == {k: sorted(v) for k, v in listed.items() if v}
    assert {why for v in listed.values() for _, why in v} == {"budget_trim", "trust_below_required", "quarantined", "instruction_or_policy_not_evidence"}
    # the list by a plain loop over distinct drafts
    for pack, got in listed.items():
        best, place = {}, {}
        for i, r in enumerate(rows):
            key = (r.get("source_id", f"s{i}"), len(r["surface"]), r["surface"])
            if r["pack_id"] == pack:
                place.setdefault(key, i)
                score, required = r.get("score", 0.5), r.get("required", False)
                best[key] = max(best.get(key, (False, -1.0, 0)), (required, score, -i))
        taken, used, gates, trims = 0, 0, [], []
        for required, score, n in sorted(best.values(), key=lambda x: (not x[0], -x[1], place[(rows[-x[2]].get("source_id", f"s{-x[2]}"), len(rows[-x[2]]["surface"]), rows[-x[2]]["surface"])])):
            r, size = rows[-n], len(rows[-n]["surface"])
            gate = "instruction_or_policy_not_evidence" if r.get("class") == "policy" else {"quarantined": "quarantined", "untrusted": "trust_below_required"}.get(r.get("trust_level"))
            if gate:
                gates.append((f"i{-n}", gate))
            elif taken < 5 and used + size <= 90:
                taken, used = taken + 1, used + size
            elif required:
                break
            elif score >= 0.3:
                trims.append((f"i{-n}", "budget_trim"))
        assert got == gates + trims

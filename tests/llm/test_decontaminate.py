import hashlib
import random
import re

from pyspark.sql import functions as F

from trailhead.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width=13):
    w, hit, ids = tokens(text), set(), set()
    for name, t in items:
        it = tokens(t)
        size = min(width, len(it))
        if name is None or not size:
            continue
        windows = {tuple(it[i : i + size]) for i in range(len(it) - size + 1)}
        for p in range(len(w) - size + 1):
            if tuple(w[p : p + size]) in windows:
                hit.update(range(p, p + size))
                ids.add(str(name))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    vocab = ["a", "the", "B", "cé", "d7", "EE", "f", "中文", "g", "h"]
    say = lambda n: rnd.choice([" ", ", ", "--"]).join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice([0, 1, 2, 3, 5, 12, 13, 14, 40]))) for i in range(40)]
    items += [(100, items[5][1]), (5, say(20)), (None, "a the"), (101, None), (102, "rare word"), (7, "x\x00y")]
    docs = []
    for d in range(150):
        parts = [say(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            w = (rnd.choice(items)[1] or "").split(" ")
            a = rnd.randrange(len(w))
            parts += [" ".join(w[a : a + rnd.choice([5, 13, 50])]), say(rnd.randint(0, 9))]
        docs.append((d, " ".join(parts)))
    docs += [(900, None), (901, ""), (902, docs[3][1]), (902, docs[3][1]), (903, say(40000)), (904, "nothing here matches\xa0rare word")]
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, *brute(t, items)) for d, t in docs)
    for chars in (dc.SHARD_CHARS, 400):
        out = dc.find(table, bench, keep=["doc_id"], shard_chars=chars).select("doc_id", *dc.digests())
        assert sorted(map(tuple, out.collect())) == want
    assert sum(r[5] for r in want) > 10


def test_hits_are_ranges_of_words(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[3:20]) + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    r = dc.find(docs, bench).first()
    assert [(h["start"], h["end"]) for h in r["hits"]] == [(2, 19)] and r["items"] == ["9"] and r["n_words"] == 20


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.find(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert dc.find(one, bench).select(F.size("items"), "n_words").first() == (0, 2)

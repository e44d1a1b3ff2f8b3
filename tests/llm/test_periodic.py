import hashlib
import random

import pytest

from trailhead.llm import periodic, queries


def brute(w, least=12):
    """By the definition: every interval of every period that can't be extended, the smallest period of each."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(least, 2 * q):
                best.setdefault((start, end), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def drops(w, found):
    return {i for s, n, q in found for i in range(s + q, s + n)}


def texts(seed, many):
    rnd = random.Random(seed)
    for _ in range(many):
        letters = "abcdefgh"[: rnd.choice((1, 2, 2, 3, 8))]
        w = [rnd.choice(letters) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            piece = [rnd.choice(letters) for _ in range(rnd.randint(1, 12))]
            at = rnd.randint(0, len(w))
            w[at:at] = (piece * 6)[: rnd.randint(1, 5 * len(piece))]
        yield w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_equals_brute_force(least):
    for w in texts(least, 1500):
        assert periodic.runs(w, least) == brute(w, least), w


def test_z_values():
    assert periodic.z_values([1, 1, 2, 1, 1, 2, 1], 7) == [7, 1, 0, 4, 1, 0, 1]


def test_a_long_text_of_one_word_and_long_periods():
    assert periodic.runs(["a"] * 20_000) == [(0, 20_000, 1)]
    w = [str(i) for i in range(5000)]
    assert periodic.runs(w) == [] and periodic.runs(w + w) == [(0, 10_000, 5000)]
    assert periodic.runs(w + w[:-1]) == []
    assert periodic.runs(["x", *w, *w, *w[:7], "y"]) == [(1, 10_007, 5000)]


def test_columns_nulls_white_space_repeats_and_clashing_names(spark):
    twelve = " ".join(["a b"] * 6)
    rows = [(1, None), (2, ""), (3, twelve), (3, twelve), (None, " x " * 12), (5, "a\x1cb " * 11), (6, " \t a\x0bb \r\n\x0c" + "c " * 13 + "d")]
    docs = spark.createDataFrame([(*r, "old", 7) for r in rows], "doc_id long, text string, Runs string, start int")
    out = [r.asDict() for r in periodic.find(docs, keep=["doc_id", "text", "Runs", "start"]).collect()]
    assert len(out) == 7 and list(out[0]) == ["doc_id", "text", "start", "runs", "collapsed"]
    for r in out:
        w = (r["text"] or "").encode().split()
        assert [tuple(x) for x in r["runs"]] == brute(w)
        gone = drops(w, brute(w))
        assert r["collapsed"] == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        assert r["start"] == 7
    assert [len(r["runs"]) for r in out] == [0, 0, 1, 1, 1, 0, 1]
    assert periodic.find(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find(docs, least=1)


def test_query_equals_brute_force(spark, tmp_path):
    import zlib

    rows = [(i, " ".join(w)) for i, w in enumerate(texts(5, 150))] + [(900, None), (901, ""), (None, "z " * 20), (7, "z " * 20), (902, "a b  " + "q w e " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op13_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").fillna(-1).collect())
    want, planted = [], 0
    for i, text in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            planted += 1
        found = brute(w)
        top = min(((-m, s, q) for s, m, q in found), default=None)
        four = (top[1], -top[0], top[2], -1000 * top[0] // top[2]) if top else (-1,) * 4
        gone = drops(w, found)
        want.append((-1 if i is None else i, len(found), *four, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
                     hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert planted > 5 and got == sorted(want)

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailhead.llm import substrings


def brute(rows, length=100):
    """rows in order of place."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = ["the", "of", "über", "a", "b", "thing", "sch", "\n", "xyz", "0"]
    say = lambda k: " ".join(rnd.choice(vocab) + str(rnd.randrange(50)) for _ in range(k))
    line = "Licensed under the Apache License, Version 2.0.\n"
    passages = [say(60) for _ in range(4)] + ["ab" * 120, "x" * 150, line * 4]
    rows = []
    for i in range(n):
        t = say(rnd.choice([0, 3, 20, 80]))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            a = rnd.randrange(60)
            t += rnd.choice([p, p[a:], p[: -a - 1], line]) + say(rnd.randrange(9))
        rows.append(t)
        if rnd.random() < 0.3:
            rows.append(rnd.choice([t, t.replace(" a", " e", 2), t[5:], t + "!"]))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many chunks, shards and anchors of too many kinds
        for name, value in (("CHUNK", 3000), ("SHARD_BYTES", 2000), ("RANGE_BYTES", 4000), ("MOST_KINDS", 2)):
            monkeypatch.setattr(substrings, name, value)
    rows = texts(3, 160)
    rows += [None, "", "é" * 49 + "x", "é" * 50, "long " * 4000, "\0" * 300, "z" * 99]
    ids = list(range(len(rows)))
    random.Random(1).shuffle(ids)
    docs = spark.createDataFrame([(i, rows[i], "s", 1) for i in ids], "doc_id long, text string, kept string, row int")
    out = substrings.remove_repeats(docs).select("doc_id", *substrings.digests())
    assert sorted(map(tuple, out.collect())) == [(i, *r) for i, r in enumerate(brute(rows))]


def test_frequent_pieces_are_settled_over_a_task():
    """A passage that every chunk holds is sent once by a task; an earlier place is sent again."""
    rnd = random.Random(6)
    passage = bytes(rnd.randrange(97, 123) for _ in range(400))
    texts_of = [bytes(rnd.randrange(97, 123) for _ in range(300)) + passage for _ in range(40)]
    grams = substrings.gram_hashes(np.frombuffer(passage, np.uint8))
    pieces = substrings.Pieces(100, grams)
    sent = removed = 0
    for i, t in enumerate(texts_of):
        for p in pieces.of_rows([t], np.array([100 - i if i == 39 else i]), np.array([i])):
            first, again = pieces.settled(p)
            inner = lambda x: int((x["start"] >= 300).sum())
            sent, removed = sent + inner(first), removed + inner(again)
    each = sent + removed
    assert sent * 40 <= each * 3 and removed


def test_repeated_ids_and_null_ids(spark):
    base = texts(4, 1)[0] + "q" * 130
    docs = spark.createDataFrame([(None, base), (7, base), (7, base), (3, base)], "doc_id long, text string")
    out = {}
    for r in substrings.remove_repeats(docs).collect():
        out.setdefault(r["doc_id"], []).append(len(r["kept"]))
    n = len(base.encode())
    first = brute([base])[0]
    assert out[3] == [n - first[1]] and out[None] == [0] and out[7] == [0, 0]


def test_spans_are_what_is_missing(spark):
    rows = texts(5, 40)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in substrings.remove_repeats(docs).collect():
        b = rows[r["doc_id"]].encode()
        edges = [0, *(x for s in r["spans"] for x in (s["start"], s["end"])), len(b)]
        assert bytes(r["kept"]) == b"".join(b[a:e] for a, e in zip(edges[::2], edges[1::2]))


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).select(F.size("spans")).count() == 0

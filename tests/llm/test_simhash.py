import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from trailhead.llm import simhash


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 62)
    for i, d in enumerate(ids):
        least[root(i)] = min(least[root(i)], d)
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprints_and_components(spark):
    rnd = random.Random(5)
    vocab = ["Alpha", "beta", "GAMMA", "dé", "É", "x\xa0y", "delta", "eps", " z"]
    rows = []
    for i in range(400):
        n = rnd.choice([0, 1, 2, 3, 4, 5, 30, 300])
        rows.append((i, rnd.choice([" ", "\t", "\n \x0b"]).join(rnd.choice(vocab) for _ in range(n))))
        if rnd.random() < 0.5:
            w = rows[-1][1].split(" ")
            w[rnd.randrange(len(w))] = "edit"
            rows.append((1000 + i, " ".join(w)))
    rows += [(2000, None), (2001, rows[7][1]), (2001, rows[7][1]), (2002, "w " * 60000)]
    docs = spark.createDataFrame([(d, t, 5, "c") for d, t in rows], "doc_id long, text string, fp0 int, component_id string")
    got = simhash.cluster(docs)
    assert got.columns == ["doc_id", "fp0", "component_id"]
    got = sorted((r["doc_id"], r["fp0"] % (1 << 64), r["component_id"]) for r in got.collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    ids = [d for d, _ in rows]
    assert got == sorted(zip(ids, fps, brute_components(ids, fps)))
    assert len({c for _, _, c in got}) < len(ids)


def chained(rnd, n, flips):
    """Fingerprints of which each differs from an earlier one in a few bits."""
    fps = [rnd.getrandbits(64)]
    while len(fps) < n:
        x = rnd.choice(fps[-20:])
        for b in rnd.sample(range(64), rnd.choice(flips)):
            x ^= 1 << b
        fps.append(x)
    return list(dict.fromkeys(fps))


def test_links_in_small_large_and_split_buckets(spark):
    rnd = random.Random(6)
    fps = chained(rnd, 300, [1, 2, 3, 4, 5, 9]) + [rnd.getrandbits(64) for _ in range(300)] + [0, 1, (1 << 64) - 1, (1 << 64) - 16]
    want = brute_components(range(len(fps)), fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame(list(zip(range(len(fps)), signed)), "node long, fp0 long")
    for limit, batch, agree in ((4096, 100_000, 2), (20, 50, 2), (4096, 100_000, 3)):
        pairs = simhash.near_pairs(nodes, bucket_rows=limit, batch_rows=batch, agree=agree)
        found = {r["node"]: r["component"] for r in simhash.components(pairs).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == want


def test_bit_sliced_counters():
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 1 << 63, 500, np.uint64)
    flips = np.array([sum(1 << int(b) for b in rnd.choice(64, k, False)) for k in rnd.integers(0, 9, 500)], np.uint64)
    mask = np.zeros(512, bool)
    mask[:500] = rnd.random(500) < 0.9
    for radius in (0, 1, 3, 4, 7):
        lanes = simhash.near(simhash.vertical(x), simhash.vertical(x ^ flips), np.packbits(mask, bitorder="little").view(np.uint64), radius)
        got = np.unpackbits(lanes.view(np.uint8), bitorder="little")[:500].astype(bool)
        assert (got == (mask[:500] & (np.bitwise_count(flips) <= radius))).all()


def test_four_words_and_drawn_bits_find_copies_with_edits(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        w = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        rows.append((i, " ".join(w)))
        if i % 2:
            for _ in range(4):
                w[rnd.randrange(300)] = "edit"
            rows.append((100 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.cluster(docs, shingle=5, radius=46, seeds=(42, 43, 44, 45), tables=64, key_bits=16)
    found = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert found == {d: d % 100 for d, _ in rows}


def test_long_chain_settles(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    pairs = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {r["component"] for r in simhash.components(pairs).collect()} == {0}


def test_rows_without_an_id_link_others(spark):
    """A row without an id lies within the radius of two rows that aren't near each other."""
    rnd = random.Random(12)
    for _ in range(200):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        x, y = list(w), list(w)
        x[5], y[150] = "x", "y"
        texts = [" ".join(t) for t in (x, w, y)]
        a, b, c = map(brute_fingerprint, texts)
        if (a ^ b).bit_count() <= 4 and (b ^ c).bit_count() <= 4 < (a ^ c).bit_count():
            break
    else:
        raise AssertionError("no bridge drawn")
    rows = [(1, texts[0]), (None, texts[1]), (2, texts[2]), (None, "alone " * 3), (None, "alone " * 3), (7, "other words here")]
    got = simhash.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(
        map(str, [(1, 1), (None, 1), (2, 1), (None, None), (None, None), (7, 7)])
    )


def test_empty_table(spark):
    assert simhash.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0

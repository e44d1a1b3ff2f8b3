import math
import random

import numpy as np
from pyspark.sql import functions as F

from trailhead.llm import topk


def brute(rows, k, scale=64.0):
    ok = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % 20:
            continue
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, k=20, **how):
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    return sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 20 == 0, k=k, **how).select("query_id", "rank", "vec_id", "score").collect()))


def data(seed, n, dims, clusters=6):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(i, [c + rnd.gauss(0, 0.3) for c in rnd.choice(centres)]) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    rows = data(1, 700, 16)
    rows += [(1000, None), (1020, [None] * 16), (1040, [float("nan")] * 16), (1060, [float("inf")] + [0.0] * 15), (None, rows[0][1])]
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (2001, rows[3][1]), (2003, [0.0] * 16), (2004, [])]
    want = brute(rows, 20)
    assert run(spark, rows) == want
    assert run(spark, rows, slice_rows=7) == want
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    assert run(spark, rows) == want


def test_fewer_rows_than_k_and_ties(spark):
    rows = [(i, [1.0, 1.0]) for i in range(0, 9)]
    assert run(spark, rows) == brute(rows, 20) and len(run(spark, rows)) == 8
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0])]) == []


def test_large_values_stay_exact(spark):
    rnd = random.Random(4)
    for top in (200.0, 50_000.0, 3e7):
        rows = [(i, [float(np.float32(rnd.uniform(-top, top))) for _ in range(8)]) for i in range(60)]
        assert run(spark, rows) == brute(rows, 20)


def test_reading_stops_early_on_clustered_data():
    """Entries read of all lists: fewer where a cluster of good rows is known than where every row is alike."""
    rng = np.random.default_rng(0)
    x = np.floor(8 * rng.standard_normal((3000, 64)))
    x[:40] = x[0] + np.floor(2 * rng.standard_normal((40, 64)))
    ids = np.arange(3000)
    best, read = topk.Best(1, 20), []
    for part in (slice(0, 1500), slice(1500, 3000)):
        read.append(topk.search_block(x[:1], ids[:1], np.ascontiguousarray(x[part].T), ids[part], best) / (1500 * np.count_nonzero(x[0])))
    # the first block still has to finish the sums of its best rows; the second one ends with its outsiders
    assert read == [1.0, topk.DEPTHS[0]]
    s = x @ x[0]
    s[0] = -np.inf
    assert list(best.ids[0]) == list(np.lexsort((ids, -s))[:20])


def test_bounds_hold_at_every_depth():
    """After any depth, each candidate's score lies between its sum so far plus the least and the most of what is unseen."""
    rng = np.random.default_rng(1)
    x = np.floor(20 * rng.standard_normal((11, 300)))
    lists = topk.Lists(x)
    for _ in range(20):
        w = np.floor(3 * rng.standard_normal(11))
        dims = np.flatnonzero(w)
        side = (w < 0).astype(np.intp)[dims]
        down = np.packbits(w < 0, bitorder="little")[:, None]
        for end, marks in zip(lists.ends, lists.marks):
            seen = marks[0] & ~down | marks[1] & down
            shown = np.unpackbits(seen, axis=0, bitorder="little")[:11].astype(bool)
            assert (shown.sum(1) == end).all()
            total = (x * w[:, None] * shown).sum(0)
            score = w @ x
            assert (total + lists._rest(seen, w, side, dims, end - 1) >= score).all()
            assert (total + lists._rest(seen, w, side, dims, 299) <= score).all()



import hashlib
import math
import random

import numpy as np

from trailhead.llm import codes, queries


def brute(rows, parts=16, entries=64, rounds=2):
    """(id, label, code, error, label_error) of usable rows, and the codebooks' digest, by plain loops over Python's integers."""
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for *_, v in ok), default=0) // parts) * parts
    d = width // parts
    ok = [(i, lab, v + [0] * (width - len(v))) for i, lab, v in ok]
    first = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[v[p * d : p * d + d] for *_, v in first] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * d : p * d + d], y)), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            got = {}
            for *_, v in ok:
                got.setdefault(nearest(p, v)[1], []).append(v[p * d : p * d + d])
            new.append([[sum(c) // len(got[e]) for c in zip(*got[e])] if e in got else y for e, y in enumerate(books[p])])
        books = new
    out, sums = [], {}
    for i, lab, v in ok:
        best = [nearest(p, v) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(x for x, _ in best)))
        sums[lab] = sums.get(lab, 0) + out[-1][3]
    whole = lambda x: x if x < 1 << 63 else None
    digest = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    return [(i, lab, c, whole(e), whole(sums[lab])) for i, lab, c, e in out], digest


def f32(rows):
    return [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]


def data(seed, n, dims):
    rnd = random.Random(seed)
    return f32([(i, rnd.choice([None, 0, 1, 1, 1]), [rnd.gauss(0, 1) for _ in range(dims)]) for i in rnd.sample(range(-n, 3 * n), n)])


def run(spark, rows, **how):
    table = spark.createDataFrame([(i, lab, v, 1, "x") for i, lab, v in rows], "vec_id long, label int, embedding array<float>, n int, Kind string").repartition(3)
    packed = codes.blocks(table)
    books = codes.train(packed, **how)
    got = codes.with_label_errors(codes.encode(packed, books)).select("vec_id", "label", "code", "error", "label_error").collect()
    return sorted(map(tuple, got), key=repr), books


def check(spark, rows, **how):
    got, books = run(spark, rows, **how)
    want, digest = brute(rows, **how)
    assert got == sorted(want, key=repr) and books.digest() == digest
    return got, books


def test_equals_brute_force(spark, monkeypatch):
    rows = data(1, 300, 32) + f32([(10_000, 1, None), (10_001, 2, [None] * 32), (10_002, 1, [math.nan] * 32), (10_003, 1, [math.inf] + [0.0] * 31), (None, 9, [0.5] * 32), (-10_000, 1, [7.0] * 32), (-10_000, None, [-7.0] * 32), (-10_000, None, [-7.0] * 32)])
    check(spark, rows)
    monkeypatch.setattr(codes, "BLOCK_ROWS", 7)
    check(spark, rows)


def test_other_lengths_few_rows_and_entries(spark):
    rows = data(2, 20, 10) + f32([(500, 1, []), (501, 1, [1.0] * 17), (502, 1, [2.0])])
    check(spark, rows)
    check(spark, data(3, 40, 8), parts=4, entries=3, rounds=5)
    check(spark, f32([(1, 1, []), (2, None, [])]))


def test_ties_and_unused_entries(spark):
    # equal parts among the first entries: the lower index is taken, the other stays as it is
    rows = f32([(i, 0, [float(i % 2)] * 16) for i in range(100)])
    got, books = check(spark, rows)
    assert {c[2] for c in got} == {"00" * 16, "01" * 16} and books.entries.shape == (16, 64, 1)


def test_large_values_stay_exact(spark):
    for top in (1e3, 1e6, 1e9, 1e14, 1e30):
        rnd = random.Random(int(math.log10(top)))
        rows = f32([(i, i % 2, [rnd.uniform(-top, top) for _ in range(16)]) for i in range(90)])
        got, _ = check(spark, rows, entries=4)
        assert top < 1e10 or None in {r[3] for r in got}


def test_empty_table_and_nothing_usable(spark):
    for rows in ([], [(1, 1, None)], [(1, 1, [math.nan])]):
        assert run(spark, rows)[0] == []


def test_decoded_vectors(spark):
    rows = data(4, 80, 16)
    packed = codes.blocks(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    books = codes.train(packed)
    exact = {i: [math.floor(256 * x) for x in v] for i, _, v in rows}
    for r in codes.decode(codes.encode(packed, books), books).collect():
        assert sum((a - b) ** 2 for a, b in zip(exact[r["vec_id"]], r["decoded"])) == r["error"]


def test_query(spark, tmp_path):
    rows = data(5, 150, 64)
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, digest = brute(rows)
    got = [tuple(r) for r in queries.op11_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got) == sorted((i, c, e, s, digest) for i, _, c, e, s in want)

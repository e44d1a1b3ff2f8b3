import random

import numpy as np

import corpus_pipeline as cp
from trailhead.llm import near


def edited(rnd, words, n):
    """The words with n of them replaced, far apart as chance has it."""
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"new{rnd.randrange(10**9)}"
    return out


def jaccard(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def groups(texts):
    """Components of brute force over all pairs."""
    at = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if at[i] != at[j] and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((at[i], at[j]))
                at = [low if x == high else x for x in at]
    return at


def corpus():
    rnd = random.Random(6)
    texts = []
    for k in range(60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([12, 60, 200, 400]))]
        texts += [base, *(edited(rnd, base, max(1, round(len(base) * share))) for share in (0.01, 0.02, 0.03, 0.05, 0.09))]
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus()
    near_pairs = [jaccard(texts[i], texts[i + k]) for i in range(0, len(texts), 6) for k in range(1, 6)]
    assert sum(0.6 <= x < 0.8 for x in near_pairs) > 20 and sum(0.8 <= x < 0.9 for x in near_pairs) > 20
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = groups(texts)
    for part_rows in (near.PART_ROWS, 2):
        got = {r["doc_id"]: r["component_id"] for r in near.cluster(docs, part_rows=part_rows).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_a_large_group_of_near_copies_in_small_parts(spark):
    """Copies of one text, of which some are under the bound to all others and some reach it by others only."""
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(5000)}" for _ in range(240)]
    texts = [edited(rnd, base, rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 10])) for _ in range(150)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.cluster(docs, part_rows=10).collect()}
    want = groups(texts)
    assert 2 < len(set(want)) < 150
    assert [got[i] for i in range(len(texts))] == want


def test_counts_of_common_shingles(monkeypatch):
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 300, k).astype(np.uint64)) for k in (0, 1, 50, 200, 200, 300)]
    monkeypatch.setattr(near, "COLUMNS", 7)
    got = near.common_counts(sets)
    assert (got == [[len(np.intersect1d(a, b)) if i != j else got[i, i] for j, b in enumerate(sets)] for i, a in enumerate(sets)]).all()


def test_keys_and_tables_grow_with_the_corpus():
    sizes = [near.tables_for(n) for n in (0, 1, 10**5, 10**7, 10**10)]
    assert sizes == sorted(sizes) and sizes[0][0] == 10
    for bits, tables in sizes:
        assert (1 - near.AGREE**bits) ** tables <= near.MISSED


def test_the_stage_keeps_documents_under_the_similarity(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(groups(texts)))


def test_similarity_is_exact_at_the_bound():
    x = np.arange(100, dtype=np.uint64)
    assert near.similar(x[:80], x) and not near.similar(x[:79], x)
    assert near.similar(x[:90], x[10:]) == (80 / 100 >= 0.8) and not near.similar(x[:89], x[10:])


def test_short_and_empty_texts(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c"), (6, "x")]
    got = near.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}

import math
import random

import numpy as np
from pyspark.sql import functions as F

from trailhead.llm import common, langid

SYLLABLES = {"en": "the ing tion wh ould and er".split(), "de": "sch ung der ich ß ei ü".split(), "fr": "eau que é aux le oi è".split()}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def data(spark, n=900):
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, text(rnd, lang, rnd.choice([3, 10, 60])), lang if i % 7 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_held_out_accuracy_and_sparsity(spark):
    docs = data(spark)
    model = langid.train(docs)
    got = langid.predict(docs, model).where(common.held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and sum(r["lang_pred"] == r["truth"] for r in got) >= 0.97 * len(got)
    assert all(0 < r["score"] <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.9 and model.languages == ["de", "en", "fr"]


def test_held_out_labels_are_never_read(spark):
    docs = data(spark)
    wrong = docs.withColumn("lang", F.when(common.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.train(docs), langid.train(wrong)
    assert a.languages == b.languages and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_edge_rows(spark):
    docs = data(spark)
    model = langid.train(docs)
    rows = [(1, None), (2, ""), (3, "123 !? 45"), (4, "a"), (5, "the " * 600_000), (5, "the " * 600_000), (6, "İstanbul")]
    out = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3))
    assert out[5]["lang_pred"] == "en" and out[4]["lang_pred"] in model.languages
    assert langid.train(docs.where("lang = 'none'")) is None
    assert langid.predict(docs.limit(1), None).first()["lang_pred"] == "und"
    assert langid.predict(docs.limit(0), model).count() == 0


def test_batches_and_parts_score_alike(spark, monkeypatch):
    model = langid.train(data(spark))
    rnd = random.Random(5)
    texts = [text(rnd, "fr", n) for n in (1, 2, 50, 400, 3)] + ["x", "yz"]
    whole = langid.Scorer(model)(texts)
    monkeypatch.setattr(langid, "STRIDE", 37)
    parts = langid.Scorer(model)(texts)
    alone = [langid.Scorer(model)([t]) for t in texts]
    assert whole[0] == parts[0] == [a[0][0] for a in alone]
    assert abs(whole[1] - parts[1]).max() < 1e-6 and max(abs(whole[1][i] - alone[i][1][0]) for i in range(len(texts))) < 1e-6


def test_features_agree_with_the_scorer(spark):
    model = langid.train(data(spark))
    t = "the schung eau"
    where, share = langid.features(t, model.settings.bits)
    assert abs((model.weights[:, where] * share).sum(1) - langid.Scorer(model).sums([t])[0]).max() < 1e-5


def test_document_frequencies_are_those_of_all_texts(spark, monkeypatch):
    docs = data(spark, 120).unionByName(spark.createDataFrame([(7001, "", "en", "en"), (7002, "the ing " * 300, "en", "en"), (7002, "the ing " * 300, "en", "en")], "doc_id long, text string, lang string, truth string"))
    rows = langid.labelled(docs, "lang")
    monkeypatch.setattr(langid, "STRIDE", 50)
    df, n = langid.document_frequencies(rows, 10)
    want = np.zeros(3 << 10, np.int64)
    texts = [r["text"] for r in rows.collect()]
    for t in texts:
        want[langid.features(t, 10)[0]] += 1
    assert n == len(texts) and (df == want).all()
    assert langid.document_frequencies(rows.limit(0), 10)[1] == 0


def test_predictions_equal_plain_python(spark):
    """Each text's n-grams looked up one by one, its language by softmax; ties and clashing columns included."""
    docs = data(spark, 300)
    model = langid.train(docs)
    rnd = random.Random(9)
    texts = [text(rnd, rnd.choice(["en", "de", "fr"]), rnd.choice([1, 2, 5, 40])) for _ in range(60)] + ["x", "ÀÉ", "1 a"]
    table = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)], "doc_id long, text string, LANG_PRED string, Score int")
    got = {r["doc_id"]: r for r in langid.predict(table, model).collect()}
    for i, t in enumerate(texts):
        where, share = langid.features(t, model.settings.bits)
        z = [sum(float(w[b]) * s for b, s in zip(where, share)) + float(bias) for w, bias in zip(model.weights, model.bias)]
        p = [math.exp(x / model.temperature - max(z) / model.temperature) for x in z]
        assert abs(got[i]["score"] - max(p) / sum(p)) < 1e-4
        best = sorted(p)[-2:]
        assert best[1] - best[0] < 1e-4 or got[i]["lang_pred"] == model.languages[p.index(max(p))]


def test_ties_go_to_the_first_language():
    s = langid.Settings()
    model = langid.Model(["a", "b"], np.zeros((2, 3 << s.bits), np.float32), np.zeros(2), 1.0, s)
    assert langid.Scorer(model)(["some text"])[0] == ["a"]

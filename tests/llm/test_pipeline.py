import random

import corpus_pipeline as cp
from trailhead.llm import bpe, common, queries


def prose(rnd, n, words):
    return " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."


def table(spark, tmp_path, rows, bench):
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string, hits int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_act_and_keep_columns(spark, tmp_path):
    rnd = random.Random(8)
    en = [f"{a}{b}" for a in ("the", "wh", "ing", "ound", "ly") for b in ("ed", "er", "ness", "tion", "s", "ough")]
    de = [f"{a}{b}" for a in ("sch", "ü", "ver", "ge", "zw") for b in ("ung", "keit", "lich", "ß", "chen", "ö")]
    rows = [[i, prose(rnd, 200, en if i % 2 else de), "en" if i % 2 else "de", f"s{i % 3}", 0, "x", 1] for i in range(80)]
    passage = prose(rnd, 30, en)
    rows.append([200, "1234 5678 !!", None, "s", 1, None, None])
    rows.append([201, None, "en", None, None, None, None])
    rows.append([202, rows[4][1], "de", "s", 1, None, None])
    rows.append([203, rows[5][1].replace(" ", "  ", 3) + " more", "en", "s", 1, None, None])
    rows.append([204, prose(rnd, 100, en) + " " + passage, "en", "s", 1, None, None])
    rows.append([205, prose(rnd, 100, en) + " write to bob.stone@mail.example.com", "en", "s", 1, None, None])
    rows.append([205, prose(rnd, 100, en), "en", "s", 1, None, None])
    folder = table(spark, tmp_path, rows, [(1, passage)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = []
    for name, stage in cp.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, folder), "test")
        assert out.columns == docs.columns, name
        docs = out
        ids.append(sorted(r["doc_id"] for r in docs.collect()))
    base = list(range(80))
    assert ids[0] == base + [202, 203, 204, 205, 205]
    assert ids[1] == base + [204, 205, 205]
    assert ids[2] == base + [205, 205]
    assert ids[3] == ids[2]
    texts = {r["text"]: r for r in docs.where("doc_id = 205").collect()}
    assert not any("bob.stone" in t for t in texts) and any("@" in t for t in texts)
    assert all(r["n_chars"] == len(t) for t, r in texts.items())
    tokens = cp.STAGES[-1][1](spark, docs, folder).collect()
    e = bpe.encoder(queries.tokenizer_file())
    import numpy as np

    assert sorted(e.decode(np.array(r["ids"])) for r in tokens) == sorted(r["text"] for r in docs.collect())
    assert sorted(r["doc_id"] for r in cp.run(spark, folder).collect()) == ids[3]


def test_empty_documents(spark, tmp_path):
    folder = table(spark, tmp_path, [], [])
    assert cp.run(spark, folder).count() == 0

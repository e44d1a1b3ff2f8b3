"""The corpus pipeline: language, near-duplicates, contamination, personal data, tokens.

Each stage takes documents and returns documents, all columns kept, with what it rejects gone; the last returns token
ids. Columns that a stage needs for itself get names that the documents don't have, and are dropped again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead.llm import bpe, common, decontaminate, langid, near, pii, queries
from trailhead.sources.tables import spread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document goes if its language's probability is no more than this above what a guess among the languages has.
LEAST_MARGIN = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known.

    Documents without a text or a letter go, whatever their lang says, and so do those that no learned language stands
    out for; with one learned language only the former. Without labelled rows nothing is known, and all go. Repeated
    rows are judged alike; an empty table stays empty.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    lang, score = common.free(docs, "predicted"), common.free(docs, "probability")
    known = langid.predict(docs, model, lang=lang, score=score)
    languages = len(model.languages) if model else 0
    least = 1 / languages + LEAST_MARGIN if languages > 1 else 0.0
    return known.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= least)).drop(lang, score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the document of the smallest id (null ids last).

    Candidates come from the SimHash operator's bit-sliced comparison; each link is checked by the exact similarity of
    five-word shingles. Rows are numbered as they are stored, so that rows of one id, or without one, are documents of
    their own. The numbers are written once, as another scan could deal the files in another way. Texts that are null
    or have no words are alike, so one of them stays; of rows of one id the first as stored.
    """
    row = common.free(docs, "row")
    numbered = common.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near.cluster(numbered, row, "text", carry=("doc_id",))
    order = F.struct(F.col("carried.doc_id").isNull(), "carried.doc_id", F.col("doc_id").alias("row"))
    first = groups.groupBy("component_id").agg(F.min(order)["row"].alias(row)).select(row)
    return numbered.join(first, row, "left_semi").drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the benchmark doesn't contaminate: with hit words, and one in twenty words hit or more.

    Documents without a text or words stay, and so do all if the benchmark is empty; repeated rows are judged alike.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = common.free(docs, "own_")
    found = decontaminate.find(docs, benchmark, prefix=own)
    clean = ~decontaminate.contaminated(F.col(f"{own}n_words"), decontaminate.hit_words(f"{own}hits"))
    return found.where(clean).select(*(F.col(f"`{c}`") for c in docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; n_chars, if there, follows the text.

    All rows stay, null and empty texts as they are; the same entity gets the same surrogate in all of them.
    """
    entities = common.free(docs, "entities")
    done = pii.pseudonymize(docs, queries.PII_KEY, out=entities).drop(entities)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids of each text; none for a null or empty one. All rows stay, repeated ones too."""
    ids = bpe.encode(docs, queries.tokenizer_file(), ids="ids", keep=["doc_id"])
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("tokens", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is a table in the shared folder."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

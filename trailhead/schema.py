"""Types, closed sets of values, and the schema of the searchable chunk table."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Trust levels by rank; weights and tie ranks of the retrievers.
TRUST_RANK = {"trusted": 4, "project": 3, "external": 2, "untrusted": 1, "quarantined": 0}
WEIGHTS = {"exact": 1.00, "term": 0.95, "morphphrase": 0.90, "sparse": 0.75, "lemma": 0.70, "wordform": 0.70, "dense": 0.55}
OTHER_WEIGHT = 0.50
PRIORITY = {"exact": 0, "term": 1, "morphphrase": 1, "sparse": 2, "lemma": 3, "wordform": 3, "dense": 4}
OTHER_PRIORITY = 9
STATUSES = ("building", "ready", "failed", "superseded")
BASES = ("occurred", "observed", "effective")

TEMPORAL = T.StructType(
    [
        T.StructField("start", T.TimestampType()),
        T.StructField("end", T.TimestampType()),
        T.StructField("basis", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)

_IDS = T.ArrayType(T.StringType())

CHUNKS = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("span_start", T.LongType()),
        T.StructField("span_end", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("text_checksum", T.StringType()),
        T.StructField("trust_level", T.StringType()),
        T.StructField("lemmas", _IDS),
        T.StructField("wordforms", _IDS),
        T.StructField("sense_ids", _IDS),
        T.StructField("concept_ids", _IDS),
        T.StructField("attestation_ids", _IDS),
        T.StructField("register", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("time_period", T.StringType()),
        T.StructField("lexicon_source_id", T.StringType()),
        T.StructField("source_authority", T.StringType()),
        T.StructField("temporal", TEMPORAL),
        T.StructField("language", T.StringType()),
        T.StructField("analyzer_version", T.StringType()),
        T.StructField("tombstoned", T.BooleanType()),
    ]
)

CONTRIBUTION = "struct<retriever:string,raw:double,norm:double,weight:double,priority:int,reasons:array<string>>"


def _lookup(values: dict, key: Column, other) -> Column:
    out = F.lit(other)
    for name, value in reversed(values.items()):
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def trust_rank(level: Column) -> Column:
    """4 to 0 for the known levels, -1 for others."""
    return _lookup(TRUST_RANK, level, -1)


def default_weight(retriever: Column) -> Column:
    return _lookup(WEIGHTS, retriever, OTHER_WEIGHT)


def priority_rank(retriever: Column) -> Column:
    return _lookup(PRIORITY, retriever, OTHER_PRIORITY)

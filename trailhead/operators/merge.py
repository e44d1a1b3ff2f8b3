"""Scores: min-max normalisation, merging of candidates, the total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema

KEY = ["source_id", "span_start", "span_end", "text_checksum"]


def normalize(df: DataFrame, raw: str = "raw", out: str = "norm", within: Sequence[str | Column] = ()) -> DataFrame:
    """Min-max over each call's rows; all equal gives 0."""
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    low, high = F.min(raw).over(w), F.max(raw).over(w)
    return df.withColumn(out, F.when(high == low, F.lit(0.0)).otherwise((F.col(raw) - low) / (high - low)))


def contribution(retriever: str, raw: Column, norm: Column, reasons: Sequence[str] | Column, weight: float | None = None) -> Column:
    """One contribution; weight 0 or None is the retriever's default."""
    given = weight or schema.WEIGHTS.get(retriever, schema.OTHER_WEIGHT)
    rank = schema.PRIORITY.get(retriever, schema.OTHER_PRIORITY)
    why = reasons if isinstance(reasons, Column) else F.array(*map(F.lit, reasons))
    return F.struct(
        F.lit(retriever).alias("retriever"),
        raw.cast("double").alias("raw"),
        norm.cast("double").alias("norm"),
        F.lit(float(given)).alias("weight"),
        F.lit(rank).alias("priority"),
        why.alias("reasons"),
    )


def merged_score(contributions: Column) -> Column:
    """Sum of weight times normalised score, in order."""
    return F.aggregate(contributions, F.lit(0.0), lambda s, c: s + c["weight"] * c["norm"])


def best_priority(contributions: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(contributions, lambda c: c["priority"])), F.lit(schema.OTHER_PRIORITY))


def reasons(contributions: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(contributions, lambda c: c["reasons"]))))


def scored(df: DataFrame) -> DataFrame:
    """Add merged_score, priority and reasons of the contributions column."""
    c = F.col("contributions")
    return df.withColumns({"merged_score": merged_score(c), "priority": best_priority(c), "reasons": reasons(c)})


def merge(candidates: DataFrame, keep: Sequence[str] = ("chunk_id",), order: str = "place") -> DataFrame:
    """One row for each source, span and checksum: contributions joined in order of `order`, other columns of the first."""
    first = [F.min_by(c, order).alias(c) for c in keep]
    both = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("contributions").alias("c"))))
    out = candidates.groupBy(*KEY).agg(*first, both.alias("parts"))
    return scored(out.withColumn("contributions", F.flatten(F.transform("parts", lambda p: p["c"]))).drop("parts"))


def last_wins(df: DataFrame, by: Sequence[str], at: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """by and keep of the row of each key that comes last by the columns at."""
    last = df.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(*at)).alias("_last"))
    return last.select(*by, "_last.*")


def total_order() -> list[Column]:
    """Best score, then retriever, then chunk, source and place."""
    return [F.desc("merged_score"), F.asc("priority"), F.asc("chunk_id"), F.asc("source_id"), F.asc("span_start")]


def top(df: DataFrame, n: int = 20) -> DataFrame:
    return df.orderBy(*total_order()).limit(n if n > 0 else 20)


def rerank(df: DataFrame, score: Column | None = None) -> DataFrame:
    """Order by the given scores, which replace the merged ones, then chunk; without, by the merged score again."""
    if score is not None:
        df = df.withColumn("merged_score", score.cast("double"))
    return df.orderBy(F.desc("merged_score"), F.asc("chunk_id"))

"""Retrievers: exact, sparse, dense; each gives candidates with one contribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from . import filters as FI
from . import merge as M

CARRIED = ["chunk_id", "source_id", "span_start", "span_end", "text_checksum", "trust_level"]

#: What each access path enforces itself.
CAPABILITIES = {
    "exact": {"scope", "tombstones", "identity", "metadata", "temporal"},
    "query": {"scope", "tombstones", "identity", "metadata", "temporal"},
    "sparse": {"scope", "tombstones"},
    "dense": {"scope", "tombstones", "embedding_version"},
}


def _one(df: DataFrame, retriever: str, reasons: Sequence[str], f: FI.Filters, extra: Sequence[str] = ()) -> DataFrame:
    codes = [*reasons, *f.reasons()]
    c = M.contribution(retriever, F.col("raw"), F.col("norm"), codes)
    return df.select(*CARRIED, *extra, F.array(c).alias("contributions"))


def exact(chunks: DataFrame, phrase: str, f: FI.Filters = FI.Filters(), extra: Sequence[str] = ()) -> DataFrame:
    """Chunks that hold the phrase as it is; an empty phrase matches nothing."""
    phrase = phrase.strip()
    hits = chunks.where(FI.condition(f)).where(F.col("text").contains(phrase) if phrase else F.lit(False))
    return _one(hits.withColumns({"raw": F.lit(1.0), "norm": F.lit(1.0)}), "exact", ["exact_phrase"], f, extra)


def folded(chunks: DataFrame, phrase: str) -> DataFrame:
    """Chunks that hold the phrase in any case."""
    return chunks.where(F.lower("text").contains(phrase.lower()))


def overlap(text: Column, query: str) -> Column:
    """How many of the query's words (repeats count) the lower-cased text holds as substrings."""
    low = F.lower(text)
    return sum((low.contains(w).cast("double") for w in query.lower().split()), F.lit(0.0))


def sparse(chunks: DataFrame, query: str, limit: int = 20, f: FI.Filters = FI.Filters()) -> DataFrame:
    """The best chunks by word overlap; filters come after the limit, normalisation after the filters."""
    hits = chunks.withColumn("raw", overlap(F.col("text"), query)).where("raw > 0")
    best = hits.orderBy(F.desc("raw"), "chunk_id").limit(limit if limit > 0 else 20)
    return _one(M.normalize(best.where(FI.condition(f))), "sparse", ["sparse_overlap"], f)


#: So many repeated chunk ids are broadcast; beyond, all postings are merged by a shuffle.
MANY_REPEATED = 100_000


def _counts(words: Column) -> Column:
    """array<struct<token, tf, n_tokens>>: a text's distinct words, from their sorted list."""

    def of(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        one = lambda h: F.transform(h, lambda at, k: F.struct(F.get(s, at).alias("token"), (F.coalesce(F.get(h, k + 1), F.size(s)) - at).cast("bigint").alias("tf"), F.size(s).alias("n_tokens")))
        return F.when(F.size(s) > 0, F.transform(F.array(heads), one)[0])

    # each list is made once
    return F.transform(F.array(F.sort_array(words)), of)[0]


def postings(chunks: DataFrame) -> DataFrame:
    """One row for each word of a chunk: project_id, snapshot_id, token, chunk_id, tf, n_tokens.

    Words are counted within their row, so nothing is shuffled. Only rows that share a chunk's id are put together; these
    ids are looked for first, by a count over the ids alone.
    """
    key = ["project_id", "snapshot_id", "chunk_id"]
    order = ["project_id", "snapshot_id", "token", "chunk_id"]
    # explode() would put a filter below that counts once more
    each = lambda rows: rows.select(*key, F.explode_outer(_counts(X.tokens(F.col("text")))).alias("_w")).where("_w is not null").select(*order[:2], "_w.token", "chunk_id", "_w.tf", "_w.n_tokens")
    merged = lambda rows: each(rows).groupBy(*order).agg(F.sum("tf").alias("tf"), F.first("n_tokens").alias("n_tokens"))
    repeated = chunks.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    many = repeated.limit(MANY_REPEATED + 1).count()
    if not many:
        return each(chunks)
    if many > MANY_REPEATED:
        return merged(chunks)
    few = F.broadcast(repeated.select(*(F.col(c).alias(f"_{c}") for c in key), F.lit(True).alias("_again")))
    same = F.col(key[0]).eqNullSafe(F.col(f"_{key[0]}")) & F.col(key[1]).eqNullSafe(F.col(f"_{key[1]}")) & F.col(key[2]).eqNullSafe(F.col(f"_{key[2]}"))
    both = chunks.select(*key, "text").join(few, same, "left")
    return each(both.where("_again is null")).unionByName(merged(both.where("_again")))


def full_text(index: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Chunks that hold all words of the query, by sum of tf / (1 + ln(chunk's words)), then chunk: chunk_id, raw."""
    words = sorted({w.lower() for w in query.split()})
    hits = index.where(F.col("token").isin(words)).withColumn("part", F.col("tf") / (1 + F.log(F.col("n_tokens").cast("double"))))
    found = hits.groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("part").alias("raw")).where(F.col("n") == len(words))
    return found.orderBy(F.desc("raw"), "chunk_id").limit(limit if limit > 0 else 20).select("chunk_id", "raw")


def dense(vectors: DataFrame, query: Sequence[float], limit: int = 20, metric: str = "cosine", vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The nearest vectors of equal length: key, raw; ties by key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    same = vectors.where(F.size(vector) == len(query))
    best = same.select(key, V.METRICS[metric](F.col(vector), q).alias("raw"))
    return best.orderBy(F.desc("raw"), key).limit(limit if limit > 0 else 20)


def of_hits(chunks: DataFrame, hits: DataFrame, retriever: str, reasons: Sequence[str], f: FI.Filters = FI.Filters()) -> DataFrame:
    """Candidates of hits (chunk_id, raw; few rows, after a limit): joined, filtered, then normalised."""
    rows = chunks.join(F.broadcast(hits), "chunk_id").where(FI.condition(f))
    return _one(M.normalize(rows), retriever, reasons, f)


def hybrid(chunks: DataFrame, terms: Sequence[str], limit: int = 20, f: FI.Filters = FI.Filters(), rejected: Sequence[str] = (), dense_hits: DataFrame | None = None) -> DataFrame:
    """All retrievers for all terms, merged: one scored row for each chunk.

    terms: the query, then its expansions; those rejected are left out. The chunks are read once: each gives a row for
    every term and retriever that finds it. Of a term's overlaps every task keeps the best so many, by Spark's limit on
    window groups, before these meet; exact hits, which no limit holds for, are groups of their own in the same window.
    Filters come after the limit, normalisation after the filters, as in exact(), sparse() and of_hits().
    """
    limit = limit if limit > 0 else 20
    asked = [t for t in terms if t not in rejected]
    rows = chunks.withColumn("_ok", FI.condition(f))
    found = []
    hit = lambda place, raw, own: F.struct(F.lit(place).alias("place"), raw.cast("double").alias("raw"), F.lit(own).alias("own"))
    for i, term in enumerate(asked):
        phrase, raw = term.strip(), overlap(F.col("text"), term)
        if phrase:
            found.append(F.when(F.col("_ok") & F.col("text").contains(phrase), hit(2 * i, F.lit(1.0), True)))
        found.append(F.when(raw > 0, hit(2 * i + 1, raw, False)))
    dense_place = 2 * len(asked)
    if dense_hits is not None:
        # few rows, after a limit
        few = dense_hits.select(F.col("chunk_id").alias("_hit"), F.col("raw").alias("_raw"))
        rows = rows.join(F.broadcast(few), F.col("chunk_id") == F.col("_hit"), "left")
        found.append(F.when(F.col("_ok") & F.col("_hit").isNotNull(), hit(dense_place, F.col("_raw"), True)))
    listed = F.array(*found) if found else F.array(F.lit(None).cast("struct<place:int,raw:double,own:boolean>"))
    # explode() would put a filter below that looks for everything once more
    each = rows.select(*CARRIED, "_ok", F.explode_outer(F.array_compact(listed)).alias("_h")).where("_h is not null").select(*CARRIED, "_ok", "_h.*")
    alone = F.when(F.col("own"), F.col("chunk_id"))
    best = each.withColumn("_n", F.row_number().over(Window.partitionBy("place", alone).orderBy(F.desc("raw"), "chunk_id"))).where(F.col("_n") <= limit)
    best = M.normalize(best.where("_ok"), within=["place", F.when(F.col("own") & (F.col("place") < dense_place), F.col("chunk_id"))])
    kinds = [("exact", ["exact_phrase"], F.lit(1.0)), ("sparse", ["sparse_overlap"], F.col("norm")), ("dense", ["dense_similarity"], F.col("norm"))]
    one = [M.contribution(k, F.col("raw"), norm, [*why, *f.reasons()]) for k, why, norm in kinds]
    which = F.when(F.col("place") == dense_place, one[2]).when(F.col("place") % 2 == 0, one[0]).otherwise(one[1])
    parts = best.select(*CARRIED, F.array(which).alias("contributions"), F.struct("place", "chunk_id").alias("place"))
    return M.merge(parts, keep=("chunk_id", "trust_level"))

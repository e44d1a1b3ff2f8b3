"""Full-text ranks from the positional index: by how often words stand in a chunk, exactly and early, or by how close.

A chunk that holds all words of a query scores the sum of tf / (1 + ln(its words)) over them (rank "often"). Every block
knows the greatest part that a chunk of it gets from its word, so a segment's sum of these bounds all scores in it. The
segments of the best bounds are scored first; the k-th best score found there is a bar, and only segments whose bound
reaches it are looked at further. Of these, blocks are read whose part can reach what the bar leaves to their word, the
others' greatest parts given; as blocks lie in order of their greatest part, whole row groups are passed by. Chunks that
tie with the bar are looked at, so the result is that of scoring everything.

Cover density (rank "close"): a cover is a stretch of the chunk from one of the words to another that holds all of them
and no shorter such stretch. Each adds the number of words asked for, divided by how many words it is long: 1 where
they stand side by side. Covers are found by one sweep over the merged places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import postings as P

#: Segments that are scored first, and how many times more if they don't hold k chunks.
FIRST_SEGMENTS = 16
GROWTH = 8
#: Scores have so many decimals, so that what ties does so on every machine.
DECIMALS = 9

_SCORED = T.StructType([T.StructField("segment", T.LongType()), T.StructField("ordinal", T.IntegerType()), T.StructField("raw", T.DoubleType()), T.StructField("covers", T.IntegerType())])


def query_words(query: str) -> list[str]:
    return sorted({w.lower() for w in query.split()})


def covers(keys: np.ndarray, terms: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, first place, last place) of each minimal stretch that holds all terms.

    keys: chunk << 32 | place, in order; terms: which of so many terms stands there.
    """
    chunk, at = keys >> 32, np.arange(len(keys))
    first = np.full(len(keys), len(keys))
    complete = np.ones(len(keys), bool)
    for t in range(many):
        # the last occurrence of the term so far, if it is in the same chunk
        last = np.maximum.accumulate(np.where(terms == t, at, -1))
        complete &= (last >= 0) & (chunk[last] == chunk)
        first = np.minimum(first, last)
    right = np.flatnonzero(complete)
    left = first[right]
    # of the stretches that begin at one place the first that is complete is the shortest
    shortest = np.ones(len(left), bool)
    shortest[1:] = left[1:] != left[:-1]
    left, right = left[shortest], right[shortest]
    return chunk[right], keys[left] & 0xFFFFFFFF, keys[right] & 0xFFFFFFFF


def _often(words: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        segment, found = table.column("segment")[0].as_py(), {}
        for token, n, cf, data in zip(*(table.column(c).to_pylist() for c in ("token", "n", "cf", "lists"))):
            docs, tf, size, _ = P.decode(n, cf, data)
            found[token] = docs, P.part(tf, size)
        if len(found) < len(words):
            return _result(segment, np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32))
        docs = found[words[0]][0]
        for w in words[1:]:
            docs = np.intersect1d(docs, found[w][0], assume_unique=True)
        total = np.zeros(len(docs))
        for w in words:
            total += found[w][1][np.searchsorted(found[w][0], docs)]
        return _result(segment, docs, total, np.zeros(len(docs), np.int32))

    return run


def _close(words: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        from ..plans.seek import Lists

        lists = Lists(table)
        each = [lists.occurrences(frozenset([w])) for w in words]
        keys, terms = np.concatenate(each), np.repeat(np.arange(len(words)), [len(x) for x in each])
        order = np.argsort(keys, kind="stable")
        chunk, left, right = covers(keys[order], terms[order], len(words))
        docs, at, count = np.unique(chunk, return_index=True, return_counts=True)
        total = np.add.reduceat(len(words) / (right - left + 1.0), at) if len(at) else np.empty(0)
        return _result(table.column("segment")[0].as_py(), docs, total, count)

    return run


def _result(segment: int, docs: np.ndarray, total: np.ndarray, count: np.ndarray) -> pa.Table:
    return pa.table([pa.array(np.full(len(docs), segment, np.int64)), pa.array(docs.astype(np.int32)), pa.array(np.round(total, DECIMALS)), pa.array(count.astype(np.int32))], names=_SCORED.names)


def cover_density(index: P.Index, query: str) -> DataFrame:
    """chunk_id, raw (cover density) and covers of every chunk that holds all words of the query."""
    words = query_words(query)
    found = index.blocks(words).select("segment", "token", "n", "cf", "lists").groupBy("segment").applyInArrow(_close(words), _SCORED)
    return index.chunk_ids(found)


def _score(blocks: DataFrame, words: list[str]) -> DataFrame:
    return blocks.select("segment", "token", "n", "cf", "lists").groupBy("segment").applyInArrow(_often(words), _SCORED)


def _best(index: P.Index, scored: DataFrame, limit: int) -> DataFrame:
    """The best chunks, once their ids, by which ties are told apart, are known."""
    return index.chunk_ids(scored).select("chunk_id", "raw").orderBy(F.desc("raw"), "chunk_id").limit(limit)


def top(index: P.Index, query: str, limit: int = 20, rank: str = "often") -> DataFrame:
    """chunk_id and raw of the best chunks that hold all words of the query; ties by chunk_id."""
    words, limit = query_words(query), limit if limit > 0 else 20
    if rank == "close":
        return cover_density(index, query).select("chunk_id", "raw").orderBy(F.desc("raw"), "chunk_id").limit(limit)
    if rank != "often":
        raise ValueError(f"unknown rank {rank}")
    return _best(index, _score(reaching(index, words, limit), words), limit)


def reaching(index: P.Index, words: list[str], limit: int) -> DataFrame:
    """The blocks that have to be read for the best so many chunks; the driver sees a row for each of the first segments."""
    blocks = index.blocks(words)
    bounds = blocks.groupBy("segment").agg(F.count("*").alias("k"), F.sum("most").alias("bound")).where(F.col("k") == len(words))
    take, bar, first = FIRST_SEGMENTS, None, []
    while bar is None:
        first = bounds.orderBy(F.desc("bound"), "segment").limit(take).collect()
        some = blocks.where(F.col("segment").isin([r["segment"] for r in first]))
        if len(first) < take:
            return some
        best = _score(some, words).orderBy(F.desc("raw")).limit(limit).collect()
        # below the last by more than rounding does
        bar = best[-1]["raw"] * (1 - 1e-9) - 10**-DECIMALS if len(best) == limit else None
        if bar is not None and first[-1]["bound"] < bar:
            return some.where(F.col("segment").isin([r["segment"] for r in first if r["bound"] >= bar]))
        take *= GROWTH
    greatest = {r["token"]: r["most"] for r in blocks.groupBy("token").agg(F.max("most").alias("most")).collect()}
    enough = F.lit(False)
    for w in words:
        rest = sum(x for t, x in greatest.items() if t != w)
        enough = enough | ((F.col("token") == w) & (F.col("most") >= bar - rest))
    return blocks.where(enough).join(bounds.where(F.col("bound") >= bar).select("segment"), "segment", "left_semi")

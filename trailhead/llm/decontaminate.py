"""Benchmark decontamination by a prefix-filtered set join.

A window is `width` consecutive words of a benchmark item (the whole item, if it has fewer). Its shingles of three
words (of all its words, if it has fewer) are ordered by their frequency over all documents. A text that holds the
window holds each of its shingles, so the rarest one alone, its prefix, is a necessary condition: texts are joined
with windows on prefixes. A match at word p of the text is only followed up where the window's words before and
behind the shingle fit into the text (length and position); the words around are then compared with the item's, and
only runs that cover a whole window count.

Two scans of the texts are made: one counts the shingles, one finds the windows. The index over the benchmark goes to
all tasks, in shards of at most shard_chars characters of items; there are as many shards as it takes, each with two
scans of its own, and the words hit are merged over shards. Items are sharded by the hash of their text.

Defined results: null texts have no words; items without words, and items whose id is null, never match; items of the
same text all match; repeated rows give repeated rows; empty tables are allowed; texts may be of any length; a column
named like an output is replaced.
"""

from __future__ import annotations

from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE = 3
SHARD_CHARS = 2_000_000

#: Bytes of words: digits, letters (lower-cased) and all bytes of characters beyond ASCII; all others separate.
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _shingles(w: list[bytes], k: int):
    """All shingles of k words in order: plain words for 1, tuples else."""
    return w if k == 1 else zip(*(w[i:] for i in range(k)))


class Index:
    """The windows of some items by their prefixes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int, rarity: dict | None = None):
        self.width = width
        self.items = items
        self.prefixes: dict[int, dict] = {}
        for number, (_, w) in enumerate(items):
            size = min(width, len(w))
            k = min(SHINGLE, size)
            parts = list(_shingles(w, k))
            into = self.prefixes.setdefault(k, {})
            if rarity is None:
                for s in parts:
                    into.setdefault(s, [])
                continue
            rank = [(rarity.get((k, s), 0), s, j) for j, s in enumerate(parts)]
            for j in {min(rank[a : a + size - k + 1])[2] for a in range(len(w) - size + 1)}:
                into.setdefault(parts[j], []).append((number, j))

    def seen(self, w: list[bytes]):
        """(shingle size, position, shingle) of each shingle of w that the index holds."""
        for k, into in self.prefixes.items():
            if len(w) >= k:
                held = map(into.__contains__, _shingles(w, k))
                for p in compress(count(), held):
                    yield k, p, w[p] if k == 1 else tuple(w[p : p + k])

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of w that windows cover, and the ids of their items."""
        ranges, ids = [], set()
        for k, p, s in self.seen(w):
            for number, j in self.prefixes[k][s]:
                name, item = self.items[number]
                size = min(self.width, len(item))
                room = size - k
                before, behind = min(room, j, p), min(room, len(item) - j - k, len(w) - p - k)
                if before + behind < room:
                    continue
                a = 0
                while a < before and item[j - 1 - a] == w[p - 1 - a]:
                    a += 1
                b = 0
                while b < behind and item[j + k + b] == w[p + k + b]:
                    b += 1
                if a + b >= room:
                    ranges.append((p - a, p + k + b))
                    ids.add(name)
        return merged(ranges), ids


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges, with those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def rarity(docs: DataFrame, text: str, items: list[tuple[str, list[bytes]]], width: int) -> dict:
    """How often each shingle of the items occurs in all texts: (size, shingle) to count."""
    order = Index(items, width)
    numbers = {(k, s): i for i, (k, s) in enumerate((k, s) for k, into in order.prefixes.items() for s in into)}

    def run(batches):
        total = np.zeros(len(numbers), np.int64)
        for batch in batches:
            for t in _bytes(batch.column(0)):
                for k, _, s in order.seen(words(t)):
                    total[numbers[k, s]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["shingle", "n"])

    got = common.map_texts(docs.select(F.col(text).alias("text")), run, "shingle long, n long")
    totals = {r["shingle"]: r["n"] for r in got.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}
    return {key: totals.get(i, 0) for key, i in numbers.items()}


RANGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def fields(prefix: str) -> list[T.StructField]:
    return [
        T.StructField(f"{prefix}n_words", T.LongType()),
        T.StructField(f"{prefix}hits", T.ArrayType(RANGE)),
        T.StructField(f"{prefix}items", T.ArrayType(T.StringType())),
    ]


HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, shard_chars: int = SHARD_CHARS, keep=None, prefix: str = "") -> DataFrame:
    """Add n_words, hits (ranges of word numbers that windows cover) and items (ids, sorted as text).

    prefix goes before the names of these columns.
    """
    known = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t")).dropna()
    chars = known.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    out = docs
    for shard in range(shards):
        rows = known.where(F.pmod(F.xxhash64("t"), F.lit(shards)) == shard).orderBy("id", "t").collect()
        items = [(r["id"], w) for r in rows if (w := words(r["t"].encode()))]
        index = Index(items, width, rarity(docs, text, items, width))
        out = _add(out, text, index, shard > 0, keep if shard == shards - 1 else None, prefix)
    return out


def _add(docs: DataFrame, text: str, index: Index, more: bool, keep, prefix: str) -> DataFrame:
    def make():
        def fn(column: pa.Array, *before: pa.Array):
            counts, hits, items = [], [], []
            old = [b.to_pylist() for b in before]
            for i, t in enumerate(_bytes(column)):
                w = words(t)
                ranges, ids = index.find(w)
                if more:
                    ranges = merged(ranges + [(r["start"], r["end"]) for r in old[0][i]])
                    ids |= set(old[1][i])
                counts.append(len(w))
                hits.append([{"start": a, "end": b} for a, b in ranges])
                items.append(sorted(ids))
            return [pa.array(counts, pa.int64()), pa.array(hits, HITS), pa.array(items, pa.list_(pa.string()))]

        return fn

    kept = [c for c in (docs.columns if keep is None else keep)]
    return common.with_columns(docs, [text, *([f"{prefix}hits", f"{prefix}items"] if more else [])], fields(prefix), make, kept)


def hit_words(hits: str = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """The rule: some words are hit, and at least one in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digests() -> list[Column]:
    """n_words, n_hit, n_items, items_sha256 and contaminated of find()'s columns."""
    return [
        F.col("n_words"),
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), hit_words()).alias("contaminated"),
    ]

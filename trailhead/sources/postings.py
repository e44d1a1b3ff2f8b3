"""A positional index of chunks: for every word of a snapshot, where it stands, in blocks of delta-coded lists.

A segment is what one task reads at a time, some 12 MB of text; its chunks are numbered from 0. A row of the index is the
block of one word in one segment: how many chunks have it, how many times, the greatest part of a score that a chunk of
the block can get from the word, and three lists as one string of variable-length numbers: of each chunk the distance
of its number from the one before, how often the word stands in it and how many words it has; then the places
of all occurrences, again as distances, from 0 in each chunk. The row of the empty word is the segment itself: the ids
of its chunks in order. All words of a chunk are in blocks of its segment, so that lists are merged segment by segment
and never meet elsewhere.

Rows lie in folders by a hash of the word. A task writes the blocks of its own segments, so that they aren't shuffled and
frequent words don't meet in one task; files are sorted by word, then by the greatest part, in small row groups with statistics
and Bloom filters. A query's words are looked for in their folders alone and touch few row groups there, and blocks that
can't reach a score are passed by. The vocabulary (word, chunks, occurrences) and the lemmas of the languages asked for (lemma,
word) lie beside it; a language without an adapter has no lemmas.

Defined results: chunks without words are in no block; a null text has none; rows of one chunk id are chunks of their
own; writing a snapshot's index again replaces it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import languages as L
from ..functions import text as X

SCOPE = ["project_id", "snapshot_id"]
SEGMENT_BYTES = 12 << 20
ROW_GROUP_BYTES = 1 << 20
#: Folders that words are dealt to; an index is read with those it was written with.
BUCKETS = 16

BLOCK = T.StructType(
    [
        T.StructField("token", T.StringType()), T.StructField("segment", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("cf", T.LongType()),
        T.StructField("most", T.DoubleType()), T.StructField("lists", T.BinaryType()), T.StructField("ids", T.ArrayType(T.StringType())),
    ]
)
_SHAPES = {
    "blocks": T.StructType([*BLOCK.fields, *(T.StructField(c, T.StringType()) for c in SCOPE), T.StructField("bucket", T.IntegerType())]),
    "words": "token string, df long, cf long, project_id string, snapshot_id string",
    "lemmas": "lemma string, token string, project_id string, snapshot_id string, tag string",
}


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def part(tf: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What a word that stands tf times among size words adds to a chunk's score."""
    return tf / (1 + np.log(size))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on as bytes of seven bits each, the lowest first, 128 added to all but the last; and how many bytes each has."""
    size = np.ones(len(values), np.int8)
    large = np.flatnonzero(values > 0x7F)
    for bits in (7, 14, 21, 28):
        size[large] += values[large] >> bits > 0
    begins = np.cumsum(size, dtype=np.int32 if 5 * len(values) < 1 << 31 else np.int64)
    out = np.empty(int(begins[-1]) if len(values) else 0, np.uint8)
    begins -= size
    out[begins] = values & 0x7F
    for k in range(1, 5):
        out[begins[large] + k - 1] |= 0x80
        out[begins[large] + k] = values[large] >> 7 * k & 0x7F
        large = large[size[large] > k + 1]
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers that packed() made into bytes."""
    if not len(data):
        return np.empty(0, np.int64)
    last = np.flatnonzero(data < 0x80)
    begins = np.append(0, last[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(begins, last - begins + 1)
    return np.add.reduceat((data & 0x7F).astype(np.int64) << 7 * place, begins)


def decode(n: int, cf: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its chunks' numbers, how often the word stands in each, how many words each has, and all places."""
    values = unpacked(np.frombuffer(data, np.uint8))
    steps, tf, size, gaps = values[:n], values[n : 2 * n], values[2 * n : 3 * n], values[3 * n :]
    opens = np.cumsum(tf) - tf
    places = np.cumsum(gaps)
    places -= np.repeat(places[opens] - gaps[opens], tf)
    return np.cumsum(steps), tf, size, places


def _steps(values: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Distances from the value before; the value itself where a list opens."""
    out = np.diff(values, prepend=values.dtype.type(0))
    out[opens] = values[opens]
    return out


def _order(codes: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2^31, by their lower and then their upper 16 bits, which NumPy sorts in linear time."""
    order = np.argsort(codes.astype(np.uint16), kind="stable").astype(np.int32)
    if codes.max(initial=0) >> 16:
        order = order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def _segment(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The rows of a segment: first its own, then one a word. texts: words with one space between each two."""
    tokens = pc.split_pattern(texts, " ")
    size = np.diff(tokens.offsets.to_numpy())
    words = tokens.flatten().dictionary_encode()
    del tokens
    codes, names = words.indices.to_numpy(), words.dictionary
    # 32-bit integers: a segment is a few million words
    order = _order(codes)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
    place = order - np.repeat((np.cumsum(size) - size).astype(np.int32), size)[order]
    codes = codes[order]
    del words, order
    opens = np.ones(len(codes), bool)
    opens[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(opens).astype(np.int32)  # of each posting, its first occurrence
    tf, docs = np.diff(at, append=np.int32(len(codes))), doc[at]
    heads = np.flatnonzero(np.diff(codes[at], prepend=-1)).astype(np.int32)  # of each block, its first posting
    n, cf, sizes = np.diff(heads, append=np.int32(len(at))), np.diff(at[heads], append=np.int32(len(codes))), size[docs]
    most = np.maximum.reduceat(part(tf, sizes), heads) if len(heads) else np.empty(0)
    # the lists of a block one after another: chunks, counts, sizes, places
    long = 3 * n + cf
    begin = np.cumsum(long, dtype=np.int32) - long
    posting = np.repeat(begin - heads, n) + np.arange(len(at), dtype=np.int32)
    each = np.empty(int(long.sum()), np.int32)
    each[posting], each[posting + np.repeat(n, n)], each[posting + np.repeat(2 * n, n)] = _steps(docs, heads), tf, sizes
    each[np.repeat(begin + 3 * n - at[heads], cf) + np.arange(len(codes), dtype=np.int32)] = _steps(place, at)
    token = codes[at[heads]]
    del doc, place, codes, docs, posting
    data, length = packed(each)
    lengths = np.add.reduceat(length.astype(np.int64), begin) if len(heads) else np.empty(0, np.int64)
    offsets = np.concatenate([[0, 0], np.cumsum(lengths)]).astype(np.int32)
    rows = len(heads) + 1
    columns = [
        pa.concat_arrays([pa.array([""]), names.take(pa.array(token)).cast(pa.string())]),
        pa.array(np.full(rows, number)), pa.array(np.append(len(size), n).astype(np.int32)), pa.array(np.append(int(cf.sum()), cf).astype(np.int64)), pa.array(np.append(0.0, most)),
        pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
        pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * rows], pa.int32()), ids),
    ]
    return pa.RecordBatch.from_arrays(columns, names=BLOCK.names)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        rows = max(1, batch.num_rows * SEGMENT_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            yield _segment(task + number, *some.columns)
            number += 1
            # a worker that idles or goes on doesn't keep what the largest segment took
            pa.default_memory_pool().release_unused()


def blocks(chunks: DataFrame) -> DataFrame:
    """The index's rows of chunks of one snapshot, unsorted."""
    # in lower case once they are words, as the case of some letters depends on their word; a text without words is null
    words = F.lower(F.trim(F.regexp_replace("text", rf"[^{X.WORD.removeprefix('[').removesuffix(']+')}]+", " ")))
    return chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.when(words != "", words).alias("words")).mapInArrow(_segments, BLOCK)


def _write(df: DataFrame, path: str, by: Sequence[str], bloom: str, size: int) -> None:
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", size).option("compression", "zstd")
    # laid out for a word in 64 bytes; else each Bloom filter takes a megabyte, as much as a row group
    out = out.option(f"parquet.bloom.filter.enabled#{bloom}", "true").option(f"parquet.bloom.filter.expected.ndv#{bloom}", max(1, size >> 6))
    out.partitionBy(*by).parquet(path)


def put(chunks: DataFrame, path: str, languages: Sequence[str] = ()) -> None:
    """Write the index of chunks (whole snapshots), replacing what these snapshots had.

    The texts are read once, and their blocks are written where they are made; lemmas are made from the distinct words.
    """
    spark = chunks.sparkSession
    # the snapshots, few rows
    for project, snapshot in sorted(chunks.select(*SCOPE).distinct().collect()):
        index = Index(spark, path, project, snapshot)
        rows = blocks(chunks.where((F.col("project_id") == project) & (F.col("snapshot_id") == snapshot))).withColumn("bucket", bucket(F.col("token")))
        # a word is in a row group of every task that has it, so these are small
        _write(rows.sortWithinPartitions("bucket", "token", F.desc("most"), "segment"), index.folder("blocks"), ["bucket"], "token", ROW_GROUP_BYTES // 4)
        counts = index._table("blocks").where("token <> ''").groupBy("token").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
        _write(counts.sortWithinPartitions("token"), index.folder("words"), [], "token", ROW_GROUP_BYTES)
        # without an adapter lemmas are the words themselves, and nobody reads them
        for tag in dict.fromkeys(tag for x in languages if (tag := L.adapter(x).tag)):
            each = index.words().select(F.lit(tag).alias("tag"), F.explode(L.adapter(tag).lemmas(F.col("token"))).alias("lemma"), "token")
            _write(each.repartition("lemma").sortWithinPartitions("lemma", "token"), index.folder("lemmas"), ["tag"], "lemma", ROW_GROUP_BYTES)


def among(column: Column, values: Sequence[str], ranges: int = 16) -> Column:
    """Whether a column has one of the values; besides, in few ranges, so that the files can be asked.

    Long lists of values go down to files as their least and greatest alone.
    """
    listed = sorted(set(values))
    if len(listed) <= 10:
        return column.isin(listed)
    size, within = -(-len(listed) // ranges), F.lit(False)
    for at in range(0, len(listed), size):
        some = listed[at : at + size]
        # a range of one value is asked of the Bloom filters too
        one = column == some[0] if len(some) == 1 else (column >= some[0]) & (column <= some[-1])
        within = one if at == 0 else within | one
    return column.isin(listed) & within


@dataclass
class Index:
    """The index of one snapshot, as put() wrote it."""

    spark: SparkSession
    path: str
    project: str
    snapshot: str

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}/project_id={self.project}/snapshot_id={self.snapshot}"

    def _table(self, name: str) -> DataFrame:
        if not self._exists(f"{self.path}/{name}"):
            # nothing was written: of an empty table
            return self.spark.createDataFrame([], _SHAPES[name])
        rows = self.spark.read.schema(_SHAPES[name]).parquet(f"{self.path}/{name}")
        return rows.where((F.col("project_id") == self.project) & (F.col("snapshot_id") == self.snapshot))

    def blocks(self, tokens: Sequence[str]) -> DataFrame:
        """The blocks of words."""
        tokens = [t for t in tokens if t]
        rows = self._table("blocks").where(among(F.col("token"), tokens))
        if len(tokens) <= BUCKETS:
            one = self.spark.range(1).select(F.array(*(bucket(F.lit(t)) for t in tokens)).cast("array<int>").alias("x")).first()["x"]
            rows = rows.where(F.col("bucket").isin(one))
        return rows

    def segments(self) -> DataFrame:
        """segment, and the ids of its chunks."""
        return self._table("blocks").where((F.col("bucket") == bucket(F.lit(""))) & (F.col("token") == "")).select("segment", "ids")

    def words(self) -> DataFrame:
        """token, df (chunks) and cf (occurrences)."""
        return self._table("words").select("token", "df", "cf")

    def of_lemmas(self, lemmas: Sequence[str], adapter: L.Adapter) -> list[str]:
        """Words of the snapshot that share a lemma with those given: from the written lemmas, or else from the vocabulary."""
        if adapter.tag and self._exists(f"{self.folder('lemmas')}/tag={adapter.tag}"):
            rows = self._table("lemmas").where(F.col("tag") == adapter.tag).where(among(F.col("lemma"), lemmas))
        else:
            rows = self.words().where(F.arrays_overlap(adapter.lemmas(F.col("token")), F.array(*map(F.lit, lemmas)).cast("array<string>")))
        return sorted({r["token"] for r in rows.select("token").collect()})

    def of_forms(self, forms: Sequence[str], adapter: L.Adapter) -> dict[str, str]:
        """Words of the snapshot to the one of the given forms that they are normalised to."""
        if adapter is not L.RUSSIAN:
            return {f: f for f in forms}
        # a form of the fold stands for several words
        norm = adapter.norm(F.col("token"))
        return {r["token"]: r["norm"] for r in self.words().select("token", norm.alias("norm")).where(F.col("norm").isin(list(forms))).collect()}

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def chunk_ids(self, hits: DataFrame) -> DataFrame:
        """Hits (segment, ordinal, ...) with chunk_id instead."""
        named = hits.join(self.segments(), "segment")
        return named.select(F.get("ids", F.col("ordinal")).alias("chunk_id"), *(c for c in hits.columns if c not in ("segment", "ordinal")))

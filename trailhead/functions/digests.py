"""SHA-256 over the rows of a group: in order and in constant memory, and as a tree over key prefixes.

A tree has a leaf for every prefix of three hexadecimal digits that keys have, whose digest is that of its rows in order;
sixteen inner nodes at most, one for each first digit, digest their leaves' prefixes and digests, and the root digests
theirs. Leaves are digested side by side, whatever the number of rows, and two trees differ where their leaves do.
Keys should be spread evenly, as hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_order(rows: DataFrame, by: Sequence[str], order: Sequence[str], line: Column, head: Column, out: str) -> DataFrame:
    """by, the digest (named out) of head and then every row's line in order, and the number of rows n, for each group.

    Rows are dealt by group and sorted, on disk where they are many; a task reads one group after another and holds a
    batch at a time. Without by all rows are one group, which has a row even if it is empty. Lines may not be null.
    """
    names = [f"_o{i}" for i in range(len(order))]
    given = rows.select(*by, *(F.col(c).alias(n) for c, n in zip(order, names)), line.cast("binary").alias("_line"), head.cast("binary").alias("_head"))
    if not by:
        # sorts first, as nulls do, and isn't counted
        nobody = rows.sparkSession.range(1).select(*(F.lit(None).cast(given.schema[n].dataType).alias(n) for n in names), F.lit(None).cast("binary").alias("_line"), head.cast("binary").alias("_head"))
        given = given.unionByName(nobody)
    dealt = given.repartition(*by) if by else given.repartition(1)
    dealt = dealt.sortWithinPartitions(*by, *names).select(*by, "_line", "_head")
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField(out, T.StringType()), T.StructField("n", T.LongType())])
    k = len(by)

    def run(batches):
        now, digest, n = None, None, 0

        def done():
            keys = [pa.array([x], type=t) for x, t in zip(now, types)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=schema.names)

        for batch in batches:
            types = [batch.column(i).type for i in range(k)]
            lines = batch.column(k).cast(pa.large_binary())
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(k)))) if k else [()] * batch.num_rows
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
            data = memoryview(lines.buffers()[2] or b"")
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if digest is None or keys[a] != now:
                    if digest is not None:
                        yield done()
                    now, digest, n = keys[a], hashlib.sha256(batch.column(k + 1)[a].as_py() or b""), 0
                digest.update(data[offsets[a] : offsets[b]])
                n += b - a - lines.slice(a, b - a).null_count
        if digest is not None:
            yield done()

    return dealt.mapInArrow(run, schema)


#: Hexadecimal digits of a leaf's prefix and of an inner node's.
LEAF_DIGITS, NODE_DIGITS = 3, 1
LEAF, NODE = "trailhead/tree-leaf/v1", "trailhead/tree-node/v1"


def leaves(rows: DataFrame, by: Sequence[str], key: Column, order: Sequence[str], line: Column) -> DataFrame:
    """The leaves of each group's tree: by, prefix, digest and n (rows). key: hexadecimal, evenly spread."""
    marked = rows.withColumn("prefix", F.substring(key, 1, LEAF_DIGITS))
    return in_order(marked, [*by, "prefix"], order, line, F.lit(LEAF + "\0"), "digest")


def root(tree: DataFrame, by: Sequence[str], head: Column, out: str) -> DataFrame:
    """The root of each group's tree, named out, and its rows n; without by one row, of an empty tree too."""

    def listed() -> Column:
        each = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat(x["prefix"], F.lit("\0"), x["digest"], F.lit("\0")))
        return F.array_join(each, "")

    inner = tree.groupBy(*by, F.substring("prefix", 1, NODE_DIGITS).alias("prefix")).agg(F.sha2(F.concat(F.lit(NODE + "\0"), listed()), 256).alias("digest"), F.sum("n").alias("n"))
    return inner.withColumn("_head", head).groupBy(*by).agg(F.sha2(F.concat(F.coalesce(F.max("_head"), head), listed()), 256).alias(out), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def differing(before: DataFrame, after: DataFrame) -> list[str]:
    """Prefixes of leaves that two trees don't have alike: 4,096 at most."""
    both = before.select("prefix", F.col("digest").alias("old")).join(after.select("prefix", F.col("digest").alias("new")), "prefix", "full_outer")
    return sorted(r["prefix"] for r in both.where(~F.col("old").eqNullSafe(F.col("new"))).select("prefix").collect())


def under(key: Column, prefixes: Sequence[str], ranges: int = 16) -> Column:
    """Whether a key has one of the prefixes; besides, in few ranges, so that files that are sorted by key can be asked."""
    if not prefixes:
        return F.lit(False)
    size, within = -(-len(prefixes) // ranges), None
    for at in range(0, len(prefixes), size):
        some = prefixes[at : at + size]
        one = (key >= some[0]) & (key < some[-1] + "g")
        within = one if within is None else within | one
    return F.substring(key, 1, LEAF_DIGITS).isin(list(prefixes)) & within

"""Near-duplicates by SimHash candidates and the exact Jaccard similarity of word shingles.

Two texts are linked if at least LEAST of the shingles that either has are in both; documents of linked or equal
shingle sets, taken transitively, form a component.

1. Rows are reduced to distinct shingle sets, each with its smallest id.
2. SimHash fingerprints of 128 bits over the sets draw candidates: bit-sliced comparison in buckets by drawn bits (see
   simhash). Bits of a key go with the logarithm of the number of sets, so that buckets keep their size as the corpus
   grows, and tables with the key, so that a pair of similarity 0.8 shares none with a chance of MISSED. Candidates
   alone link nothing.
3. Sets of one candidate component meet, in parts of bounded size, and are compared exactly, all pairs of a part at
   once, by a product of incidence matrices of their 64-bit shingle hashes.
4. What a component of several parts has left unlinked goes on: first one set for each group linked so far, in parts
   again, until one part holds them all; most groups of copies are one by then. Then, exactly, the sets outside the
   component's largest group against each other and against that group, in pairs of parts. Sets of one group aren't
   compared again, so a group of near copies of any size costs as much as its number of rows.

Defined results: words are split at whitespace, ASCII letters lower-cased; null text counts as empty; texts without
words are equal; texts of fewer words than a shingle are one shingle; repeated rows give repeated rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, simhash

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Words of a fingerprint, and the bits that candidates may differ in; pairs at LEAST differ in about 19 of 128.
WORDS, RADIUS = 2, 34
#: Share of bits that a pair at LEAST has in common, and how likely such a pair may meet in no table.
AGREE, MISSED = 0.8485, 1e-3
#: A bucket has some 2 ** this many sets.
BUCKET_BITS = 7
#: Sets and shingles of a part.
PART_ROWS, PART_SHINGLES = 512, 1 << 21
COLUMNS = 1 << 12


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's shingles, in order."""
    words = text.translate(simhash.LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    line, k, digest = b" ".join(words), min(shingle, len(words)), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a + 1 : b]) for a, b in zip(ends, ends[k:])], np.uint64))


def fingerprint(found: np.ndarray) -> list[int]:
    """The SimHash of a set of hashes: of themselves, and of what a mixer makes of them."""
    mixed = (found ^ found >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return [simhash.majority(found), simhash.majority(mixed ^ mixed >> np.uint64(32))]


def tables_for(n: int) -> tuple[int, int]:
    """(bits of a key, number of tables) for n sets."""
    key_bits = min(40, max(10, max(1, n).bit_length() - BUCKET_BITS))
    return key_bits, ceil(log(MISSED) / log(1 - AGREE**key_bits))


def passes(both, a, b):
    """Whether sets of a and b shingles that have so many in common are similar; of numbers or arrays."""
    top, bottom = LEAST
    return bottom * both >= top * (a + b - both)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sets is LEAST or more."""
    if len(a) > len(b):
        a, b = b, a
    if not passes(len(a), len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return bool(passes(both, len(a), len(b)))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets has in common."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], column[shared]
    # only shingles of two sets or more, numbered anew
    column = (np.cumsum(held > 1) - 1)[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        out += m @ m.T
    return out.astype(np.int64)


def links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first, other) for every set that is linked, directly or through others, to an earlier one."""
    n = len(sets)
    if n == 2:
        return [(0, 1)] if similar(*sets) else []
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    linked = passes(common_counts(sets), sizes[:, None], sizes[None, :])
    out, free = [], np.ones(n, bool)
    for i in range(n):
        if not free[i]:
            continue
        free[i], edge = False, np.array([i])
        while len(edge):
            edge = np.flatnonzero(linked[edge].any(0) & free)
            free[edge] = False
            out += [(i, int(j)) for j in edge]
    return out


def _verify(batches):
    """Links of each (component, part) of rows that come in order."""
    common.begin()
    now, nodes, sets = None, [], []

    def found():
        pairs = links(sets)
        if pairs:
            a, b = (pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    for batch in batches:
        for *key, node, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                yield from found()
                now, nodes, sets = key, [], []
            nodes.append(node)
            sets.append(shingles(text or b""))
    yield from found()


def _checked(rows: DataFrame, *part: Column) -> DataFrame:
    """Exact links (a, b) of the rows (component, node, text) that have the same component and part."""
    names = [f"part{i}" for i in range(len(part))]
    dealt = rows.select("component", *(p.cast("long").alias(n) for p, n in zip(part, names)), "node", "text")
    dealt = dealt.repartition("component", *names).sortWithinPartitions("component", *names, "node")
    return common.map_texts(dealt, _verify, "a long, b long")


def _parts(rows: Column, size: Column, part_rows: int) -> Column:
    """Number of parts for so many rows and shingles."""
    return F.greatest(F.ceil(rows / part_rows), F.ceil(size / PART_SHINGLES), F.lit(1)).cast("long")


def _with_small(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join with a written table: by broadcast up to 100,000 rows, an ordinary one beyond."""
    return df.join(F.broadcast(small) if small.limit(100_001).count() <= 100_000 else small, on, how)


def _sized(members: DataFrame, part_rows: int) -> DataFrame:
    """Components that need several parts: component, parts."""
    parts = _parts(F.count("*"), F.sum("size"), part_rows).alias("parts")
    return members.groupBy("component").agg(parts).where("parts > 1")


def _groups(members: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """members (component, node, size, text) with label: the least node that the links reach."""
    if pairs is None:
        return members.withColumn("label", F.col("node"))
    found = simhash.components(pairs).select("node", F.col("component").alias("label"))
    return members.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))


def verified(members: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Exact links (a, b) that span the components within candidate components; members: component, node, size, text."""
    large = common.materialize(_sized(members, part_rows), "near-large")
    dealt = _with_small(members, large, "component", "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    found = [common.materialize(_checked(dealt, own), "near-links")]
    if not large.limit(1).count():
        return found[0]
    rest = common.materialize(_with_small(members, large, "component", "left_semi"), "near-rest")

    def labelled() -> DataFrame:
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.unionByName(more)
        return common.materialize(_groups(rest, pairs), "near-labelled")

    groups, before = labelled(), None
    while True:
        # one set for each group, as long as that brings the groups down
        first = groups.where("node = label")
        several = common.materialize(first.groupBy("component").agg(F.count("*").alias("n"), _parts(F.count("*"), F.sum("size"), part_rows).alias("parts")).where("n > 1"), "near-several")
        left, most = several.agg(F.sum("n"), F.max("parts")).first()
        if not left or before is not None and left > 0.9 * before:
            break
        before = left
        dealt = _with_small(first, several.select("component", "parts"), "component")
        found.append(common.materialize(_checked(dealt, F.pmod(F.xxhash64("node"), "parts")), "near-links"))
        groups = labelled()
    if not left:
        return _all(found)
    return _all([*found, _between(groups, part_rows)])


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _between(groups: DataFrame, part_rows: int) -> DataFrame:
    """Links between the groups (label) of a component: all sets outside its largest group, with each other and with that."""
    counts = groups.groupBy("component", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    main = F.max_by(F.struct("label", "n", "size"), F.struct("n", "label")).alias("main")
    stats = counts.groupBy("component").agg(main, F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > main.n")
    stats = stats.select(
        "component",
        F.col("main.label").alias("main"),
        _parts(F.col("main.n"), F.col("main.size"), part_rows).alias("main_parts"),
        _parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"), part_rows).alias("other_parts"),
    )
    rows = _with_small(groups, common.materialize(stats, "near-between"), "component")
    mains, others = (F.sequence(F.lit(0).cast("long"), F.col(f"{k}_parts") - 1) for k in ("main", "other"))
    in_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(in_main, F.col("main_parts")).otherwise(F.col("other_parts")))
    # (kind, part, part): others with others, others with the main group
    pair = F.struct
    zero, one = F.lit(0), F.lit(1)
    with_others = F.transform(others, lambda o: pair(zero.alias("kind"), F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
    with_main = F.transform(mains, lambda m: pair(one.alias("kind"), own.alias("x"), m.alias("y")))
    of_main = F.transform(others, lambda o: pair(one.alias("kind"), o.alias("x"), own.alias("y")))
    dealt = rows.withColumn("meets", F.explode(F.when(in_main, of_main).otherwise(F.concat(with_others, with_main))))
    return _checked(dealt, F.col("meets.kind"), F.col("meets.x"), F.col("meets.y"))


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), part_rows: int = PART_ROWS) -> DataFrame:
    """One row per input row: doc_id (a distinct number), component_id (the smallest one reachable).

    carry names further input columns, returned as one struct named carried.
    """
    carried = [F.struct(*carry).alias("carried")] if carry else []
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carried)
    own = ["doc_id", *(["carried"] if carry else [])]
    prints_of = simhash.names(WORDS)
    fields = [T.StructField("digest", T.BinaryType()), T.StructField("size", T.LongType()), *(T.StructField(c, T.LongType()) for c in prints_of)]

    def make():
        def fn(column: pa.Array):
            got = [shingles(t or b"") for t in column.cast(pa.binary()).to_pylist()]
            fps = np.array([fingerprint(x) for x in got], np.int64).reshape(-1, WORDS).T
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in got], pa.binary())
            return [digests, pa.array([len(x) for x in got], pa.int64()), *(pa.array(x, pa.int64()) for x in fps)]

        return fn

    prints = common.materialize(common.with_columns(picked, ["text"], fields, make, own), "sets")
    # equal sets have equal fingerprints
    same = [F.any_value(c).alias(c) for c in ("size", *prints_of)]
    nodes = common.materialize(prints.groupBy("digest").agg(F.min("doc_id").alias("node"), *same), "nodes")
    key_bits, tables = tables_for(nodes.count())
    pairs = simhash.near_pairs(nodes.where("size > 0"), RADIUS, WORDS, tables, key_bits)
    grouped = simhash.components(pairs).join(nodes.select("node", "size"), "node")
    # the texts are dealt once, by the same join at every size; of candidates only
    texts = picked.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("text"))
    members = common.materialize(texts.join(grouped.hint("merge"), "node").select("component", "node", "size", "text"), "candidates")
    found = simhash.components(verified(members, part_rows))
    whole = nodes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return prints.join(whole, "digest").select(*own, "component_id")

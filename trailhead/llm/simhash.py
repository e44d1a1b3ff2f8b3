"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit set where more than half of the text's shingle hashes have it set. Two fingerprints within
`radius` differing bits are linked; documents of linked or equal fingerprints, taken transitively, form a component.

1. Rows are reduced to distinct fingerprints, each with its smallest id, before anything is compared.
2. The 64 bits are cut into radius + 2 blocks. Fingerprints within the radius agree in at least two blocks, so each
   goes to one bucket for each pair of blocks, and no link is missed. Beyond MANY fingerprints there is one block
   more, and a bucket for each three, so that buckets stay small; the links are the same.
3. Buckets of one task lie side by side in order. Bit planes are stored vertically: one plane of 64-bit words holds
   one bit of 64 neighbours. For each distance d in that order, the planes and the planes shifted by d are combined;
   carry-save counters in bit-sliced form (one word per counter digit) add up 64 distances at a time, and words whose
   64 lanes have all passed the radius, or aren't of one bucket, are abandoned. d goes up to the longest bucket.
4. Buckets beyond `bucket_rows` are split into parts, and each pair of parts is compared in a bucket of its own.
   (Wide radii, for which too many buckets would be needed: fingerprints of several words, and buckets by the values
   of a few bits drawn for each of many tables. Links may then be missed; the README has the measured share.)
5. Of the links of a bucket only those of each group's members to its first are returned; components come from rounds of label propagation with
   pointer jumping over tables in the shared folder. Nothing is gathered on the driver.

Defined results: null text counts as empty; a text without words has fingerprint zero, linked like any other; texts
of fewer words than a shingle hash the whole sequence; rows whose id is null link others like any row, and have a
null component only if no row with an id is reachable; repeated rows give repeated rows; an empty table gives no rows; columns beyond id and text
are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 64
SEED = 42
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
ONE = np.uint64(1)
MANY = 1 << 28


def fingerprint(text: bytes, shingle: int = 4, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """The fingerprint as signed 64-bit integers, one for each seed of the hash."""
    words = text.translate(LOWER).split()
    if not words:
        return [0] * len(seeds)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    line = b" ".join(words)
    k = min(shingle, len(words))
    parts = [line[a + 1 : b] for a, b in zip(ends, ends[k:])]
    digest = xxhash.xxh64_intdigest
    return [majority(np.array([digest(p, seed) for p in parts], np.uint64)) for seed in seeds]


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as a signed number."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def names(n: int) -> list[str]:
    """The columns of a fingerprint of n words."""
    return [f"fp{i}" for i in range(n)]


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, seeds: tuple[int, ...] = (SEED,), keep=None) -> DataFrame:
    """Add each text's fingerprint: a long for each seed, fp0 and so on."""
    fields = [T.StructField(n, T.LongType()) for n in names(len(seeds))]

    def make():
        def fn(column: pa.Array):
            got = [fingerprint(t or b"", shingle, seeds) for t in column.cast(pa.binary()).to_pylist()]
            return [pa.array(x, pa.int64()) for x in np.array(got, np.int64).reshape(-1, len(seeds)).T]

        return fn

    return common.with_columns(docs, [text], fields, make, keep)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def bucket_keys(fp: Column, radius: int, agree: int = 2) -> Column:
    """One key for each choice of `agree` of radius + agree blocks of bits: fingerprints within the radius share one."""
    n = radius + agree
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    widths = [b - a for a, b in zip(edges, edges[1:])]

    def key(number: int, chosen: tuple[int, ...]) -> Column:
        out, place = F.lit(number << 40), 0
        for i in chosen:
            out, place = out.bitwiseOR(F.shiftleft(blocks[i], place)), place + widths[i]
        return out

    return F.array(*(key(number, chosen) for number, chosen in enumerate(combinations(range(n), agree))))


def sampled_keys(nodes: DataFrame, n_words: int, tables: int, key_bits: int) -> DataFrame:
    """key, node and fingerprint: a row for each table, whose key is the values of bits drawn for that table."""
    rng = np.random.default_rng(SEED)
    drawn = [np.sort(rng.choice(n_words * BITS, key_bits, replace=False)) for _ in range(tables)]
    cols = names(n_words)

    def run(batches):
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns[1:]]
            for number, bits in enumerate(drawn):
                key = np.full(batch.num_rows, number << 40, np.int64)
                for k, b in enumerate(bits):
                    key |= (x[b // BITS] >> np.uint64(b % BITS) & ONE).astype(np.int64) << k
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names=["key", "node", *cols])

    return nodes.select("node", *cols).mapInArrow(run, ", ".join(f"{c} long" for c in ("key", "node", *cols)))


def vertical(x: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows of words): 64 rows of lane words for each word of a fingerprint.

    Lane i of lane word w belongs to fingerprint 64 w + i.
    """
    x = x.reshape(len(x), -1)
    padded = np.zeros((-(-len(x) // 64) * 64, x.shape[1]), np.uint64)
    padded[: len(x)] = x
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(planes: np.ndarray, shifted: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of each word whose planes differ in at most radius places; lanes: those that count at all.

    The counters start so that they run over into `over` with the first difference beyond the radius.
    """
    digits = max(1, (radius + 1).bit_length())
    start = (1 << digits) - 1 - radius
    alive = np.flatnonzero(lanes)
    over = ~lanes[alive]
    counter = [np.full(len(alive), ~np.uint64(0) if start >> k & 1 else np.uint64(0)) for k in range(digits)]
    for b in range(len(planes)):
        carry = planes[b, alive] ^ shifted[b, alive]
        for k in range(digits):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 8 == 7:
            keep = over != ~np.uint64(0)
            if not keep.all():
                alive, over = alive[keep], over[keep]
                counter = [c[keep] for c in counter]
            if not len(alive):
                break
    out = np.zeros(len(lanes), np.uint64)
    out[alive] = ~over
    return out


def _shift(planes: np.ndarray, d: int) -> np.ndarray:
    """The planes with lane i holding what lane i + d held."""
    whole, rest = divmod(d, 64)
    moved = np.zeros_like(planes)
    n = planes.shape[1] - whole
    if n > 0:
        moved[:, :n] = planes[:, whole:]
        if rest:
            moved >>= np.uint64(rest)
            if n > 1:
                moved[:, : n - 1] |= planes[:, whole + 1 :] << np.uint64(64 - rest)
    return moved


def links(run: np.ndarray, x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """For each fingerprint that is linked to others of its run: (first of those that it reaches there, itself).

    Positions are those of the arrays, in which runs lie side by side. As runs are in order of the node, the first is
    that of the least node, so that the same group gives much the same links in many tables.
    """
    n = len(x)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(starts, n))
    touched: set[int] = set()
    at = np.arange(n)
    left = np.repeat(starts + sizes, sizes) - at  # members from here to the run's end
    planes, low = None, 0
    for d in range(1, int(sizes.max(initial=0))):
        if planes is None or 2 * (left > d).sum() < len(at) and d > low + 4:
            # only runs longer than d stay
            keep = np.repeat(sizes > d, sizes)
            at, left, sizes = at[keep], left[keep], sizes[sizes > d]
            planes, low = vertical(x[at]), d
        mask = np.zeros(planes.shape[1] * 64, bool)
        mask[: len(at)] = left > d
        lanes = np.packbits(mask, bitorder="little").view(np.uint64)
        got = near(planes, _shift(planes, d), lanes, radius)
        for i in np.flatnonzero(np.unpackbits(got.view(np.uint8), bitorder="little")):
            a, b = int(at[i]), int(at[i + d])
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                touched.update((a, b))
    return [(r, i) for i in sorted(touched) if (r := root(i)) != i]


def _search(radius: int, batch_rows: int):
    """Links within the runs of (key, part) of rows that come in order: node pairs."""

    def run(batches):
        common.begin()
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush(last: bool):
            nonlocal held, rows
            key, part, node, *fps = (np.concatenate(c) for c in zip(*held))
            change = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            end = len(key) if last else int(change[-1]) if len(change) else 0
            number = np.zeros(len(key), np.int64)
            number[change] = 1
            x = np.stack(fps, 1).view(np.uint64)
            pairs = links(np.cumsum(number)[:end], x[:end], radius) if end else []
            held, rows = [[c[end:] for c in (key, part, node, *fps)]], len(key) - end
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= batch_rows:
                yield from flush(False)
        if rows:
            yield from flush(True)

    return run


def near_pairs(nodes: DataFrame, radius: int = 4, n_words: int = 1, tables: int = 0, key_bits: int = 20, agree: int = 2, bucket_rows: int = 4096, batch_rows: int = 100_000) -> DataFrame:
    """Links (a, b) that span each component of nodes (node, fp0, ...), one row for each distinct fingerprint.

    With tables = 0 (one word only) no link is missed; else two fingerprints meet if they agree in all key_bits of a
    table.
    """
    cols = names(n_words)
    if tables:
        keyed = sampled_keys(nodes, n_words, tables, key_bits)
    elif n_words == 1:
        keyed = nodes.select(F.explode(bucket_keys(F.col("fp0"), radius, agree)).alias("key"), "node", "fp0")
    else:
        raise ValueError("fingerprints of several words need tables")
    large = keyed.groupBy("key").count().where(F.col("count") > bucket_rows)
    large = common.materialize(large.select("key", F.ceil(F.col("count") / bucket_rows).alias("parts")), "large-buckets")
    n_large = large.count()
    if n_large:
        # few, as each is large; beyond that bound an ordinary join
        both = keyed.join(F.broadcast(large) if n_large <= 100_000 else large, "key", "left")
        parts = F.coalesce("parts", F.lit(1))
        own = F.pmod(F.xxhash64("node"), parts)
        other = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
        both = both.select("key", "node", *cols, parts.alias("parts"), own.alias("own"), other.alias("other"))
        part = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
    else:
        both, part = keyed, F.lit(0).cast("long")
    dealt = both.select("key", part.alias("part"), "node", *cols).repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return dealt.mapInArrow(_search(radius, batch_rows), "a long, b long")


def _followed(up: DataFrame, rounds: int) -> DataFrame:
    """Each node's pointer (node, to; to a lesser node) followed to its end, by doubling."""
    for _ in range(rounds):
        further = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = up.join(further, "to", "left").select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
        new = common.materialize(new, "pointers")
        common.discard(up)
        up = new.select("node", "to")
        up.scratch_path = new.scratch_path
        if not new.where("moved").limit(1).count():
            return up
    raise RuntimeError("pointers didn't settle")


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node of each component, for the nodes that have a link: node, component.

    Each round points every node that has a lesser neighbour to the least one, follows the pointers to their ends, and
    draws the links between the ends that are left; most links vanish in the first round. All of it is tables in the
    shared folder.
    """
    edge = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = common.materialize(pairs.where("a <> b").select(edge.alias("e")).select("e.*").distinct(), "links")
    known = None
    for _ in range(rounds):
        # a link's greater end has a lesser neighbour
        up = _followed(common.materialize(edges.groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "node"), "pointers"), rounds)
        if known is None:
            known = up
        else:
            last = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
            known = known.join(last, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
            # ends that a later round points on were nobody's node before
            known = known.unionByName(up.join(known.select("node"), "node", "left_anti"))
            known = common.materialize(known, "components")
        ends = up.select(F.col("node").alias("b"), F.col("to").alias("b_end"))
        moved = edges.join(ends, "b", "left").select("a", F.coalesce("b_end", "b").alias("b"))
        ends = up.select(F.col("node").alias("a"), F.col("to").alias("a_end"))
        moved = moved.where("a <> b").distinct().join(ends, "a", "left").select(F.coalesce("a_end", "a").alias("a"), "b")
        edges = common.materialize(moved.where("a <> b").select(edge.alias("e")).select("e.*").distinct(), "links")
        if not edges.limit(1).count():
            roots = known.select(F.col("to").alias("node")).distinct()
            return known.unionByName(roots.withColumn("to", F.col("node"))).withColumnRenamed("to", "component")
    raise RuntimeError("components didn't settle")


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, seeds: tuple[int, ...] = (SEED,), tables: int = 0, key_bits: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, the fingerprint (fp0, ... for each seed), component_id (the smallest id reachable).

    carry names further input columns, returned as one struct named carried.
    """
    cols = names(len(seeds))
    carried = [F.struct(*carry).alias("carried")] if carry else []
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carried)
    own = ["doc_id", *(["carried"] if carry else [])]
    prints = common.materialize(fingerprints(picked, shingle=shingle, seeds=seeds, keep=own), "fingerprints")
    # numbers of their own, as an id may be null
    each = prints.groupBy(*cols).agg(F.min("doc_id").alias("least"))
    nodes = common.materialize(each.withColumn("node", F.monotonically_increasing_id()), "nodes")
    agree = 2 if nodes.count() < MANY else 3
    found = components(near_pairs(nodes, radius, len(seeds), tables, key_bits, agree))
    known = nodes.join(found, "node", "left").select(*cols, "least", F.coalesce("component", "node").alias("component"))
    known = common.materialize(known, "known")
    # all but the groups of one fingerprint; the minimum is taken before rows are dealt
    least = common.materialize(known.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    whole = known.join(least, "component").select(*cols, "component_id")
    return prints.join(whole, cols).select(*own, *cols, "component_id")

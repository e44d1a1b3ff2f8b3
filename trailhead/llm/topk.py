"""Exact top-k by inner product, without random access: bounds from sorted lists read in order.

Every dimension of a block of candidates is a list sorted by value. A query reads all of its lists in step, slice by
slice: from the top where its weight is positive, from the bottom where it is negative. What a slice holds is added to
its candidates' partial sums, and nothing else about a candidate is looked at. A dimension that hasn't shown a
candidate yet adds at most the list's frontier and at least its far end, which gives every candidate an upper and a
lower bound. The k-th best lower bound, or the k-th best score known from earlier blocks, is the bar; candidates
whose upper bound is under it are outsiders and are dropped. Reading stops when nobody is left; else it goes on, past
the entries of outsiders, until the sums of those that are left are their scores.

The lists of a block are sorted once for all queries, and so are the marks of which dimensions a depth has shown, in
bits. The first slice is read for a group of queries at a time: what it holds, and nothing else, is laid out by
candidate (zero where a list hasn't shown it) and multiplied with the group's positive or negative weights. Later
slices are read by each query on its own, as its outsiders are its own. Each task keeps k rows for each query over all of its blocks; a ranking over the tasks' rows gives the result.
Queries are a written table, of which slices of at most slice_rows go to all tasks, one after another, each with a
scan of its own whose rows are written before the next; the driver holds one slice.

Scores are sums of integer products of floor(scale * x), exact in float64 below 2^53; a block whose scores might go
beyond is multiplied out in 64-bit integers.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, as query or candidate;
a query's candidates are all rows of another id; ties go to the smaller id; repeated rows are repeated candidates,
and a repeated query is one query for each row; vectors of different lengths count as filled up with zeros; null ids
take no part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Depths, as shares of a list's length, at which bounds are taken.
DEPTHS = (0.6, 0.75, 1.0)
BLOCK_ROWS = 4096
GROUP = 64
SLICE_ROWS = 20_000
NONE = np.iinfo(np.int64).min

#: For each byte of marks, which of its eight dimensions are still unseen.
UNSEEN = 1.0 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def quantized(column: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as doubles; null for vectors that take no part."""
    x = F.transform(column, lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(usable, F.transform(x, lambda v: F.floor(v * scale).cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, cut or filled with zeros to a width."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    ends = np.cumsum(lengths)
    for i, (a, b) in enumerate(zip(ends - lengths, ends)):
        n = min(width, b - a)
        out[i, :n] = values[a : a + n]
    return out


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), NONE)
        self.ids = np.zeros((n, k), np.int64)

    def bar(self, i: int) -> int:
        """The k-th best score of a query; NONE as long as it has fewer."""
        return int(self.scores[i].min())

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        have = self.scores[i] > NONE
        s, d = np.concatenate([self.scores[i][have], scores]), np.concatenate([self.ids[i][have], ids])
        best = np.lexsort((d, -s))[: self.k]
        self.scores[i, : len(best)], self.ids[i, : len(best)] = s[best], d[best]


class Lists:
    """The sorted lists of a block (dimensions x candidates), from the top (0) and from the bottom (1)."""

    def __init__(self, block: np.ndarray, depths=DEPTHS):
        self.n = block.shape[1]
        up = np.argsort(block, axis=1, kind="stable")
        self.ids = np.stack([up[:, ::-1], up])
        self.values = np.take_along_axis(block[None], self.ids, axis=2)
        self.ends = sorted({min(self.n, max(1, int(np.ceil(d * self.n)))) for d in depths})
        rank = np.empty_like(up)
        np.put_along_axis(rank, up, np.arange(self.n)[None], axis=1)
        # marks: for each depth and side, the dimensions that have shown a candidate, as bits (bytes x candidates)
        self.marks = [
            [np.ascontiguousarray(np.packbits(r < end, axis=0, bitorder="little")) for r in (self.n - 1 - rank, rank)] for end in self.ends
        ]

        # the first slice from either side, by candidate
        shown = [np.where(r < self.ends[0], block, 0.0) for r in (self.n - 1 - rank, rank)]
        self.first = [x.astype(np.float32) for x in shown], shown
        self.most = np.abs(block).max(initial=0.0)

    def opening(self, queries: np.ndarray) -> np.ndarray:
        """Each query's sums over the first slice of its lists (queries x candidates)."""
        # integers: float32 is exact below 2^24
        narrow = np.abs(queries).sum(1).max(initial=0.0) * self.most < 1 << 24
        top, bottom = self.first[0 if narrow else 1]
        q = queries.astype(top.dtype)
        return np.maximum(q, 0) @ top + np.minimum(q, 0) @ bottom

    def search(self, w: np.ndarray, opening: np.ndarray, k: int, bar: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(candidates that may be among the k best, their scores, entries read) of a query.

        opening: its sums over the first slice; own: the places of candidates that don't count.
        """
        n, dims = self.n, np.flatnonzero(w)
        side = (w < 0).astype(np.intp)[dims]
        weights = w[dims]
        down = np.packbits(w < 0, bitorder="little")[:, None]
        total = opening.astype(np.float64)
        total[own] = -np.inf
        alive = wanted = None
        begin, floor = self.ends[0], -np.inf if bar == NONE else float(bar)
        read = begin * len(dims)
        for end, marks in zip(self.ends, self.marks):
            if end > begin:
                ids = self.ids[side, dims, begin:end]
                read += ids.size
                if wanted is None:
                    added = self.values[side, dims, begin:end] * weights[:, None]
                    total += np.bincount(ids.ravel(), added.ravel(), n)
                else:
                    # entries of outsiders are passed by
                    at = np.flatnonzero(wanted.take(ids))
                    row, place = np.divmod(at, ids.shape[1])
                    added = self.values[side[row], dims[row], begin + place] * weights[row]
                    total += np.bincount(ids.ravel()[at], added, n)
                begin = end
            if end == n:
                break
            seen = [m if alive is None else m.take(alive, axis=1) for m in marks]
            seen = seen[0] & ~down | seen[1] & down
            known = total if alive is None else total[alive]
            if len(known) > k and (floor == -np.inf or 4 * len(known) <= n):
                lower = known + self._rest(seen, w, side, dims, n - 1)
                floor = max(floor, np.partition(lower, len(lower) - k)[len(lower) - k])
            stay = np.flatnonzero(known + self._rest(seen, w, side, dims, end - 1) >= floor)
            alive = stay if alive is None else alive[stay]
            if not len(alive):
                break
            if 2 * len(alive) <= n:
                wanted = np.zeros(n, bool)
                wanted[alive] = True
        alive = np.arange(n) if alive is None else alive
        alive = alive[total[alive] > -np.inf]
        return alive, total[alive].astype(np.int64), read

    def _rest(self, seen: np.ndarray, w: np.ndarray, side: np.ndarray, dims: np.ndarray, at: int) -> np.ndarray:
        """What unseen dimensions add to each candidate if each had the value at a place of its list."""
        each = np.zeros(8 * len(seen))
        each[dims] = self.values[side, dims, at] * w[dims]
        tables = each.reshape(-1, 8) @ UNSEEN.T
        out = np.zeros(seen.shape[1])
        for table, column in zip(tables, seen):
            out += table.take(column)
        return out


def search_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Search one block (dimensions x candidates) for all queries; returns the list entries that were read."""
    lists, read = Lists(block), 0
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    low, high = (np.searchsorted(sorted_ids, query_ids, side) for side in ("left", "right"))
    for at in range(0, len(queries), GROUP):
        group = queries[at : at + GROUP]
        exact = np.abs(group).sum(1) * lists.most < 1 << 53
        opening = lists.opening(np.where(exact[:, None], group, 0))
        for i, w in enumerate(group, at):
            own = order[low[i] : high[i]]
            if exact[i - at]:
                alive, scores, n = lists.search(w, opening[i - at], best.k, best.bar(i), own)
            else:
                alive = np.delete(np.arange(len(ids)), own)
                scores, n = w.astype(np.int64) @ block.astype(np.int64)[:, alive], block.size
            read += n
            if len(alive):
                best.add(i, ids[alive], scores)
    return read


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows among the rows of another id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), quantized(F.col(embedding), scale).alias("x"), is_query.alias("q")).where("id is not null and x is not null")
    asked = common.materialize(rows.where("q").select(F.monotonically_increasing_id().alias("number"), "id", "x"), "queries")
    slices = max(1, -(-asked.count() // slice_rows))
    found = None
    for number in range(slices):
        some = asked.where(F.pmod(F.xxhash64("number"), F.lit(slices)) == number).toArrow()
        part = rows.select("id", "x").mapInArrow(_searcher(some, k), "number long, query long, id long, score long")
        if slices > 1:
            part = common.materialize(part, "best")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _searcher(some: pa.Table, k: int):
    column = some.column("x").combine_chunks()
    width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
    query_ids, numbers = some.column("id").to_numpy(), some.column("number").to_numpy()
    queries = _matrix(column, width) if len(query_ids) else np.zeros((0, 0))

    def run(batches):
        best = Best(len(query_ids), k)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def read():
            ids, x = (np.concatenate(c) for c in zip(*held))
            search_block(queries, query_ids, np.ascontiguousarray(x.T), ids, best)

        for batch in batches:
            if not len(query_ids):
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            for at in range(0, len(ids), BLOCK_ROWS):
                held.append((ids[at : at + BLOCK_ROWS], x[at : at + BLOCK_ROWS]))
                rows += len(held[-1][0])
                if rows >= BLOCK_ROWS:
                    read()
                    held, rows = [], 0
        if held:
            read()
        at, j = np.nonzero(best.scores > NONE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[at]), pa.array(query_ids[at]), pa.array(best.ids[at, j]), pa.array(best.scores[at, j])], names=["number", "query", "id", "score"]
        )

    return run

"""Vector codes: product quantisation, trained by RDD tree aggregation over columnar NumPy blocks.

Components become whole numbers, floor(scale * x). Rows are packed into blocks, each a table row of its own: the ids, the
labels, and the components dimension by dimension in the narrowest type that holds them. A vector's dimensions are cut
into equal consecutive parts; each position has a codebook, at first that part of the vectors of the smallest ids. A
round assigns every part to the nearest entry of its codebook (squared distances, summed up dimension by dimension;
ties to the lower index) and replaces each entry by the mean of its parts, rounded down; entries that nothing was
assigned to stay. Sums and counts are tensors of whole numbers (position, entry, dimension), added to with np.add.at
block by block and merged through RDD.treeAggregate, so that the driver gets a few of them, of a size that doesn't depend on
the number of rows. The first entries come the same way: every task keeps its smallest, and so does every merge.

Everything is exact: 32-bit integers where no distance can leave them, else 64-bit ones, else Python's.

Defined results: vectors that are null or hold null, NaN or infinite components are dropped; shorter vectors count as
filled up with zeros to the longest one's length, and that to a multiple of the number of parts; rows without an id are
coded too, and come last among the smallest ids; of rows of one id the one of the smaller components (compared one
after another) comes first; repeated rows are coded each; with fewer vectors than entries the codebooks are that much
smaller; an empty table gives no rows; errors beyond a 64-bit integer are null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK_ROWS = 2048


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: which rows are usable, where each begins and ends, in the values of the column."""
    at = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    bad = ~np.isfinite(values.to_numpy(zero_copy_only=False)) | values.is_null().to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(bad)])
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (before[at[1:]] == before[at[:-1]])
    return usable, at[:-1], at[1:]


def _pack(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their components: dimensions x rows, as doubles)."""
    usable, begin, end = _rows(column)
    begin, size = begin[usable], (end - begin)[usable]
    width, values = int(size.max(initial=0)), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), width))
    inside = np.arange(width) < size[:, None]
    out[inside] = values[(begin[:, None] + np.arange(width))[inside]]
    return usable, np.floor(out.T * scale)


def _narrow(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(initial=0.0)
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8")


def blocks(vectors: DataFrame, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Blocks of the usable rows, written to the shared folder: ids, labels, n, width, kind, x."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    kind = rows.schema["label"].dataType
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kind)), T.StructField("n", T.IntegerType()),
            T.StructField("width", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("x", T.BinaryType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                usable, x = _pack(some.column(2), scale)
                n = x.shape[1]
                if not n:
                    continue
                keep, packed = pa.array(usable), _narrow(x)
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.filter(keep))
                yield pa.RecordBatch.from_arrays(
                    [one(some.column(0)), one(some.column(1)), pa.array([n], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([packed.dtype.str]), pa.array([packed.tobytes()])],
                    names=schema.names,
                )

    return common.materialize(rows.mapInArrow(run, schema), "vector-blocks")


@dataclass(frozen=True)
class Shape:
    """How vectors are cut: dimensions altogether (a multiple of the parts), and parts."""

    width: int
    parts: int

    def block(self, kind: str, width: int, n: int, x: bytes) -> np.ndarray:
        """A block's components: parts x dimensions of a part x rows."""
        out = np.zeros((self.width, n), np.dtype(kind))
        out[:width] = np.frombuffer(x, kind).reshape(width, n)
        return out.reshape(self.parts, self.width // self.parts, n)


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles without fractions as 64-bit integers where these hold them, else as Python's."""
    if x.dtype.kind != "f":
        return x
    if np.abs(x).max(initial=0.0) < 1 << 62:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each part: parts x rows. books: parts x entries x dimensions."""
    block = _whole(block)
    most = sum(int(np.abs(a).max()) if a.size else 0 for a in (block, books))
    bound = most * most * books.shape[2]
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
    block, books = block.astype(kind), books.astype(kind)
    parts, dims, n = block.shape
    codes, errors = np.empty((parts, n), np.intp), np.empty((parts, n), object if kind is object else np.int64)
    for p in range(parts):
        distance = np.zeros((books.shape[1], n), kind)
        for d in range(dims):
            apart = books[p, :, d, None] - block[p, d]
            distance += apart * apart
        codes[p] = distance.argmin(0)
        errors[p] = distance[codes[p], np.arange(n)]
    return codes, errors


def _add(books: np.ndarray, block: np.ndarray, so_far):
    """Sums and counts of what is assigned to each entry, with those so far."""
    if so_far is None:
        so_far = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    sums, counts = so_far
    codes, _ = assign(block, books)
    values = _whole(block)
    if values.dtype == object or int(np.abs(values.astype(np.int64)).max(initial=0)) >= 1 << 31:
        # 2^31 rows of 2^31 each may be added as 64-bit integers
        sums = sums.astype(object)
    place = np.arange(len(codes))[:, None], codes
    np.add.at(sums, place, values.transpose(0, 2, 1).astype(sums.dtype))
    np.add.at(counts, place, 1)
    return sums, counts


def _merge(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def _smallest(many: int):
    """Functions that keep the vectors of so many smallest ids: of a block and those so far, and of two such lists."""
    order = lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1])

    def add(best, row):
        ids, kind, width, n, x = row
        x = np.frombuffer(x, kind).reshape(width, n)
        low = sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0))
        # as far as ids go with the last that may be among the best
        if n > many:
            last = ids[low[many - 1]]
            low = low[:many] + [i for i in low[many:] if ids[i] == last]
        return sorted([*best, *((ids[i], [int(v) for v in x[:, i]]) for i in low)], key=order)[:many]

    return add, lambda a, b: sorted([*a, *b], key=order)[:many]


@dataclass(frozen=True)
class Codebooks:
    """shape, and the entries: parts x entries x dimensions of a part."""

    shape: Shape
    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in order."""
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel()).encode()).hexdigest()


def train(packed: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of blocks; of an empty table without entries."""
    longest = packed.agg(F.max("width")).first()[0] or 0
    shape = Shape(-(-longest // parts) * parts, parts)
    rows = packed.select("ids", "kind", "width", "n", "x").rdd
    first = rows.treeAggregate([], *_smallest(entries))
    books = np.zeros((len(first), shape.width), object)
    for i, (_, x) in enumerate(first):
        books[i, : len(x)] = x
    books = _plain(books.reshape(len(first), parts, shape.width // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        now = books
        sums, counts = rows.treeAggregate(None, lambda so_far, r: _add(now, shape.block(*r[1:]), so_far), _merge)
        used = counts > 0
        books = _plain(np.where(used[:, :, None], sums // np.where(used, counts, 1)[:, :, None], now))
    return Codebooks(shape, books)


def _plain(x: np.ndarray) -> np.ndarray:
    """64-bit integers where they hold all values."""
    return x.astype(np.int64) if x.dtype != object or all(abs(v) < 1 << 62 for v in x.ravel()) else x


def encode(packed: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part) and error (squared distance) of every row of the blocks."""
    label = packed.schema["labels"].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    shape, entries = books.shape, books.entries
    if entries.shape[1] > 256:
        raise ValueError("a code has two hexadecimal digits, so 256 entries at most")

    def run(batches):
        for batch in batches:
            ids, labels, n, width, kind, x = batch.columns
            for i in range(batch.num_rows):
                codes, errors = assign(shape.block(kind[i].as_py(), width[i].as_py(), n[i].as_py(), x[i].as_py()), entries)
                digits, each = codes.T.astype(np.uint8).tobytes().hex(), 2 * shape.parts
                # none is larger where they are 64-bit integers: their sum is one of fewer terms than the bound allows for
                total = [t if t < 1 << 63 else None for t in errors.astype(object).sum(0)] if errors.dtype == object or int(errors.max(initial=0)) >= (1 << 63) // shape.parts else errors.sum(0)
                text = [digits[at : at + each] for at in range(0, len(digits), each)]
                yield pa.RecordBatch.from_arrays([ids[i].values, labels[i].values, pa.array(text, pa.string()), pa.array(total, pa.int64())], names=schema.names)

    return packed.mapInArrow(run, schema)


def decode(coded: DataFrame, books: Codebooks, code: str = "code", out: str = "decoded") -> DataFrame:
    """Add the vector that a code stands for, in whole numbers; null for a null code."""
    entries = books.entries

    def make():
        def fn(column: pa.Array):
            rows = [None if c is None else entries[np.arange(len(entries)), list(bytes.fromhex(c))].ravel().tolist() for c in column.to_pylist()]
            return (pa.array(rows, pa.list_(pa.int64())),)

        return fn

    return common.with_columns(coded, [code], [T.StructField(out, T.ArrayType(T.LongType()))], make)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """encode()'s rows with label_error, the error summed over all rows of the label, nulls together.

    The coded rows are written once. Errors are summed up within tasks first, and the sums, a row a label, are written
    too, so that Spark knows their size: small ones are broadcast, else both sides are joined by label, where adaptive
    execution splits a label that holds many rows.
    """
    rows = common.materialize(coded, "vector-codes")
    sums = common.materialize(rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")

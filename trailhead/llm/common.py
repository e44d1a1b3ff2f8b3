"""What the operators of this subpackage share: scratch tables, Arrow column maps and row ids."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDS = 5
PORTION_BYTES = 2 << 20
#: Rows of an Arrow batch of texts, where the session has Spark's own bound.
BATCH_ROWS, SPARKS_BATCH_ROWS = 1000, 10_000


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir.

    Where that is unset, a folder under the warehouse is set and used, if the session is a local one (tests, a laptop);
    a cluster has to name a folder that all machines see.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted when the driver ends."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_discard_all, spark)
    _WRITTEN.add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors cost nothing.

    The tables are deleted by discard(), or when the driver ends.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


_WRITTEN: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, whatever store that is in."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote; nothing that will still be computed may read it."""
    path = getattr(df, "scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def _discard_all(spark: SparkSession) -> None:
    """At the driver's end: what is still there, if the session still is."""
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
            for path in list(_WRITTEN):
                _delete(spark, path)


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: the given one behind as many underscores as it takes."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


def crc_fold(column: Column) -> Column:
    """crc32 of the value as text, modulo the number of folds; fold 0 is held out."""
    return F.crc32(column.cast("string")) % FOLDS


def held_out(column: Column) -> Column:
    """Whether a row is in the held-out fold; a null id counts as held out, so nothing is learnt from it."""
    return F.coalesce(crc_fold(column) == 0, F.lit(True))


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None]) -> None:
    """Say that an owner holds caches in this worker, and how they are released."""
    _HELD[owner] = release


def begin(owner: str = "") -> None:
    """A task of an owner begins in this worker: the caches of all others are released."""
    for other in [k for k in _HELD if k != owner]:
        _HELD.pop(other)()
    pa.default_memory_pool().release_unused()
    # glibc keeps what Python has freed
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def portions(batch: pa.RecordBatch, most: int = PORTION_BYTES):
    """The batch in parts of about so many bytes, so that few texts at a time become Python objects."""
    rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_texts(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, for rows that hold texts: batches have BATCH_ROWS rows at most.

    An executor holds a batch a task outside its heap, and keeps that memory. Spark reads the bound when the plan runs, so it is
    set for the session; one that was set to something else than Spark's own stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) == SPARKS_BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def with_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    keep: Sequence[str] | None = None,
    owner: str = "",
) -> DataFrame:
    """Add columns that a Python function computes from Arrow arrays of the input columns.

    make() runs once in each task and returns the function; caches that others than the owner hold in the worker are released
    before. keep names the columns that stay (all, if None);
    one of the same name as a new column, in whatever case, is replaced.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    # an input is found in any case, and sent once
    have = {c.lower(): c for c in reversed(df.columns)}
    inputs = [have.get(c.lower(), c) for c in inputs]
    both = list(dict.fromkeys([*kept, *inputs]))
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    k, at = len(kept), [both.index(c) for c in inputs]
    out_names = [f.name for f in schema]

    def run(batches):
        begin(owner)
        fn = make()
        for batch in batches:
            for part in portions(batch):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:k], *fn(*(part.column(i) for i in at))], names=out_names
                )

    return map_texts(df.select(*(F.col(f"`{c}`") for c in both)), run, schema)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]

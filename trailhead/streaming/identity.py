"""Event identity on streams: every id's payloads are kept as state, so that repeats and conflicts are exact.

The first payload of an id is its version 1; each further one that differs is a conflict and gets the next number. A
payload that is known already is a repeat and says nothing, whenever it comes. Payloads that come in one micro-batch are
numbered by time, then by checksum; one whose time is before that of a version already out is late: it becomes a version of its own
behind them, and what was said before stays.

State is one entry for each distinct payload of an id, on disk (RocksDB); an id with a third of all rows costs as many
entries as it has payloads, and a task reduces each of its batches to one row for each payload before it sends them. A stream that begins again at its
checkpoint goes on where it was. Micro-batches in order of time give what versions() gives for all rows at once.

Defined results: rows without an id or a checksum are left out; a null time comes before all others and is never late; an
empty stream gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the state store that this needs, to be set before a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
VERSION = "event_id string, payload_checksum string, version long, conflict boolean, late boolean"


def _rows(events: DataFrame, at: str) -> DataFrame:
    """Rows that have an id and a checksum, with their time in microseconds."""
    known = events.where("event_id IS NOT NULL AND payload_checksum IS NOT NULL")
    return known.select(F.col("event_id").cast("string"), F.col("payload_checksum").cast("string"), F.coalesce(F.unix_micros(at), F.lit(-(1 << 62))).alias("at"))


def versions(events: DataFrame, at: str = "ingested_at") -> DataFrame:
    """event_id, payload_checksum, version, conflict and late (never) of a table of events."""
    first = _rows(events, at).groupBy("event_id", "payload_checksum").agg(F.min("at").alias("at"))
    number = F.row_number().over(Window.partitionBy("event_id").orderBy("at", "payload_checksum")).cast("long")
    return first.select("event_id", "payload_checksum", number.alias("version"), (number > 1).alias("conflict"), F.lit(False).alias("late"))


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch with one row for each payload, at its least time."""
    for batch in batches:
        each = pa.Table.from_batches([batch]).group_by(["event_id", "payload_checksum"]).aggregate([("at", "min")])
        yield from each.select(["event_id", "payload_checksum", "at_min"]).rename_columns(["event_id", "payload_checksum", "at"]).to_batches()


class Identity(StatefulProcessor):
    """The payloads of one id, the number of its last version and the greatest time of those out."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "checksum string", "version long", self.keep_ms)
        self.last = handle.getValueState("last", "version long, at long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[str, int] = {}
        for some in rows:
            for checksum, at in some.groupby("payload_checksum")["at"].min().items():
                if checksum in fresh:
                    fresh[checksum] = min(fresh[checksum], int(at))
                elif not self.known.containsKey((checksum,)):
                    fresh[checksum] = int(at)
        if not fresh:
            return
        n, latest = self.last.get() if self.last.exists() else (0, None)
        out = []
        for checksum, at in sorted(fresh.items(), key=lambda x: (x[1], x[0])):
            n += 1
            self.known.updateValue((checksum,), (n,))
            out.append((key[0], checksum, n, n > 1, latest is not None and -(1 << 62) < at < latest))
        most = max(fresh.values())
        self.last.update((n, most if latest is None else max(latest, most)))
        yield pd.DataFrame(out, columns=["event_id", "payload_checksum", "version", "conflict", "late"])

    def close(self) -> None:
        pass


def stream_versions(events: DataFrame, at: str = "ingested_at", keep: int | None = None) -> DataFrame:
    """The same of a stream, as they come. keep: seconds after which an id's payloads are forgotten (never by itself)."""
    mode = "None" if keep is None else "ProcessingTime"
    processor = Identity(None if keep is None else keep * 1000)
    rows = _rows(events, at).mapInArrow(_reduced, "event_id string, payload_checksum string, at long")
    return rows.groupBy("event_id").transformWithStateInPandas(processor, VERSION, "Append", mode)


def run_available(spark: SparkSession, found: DataFrame, out: str, checkpoint: str) -> None:
    """Write what a stream has now as Parquet under out, and end; the next run with this checkpoint goes on there."""
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)

"""Change events: pending paths, adaptive debounce, and the choice between a scoped and a full sync, as batch operators and constants."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

# How long it must be quiet, and beyond how many paths a full sync is cheaper.
QUICK_MS, FULL_MS, QUICK_PATHS, SCOPED_PATHS = 300, 2000, 2, 500


def window_ms(pending: int, quick_ms: int = QUICK_MS, full_ms: int = FULL_MS) -> int:
    return quick_ms if pending <= QUICK_PATHS else full_ms


def is_scoped(pending: int, full_scan: bool) -> bool:
    return not full_scan and 0 < pending <= SCOPED_PATHS


class Pending:
    """What has happened and is not yet synced. Each event arms the timer anew, for as long as the number of pending paths says."""

    def __init__(self, quick_ms: int = QUICK_MS, full_ms: int = FULL_MS):
        self.windows, self.paths, self.full, self.due = (quick_ms, full_ms), {}, False, None

    def add(self, at: float, path: str, folder: bool = False) -> None:
        if folder:
            self.full = True
        else:
            self.paths[path] = at
        self.due = at + window_ms(len(self.paths), *self.windows)

    def take(self, now: float) -> tuple[float, list[str], bool] | None:
        """(when it was due, paths, full scan) if it is due; then nothing is pending."""
        if self.due is None or now < self.due:
            return None
        out = self.due, sorted(self.paths), self.full
        self.paths, self.full, self.due = {}, False, None
        return out


def debounce(events: list[tuple[float, str, bool]], quick_ms: int = QUICK_MS, full_ms: int = FULL_MS) -> list[tuple[float, list[str], bool]]:
    """(flush time in ms, paths, full scan) for events (time in ms, path, is directory) in order of time."""
    out, pending = [], Pending(quick_ms, full_ms)
    for event in events:
        if flush := pending.take(event[0]):
            out.append(flush)
        pending.add(*event)
    if flush := pending.take(float("inf")):
        out.append(flush)
    return out


def flushes(events: DataFrame, key: str, at_ms: str, path: str, folder: str | None = None, quick_ms: int = QUICK_MS, full_ms: int = FULL_MS) -> DataFrame:
    """(key, due_ms, paths, full) of every flush: debounce over each key's events by time, then path. Rows stream through in order of key and time: only what is pending is held."""
    kind = events.schema[key].dataType
    rows = events.select(F.col(key).alias("key"), F.col(at_ms).cast("long").alias("at"), F.col(path).cast("string").alias("path"), (F.col(folder) if folder else F.lit(False)).alias("folder"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, pending = None, Pending(quick_ms, full_ms)
        for f in frames:
            out = []
            for k, at, p, d in zip(f["key"], f["at"], f["path"], f["folder"], strict=True):
                if (flush := pending.take(at if k == held else float("inf"))) is not None:
                    out.append((held, *flush))
                held = k
                pending.add(at, p, d)
            if out:
                yield pd.DataFrame(out, columns=["key", "due_ms", "paths", "full"])
        if (flush := pending.take(float("inf"))) is not None:
            yield pd.DataFrame([(held, *flush)], columns=["key", "due_ms", "paths", "full"])

    schema = StructType([StructField("key", kind), StructField("due_ms", LongType()), StructField("paths", ArrayType(StringType())), StructField("full", BooleanType())])
    return rows.repartition("key").sortWithinPartitions("key", "at", "path").mapInPandas(run, schema).withColumnRenamed("key", key)


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path: (path, ts)."""
    return events.groupBy("path").agg(F.max("ts").alias("ts"))


def sessions(events: DataFrame, key: str, ts: str, gap_ms: int) -> DataFrame:
    """(key, session, started, ended, events, paths): runs of events of a key with less than a fixed gap between them. events: also a column `path`."""
    order = Window.partitionBy(key).orderBy(ts)
    ms = F.unix_micros(F.col(ts).cast("timestamp")) / 1000
    new = F.when(ms - F.lag(ms).over(order) < gap_ms, 0).otherwise(1)
    marked = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"), F.count_distinct("path").alias("paths"))

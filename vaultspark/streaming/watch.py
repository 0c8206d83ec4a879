"""A file watcher as a streaming source, and the query that follows it.

The source compares listings: the built-in file source reports new paths only, neither edits nor removals. It holds changes back until the vault has been quiet for as
long as the number of changed paths asks; whatever comes meanwhile arms the timer anew. An offset is the number of a listing, which is kept as a file; what a batch reports is
the difference between two listings, so a batch that is run again reports the same. The query's batches never overlap, so there is one
sync at a time, and what comes while it runs waits for the next batch.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources import scan
from . import changes

SCHEMA = "path string, kind string, ts long"


def difference(before: dict, after: dict, now_ms: int) -> list[tuple[str, str, int]]:
    """(path, kind, time) between two listings, by path. A listing has each file's size and time, and null for a folder. Kinds: add, change, unlink, addDir, unlinkDir."""
    kinds = {p: ("unlink" if before[p] else "unlinkDir") for p in before.keys() - after.keys()} | {p: ("add" if after[p] else "addDir") for p in after.keys() - before.keys()}
    kinds |= {p: "change" for p in before.keys() & after.keys() if before[p] != after[p]}
    return [(p, kinds[p], now_ms) for p in sorted(kinds)]


class VaultChanges(DataSource):
    """Options: path (the vault), listings (a folder of the driver's for listings), settle_ms (how long a file must be left alone before its change counts; 500),
    quick_ms and full_ms (how long it must be quiet after few and after more paths)."""

    @classmethod
    def name(cls) -> str:
        return "vault_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        number = lambda k, d: int(self.options.get(k, str(d)))
        return _Reader(self.options["path"], self.options["listings"], number("settle_ms", 500), number("quick_ms", changes.QUICK_MS), number("full_ms", changes.FULL_MS))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, listings: str, settle_ms: int, quick_ms: int, full_ms: int):
        self.root, self.listings, self.settle_ms, self.windows = Path(root), Path(listings), settle_ms, (quick_ms, full_ms)
        self.pending, self.seen = changes.Pending(*self.windows), {}

    def _now(self) -> dict:
        return dict.fromkeys(scan.folders(self.root)) | {p: [size, mtime] for p, size, mtime in scan.listing(self.root)}

    def _file(self, n: int) -> Path:
        return self.listings / f"{n:012d}.json"

    def _load(self, offset: dict) -> dict:
        return json.loads(self._file(offset["n"]).read_text())

    def _store(self, n: int, at: int, files: dict) -> dict:
        self.listings.mkdir(parents=True, exist_ok=True)
        fresh = self._file(n).with_suffix(".tmp")
        fresh.write_text(json.dumps({"at": at, "files": files}))
        os.replace(fresh, self._file(n))
        return {"n": n}

    def initialOffset(self) -> dict:  # noqa: N802
        return self._store(0, 0, self._now())

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = int(time.time() * 1000)
        before, after = self._load(start)["files"], self._now()
        for p, held in list(after.items()):
            if held and held != before.get(p) and now - held[1] < self.settle_ms:  # still being written: as it was
                if p in before:
                    after[p] = before[p]
                else:
                    del after[p]
        events = difference(before, after, now)
        for p, kind, _ in events:
            if self.seen.get(p) != (kind, after.get(p)):  # not seen at the last look
                self.pending.add(now, p, kind.endswith("Dir"))
        self.seen = {p: (kind, after.get(p)) for p, kind, _ in events}
        if not events:
            self.pending = changes.Pending(*self.windows)  # all is as it was
        if not events or not self.pending.take(now):
            return iter(()), start
        self.seen = {}
        return iter(events), self._store(start["n"] + 1, now, after)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        last = self._load(end)
        return iter(difference(self._load(start)["files"], last["files"], last["at"]))

    def commit(self, end: dict) -> None:
        for old in self.listings.glob("*.json"):
            if old.stem.isdigit() and int(old.stem) < end["n"]:
                old.unlink(missing_ok=True)


def watch(spark: SparkSession, vault, checkpoint: str, trigger: str = "100 milliseconds", settle_ms: int = 500, quick_ms: int = changes.QUICK_MS, full_ms: int = changes.FULL_MS):
    """A full sync, then a query that keeps the index up with the files. Few changed paths are synced by themselves; many, or a folder that came or went, by a full sync."""
    spark.dataSource.register(VaultChanges)
    vault.sync()

    def flush(batch: DataFrame, _: int) -> None:
        folders = batch.where(F.col("kind").endswith("Dir")).limit(1).count() > 0
        paths = [r["path"] for r in changes.latest(batch.where(~F.col("kind").endswith("Dir"))).limit(changes.SCOPED_PATHS + 1).collect()]
        if paths or folders:
            vault.sync_paths(paths) if changes.is_scoped(len(paths), folders) else vault.sync()

    events = spark.readStream.format("vault_changes").options(path=str(vault.root), listings=f"{checkpoint}/listings", settle_ms=str(settle_ms), quick_ms=str(quick_ms), full_ms=str(full_ms)).load()
    return events.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()

"""The index: a versioned Parquet snapshot of two tables under one pointer file, swapped in one step.

A reader sees the version that the pointer names; a writer that finds the pointer moved tries again, a bounded number of times. A pointer of another
schema version, or a table without its columns, means a rebuild from the files: the index can always be thrown away.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import ignore

SCHEMA_VERSION = 1
NOTES = (
    "id string, path string, title string, type string, status string, created string, updated string, tags array<string>, aliases array<string>, links array<string>, "
    "headings array<struct<level:int,text:string,slug:string,line:int,position:int,path:array<string>>>, frontmatter string, body string, body_hash string"
)
FILES = "path string, hash string, size long, mtime_ms long, deleted boolean, indexed_at timestamp"


class Conflict(RuntimeError):
    """Another writer has moved the pointer."""


class Store:
    def __init__(self, spark: SparkSession, root: Path):
        self.spark, self.dir = spark, Path(root) / ignore.STORE_DIR
        self.pointer = self.dir / "current.json"
        if self.version() is None:
            shutil.rmtree(self.dir, ignore_errors=True)
            self.dir.mkdir(parents=True)

    def version(self) -> str | None:
        try:
            held = json.loads(self.pointer.read_text())
        except (OSError, ValueError):
            return None
        ok = held.get("schema_version") == SCHEMA_VERSION and all((self.dir / held["version"] / t).is_dir() for t in ("notes", "files"))
        return held["version"] if ok else None

    def _table(self, name: str, schema: str) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(schema).parquet(str(self.dir / v / name)) if v else self.spark.createDataFrame([], schema)

    def notes(self) -> DataFrame:
        return self._table("notes", NOTES)

    def files(self) -> DataFrame:
        return self._table("files", FILES)

    def write(self, base: str | None, notes: DataFrame, files: DataFrame) -> str:
        """A new version on top of `base`."""
        version = f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        notes.write.parquet(str(self.dir / version / "notes"))
        files.write.parquet(str(self.dir / version / "files"))
        lock = self.dir / "lock"
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        except FileExistsError as e:
            raise Conflict("another writer holds the lock") from e
        try:
            if self.version() != base:
                shutil.rmtree(self.dir / version)
                raise Conflict("the index has changed meanwhile")
            fresh = self.dir / f"{version}.json"
            fresh.write_text(json.dumps({"schema_version": SCHEMA_VERSION, "version": version}))
            os.replace(fresh, self.pointer)
        finally:
            lock.unlink()
        for old in self.dir.glob("v-*"):
            if old.is_dir() and old.name not in (version, base):
                shutil.rmtree(old, ignore_errors=True)
        return version

    def retry(self, change: Callable[[], object], attempts: int = 5, wait: float = 0.2) -> object:
        for k in range(attempts):
            try:
                return change()
            except Conflict:
                if k + 1 == attempts:
                    raise
                time.sleep(wait * (k + 1))
        raise AssertionError

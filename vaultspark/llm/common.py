"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of this machine's, if driver and executors are one process; else an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set: with master {master}, executors need a folder that they share")
    own = tempfile.mkdtemp(prefix="vaultspark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/vaultspark-{uuid.uuid4().hex[:12]}/{name}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no later job reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends here, and a lost executor costs one read."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Written tables of an operator, which are deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path = self.paths[name] = scratch(self.spark, name)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """The tables of these names; without any, all."""
        for name in names or list(self.paths):
            drop_scratch(self.spark, self.paths.pop(name).rpartition("/")[0])


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """df marked for broadcast if it has at most max_rows rows (counted, stopping beyond the bound); else df as it is, for a shuffled join."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df), True
    return df, False


#: Rows of an Arrow batch where the session has Spark's own default: a batch of whole texts is built up in the memory of the JVM and of Python.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Settings of the session that bound an executor's memory, where they are as Spark sets them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def _libc_call(name: str, *args: int) -> None:
    """A function of the C library, where it has it."""
    call = getattr(ctypes.CDLL(None), name, None)
    if call:
        call(*args)


#: Numbers of mallopt's parameters: how much free memory stays at the top of the heap, and from which size on an allocation is one of its own.
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with freed memory going back to the system: large pieces at once, all else at its end, so that a worker that waits for its next task holds little."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        _libc_call("mallopt", _MMAP_THRESHOLD, 1 << 20)
        _libc_call("mallopt", _TRIM_THRESHOLD, 1 << 22)
        yield from run(batches)
        _libc_call("malloc_trim", 0)

    return wrapped


def struct_of(schema: str) -> StructType:
    return _parse_datatype_string(schema)


#: Bytes of an Arrow batch that are turned into Python objects at a time.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some PIECE_BYTES, a row at least: long texts don't meet in memory by the thousand."""
    rows = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_columns(df: DataFrame, schema: str, start: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Applies a function of Arrow batches, given as lists of column values. start() runs once in each task and gives that function."""
    out = to_arrow_schema(struct_of(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = start()
        for batch in batches:
            for piece in pieces(batch):
                made = apply(piece.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(tidy(run), schema)


def change_rows(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Applies a function of Arrow batches that keeps all columns as they are named and typed."""
    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = start()
        for batch in batches:
            for piece in pieces(batch):
                made = apply(piece)
                if made.num_rows:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made.columns, schema, strict=True)], schema=schema)

    return df.mapInArrow(tidy(run), df.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

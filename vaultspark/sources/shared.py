"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of this machine's, if driver and executors are one process; else an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir is not set: with master {sc.master}, executors need a folder that they share")
        own = tempfile.mkdtemp(prefix="vaultspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as written to the shared folder: lineage ends there."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few files, dealt to all cores: a Parquet file of one row group is one task, however it is split. A table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df

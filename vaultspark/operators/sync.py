"""Sync as set operations: what changed between a scan and the index, who may keep an id, and the new state of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(scan: DataFrame, files: DataFrame) -> DataFrame:
    """(path, action): removed, added, unchanged (size and time agree), or changed, by a full outer join. scan: (path, size, mtime_ms); files: also deleted.
    A changed file still has to be hashed."""
    live = files.where("not deleted").select("path", F.col("size").alias("old_size"), F.col("mtime_ms").alias("old_mtime"))
    both = scan.select("path", "size", "mtime_ms").join(live, "path", "full_outer")
    action = F.when(F.col("size").isNull(), "removed").when(F.col("old_size").isNull(), "added").when((F.col("size") == F.col("old_size")) & (F.col("mtime_ms") == F.col("old_mtime")), "unchanged").otherwise("changed")
    return both.select("path", action.alias("action"))


def guard_ids(parsed: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, errors): of the notes that claim one id, the one in the index keeps it, else that of the smallest path. live: (id, path) of the index,
    without the paths that are parsed anew or gone; tombstones don't count."""
    claims = parsed.select("id", "path", F.lit(1).alias("late")).union(live.join(parsed.select("path"), "path", "left_anti").select("id", "path", F.lit(0)))
    keeper = claims.groupBy("id").agg(F.min(F.struct("late", "path")).alias("k")).select("id", F.col("k.path").alias("keeper"))
    judged = parsed.join(keeper, "id")
    message = F.format_string('Duplicate note id "%s" in %s; already used by %s', "id", "path", "keeper")
    return judged.where(F.col("path") == F.col("keeper")).drop("keeper"), judged.where(F.col("path") != F.col("keeper")).select("path", message.alias("error"))


def tombstone(notes: DataFrame) -> DataFrame:
    """The rows as deleted: text stays, tags, aliases and links go."""
    none = F.array().cast("array<string>")
    return notes.withColumns({"status": F.lit("deleted"), "tags": none, "aliases": none, "links": none})


def apply(notes: DataFrame, accepted: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after a sync: rows of `removed` paths are tombstones, rows of accepted paths or ids are replaced."""
    gone = notes.join(removed.select("path"), "path", "left_semi")
    kept = notes.join(removed.select("path"), "path", "left_anti")
    old = tombstone(gone).unionByName(kept).join(accepted.select("path"), "path", "left_anti").join(accepted.select("id"), "id", "left_anti")
    return old.unionByName(accepted.select(notes.columns))


def first_of_id(parsed: DataFrame) -> DataFrame:
    """The rows that duplicate an id, with the path that keeps it."""
    w = Window.partitionBy("id").orderBy("path")
    return parsed.withColumn("keeper", F.first("path").over(w)).where(F.col("path") != F.col("keeper")).select("id", "path", "keeper")

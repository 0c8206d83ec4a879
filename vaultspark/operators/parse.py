"""Raw Markdown files to note rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter, markdown
from ..functions.text import fallback_id, sha256, stem


def parse_notes(files: DataFrame) -> DataFrame:
    """(path, raw, further columns) to notes; `error` holds what is wrong with a file's frontmatter, else null. A map: no shuffle, and Python sees
    only the frontmatter."""
    more = [c for c in files.columns if c not in ("path", "raw")]
    split = files.withColumn("_fm", frontmatter.fields(frontmatter.block(F.col("raw")))).withColumn("body", frontmatter.body(F.col("raw")))
    inline = markdown.inline_tags(F.col("body"))
    return split.select(
        F.coalesce("_fm.id", fallback_id(F.col("path"))).alias("id"),
        "path",
        F.coalesce("_fm.title", stem(F.col("path"))).alias("title"),
        F.coalesce("_fm.type", F.lit("note")).alias("type"),
        F.coalesce("_fm.status", F.lit("active")).alias("status"),
        F.col("_fm.created").alias("created"),
        F.col("_fm.updated").alias("updated"),
        F.array_union(F.coalesce("_fm.tags", F.array().cast("array<string>")), inline).alias("tags"),
        F.array_distinct(F.coalesce("_fm.aliases", F.array().cast("array<string>"))).alias("aliases"),
        markdown.links(F.col("body")).alias("links"),
        markdown.headings(F.col("body")).alias("headings"),
        F.col("_fm.frontmatter").alias("frontmatter"),
        "body",
        sha256(F.col("raw")).alias("hash"),
        sha256(F.col("body")).alias("body_hash"),
        F.col("_fm.error").alias("error"),
        *more,
    )

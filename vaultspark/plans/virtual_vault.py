"""A vault made from the `documents` table, by SQL that Spark and DuckDB both run.

Notes link to each other by id, relative path, stem and alias, so that every rule of link resolution has work to do; a seventeenth of
them is deleted. Used where files are not at hand: the registered queries run over it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions.text import sha256
from ..sources.index import Index
from ..sources.shared import shared_dir, spread

NOTES_SQL = """
SELECT 'doc_' || doc_id AS id,
  source || '/' || lang || '/note_' || doc_id || '.md' AS path,
  substr(split_part(text, chr(10), 1), 1, 40) AS title,
  lang AS type,
  CASE WHEN doc_id % 17 = 0 THEN 'deleted' WHEN doc_id % 5 = 0 THEN 'archived' ELSE 'active' END AS status,
  'alias ' || (doc_id % 150) AS alias,
  '# ' || substr(split_part(text, chr(10), 1), 1, 40) || chr(10) || text || chr(10) || '## Links' || chr(10)
    || '[[doc_' || ((doc_id * 7 + 1) % 200) || ']] [n](./note_' || (doc_id + 20) || '.md) [[note_' || ((doc_id + 3) % 200)
    || '|x]] [[alias ' || (doc_id % 160) || '#h]] [[missing_' || (doc_id % 3) || ']] #' || source || ' #tag' || (doc_id % 9) AS body
FROM documents
"""


def base_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, title, type, status, alias, body)"""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spark.sql(NOTES_SQL.replace("FROM documents", "FROM {documents}"), documents=docs)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note rows as the index keeps them: a deleted note keeps its text but has no tags, aliases or links."""
    live = F.col("status") != "deleted"
    none = F.array().cast("array<string>")
    return base_notes(spark, sf_dir).select(
        "id",
        "path",
        "title",
        "type",
        "status",
        F.when(live, markdown.inline_tags(F.col("body"))).otherwise(none).alias("tags"),
        F.when(live, F.array("alias")).otherwise(none).alias("aliases"),
        F.when(live, markdown.links(F.col("body"))).otherwise(none).alias("links"),
        "body",
        sha256(F.col("body")).alias("body_hash"),
    )


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the vault, in the shared folder under a name made of the application, the table's files, their sizes and times."""
    said = [spark.sparkContext.applicationId]
    for name in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        said += [name, str(status.getLen()), str(status.getModificationTime())]
    return Index(spark, f"{shared_dir(spark).rstrip('/')}/vault-{hashlib.sha256('|'.join(said).encode()).hexdigest()[:16]}", lambda: notes(spark, sf_dir))

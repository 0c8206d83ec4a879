"""The index beside a snapshot of notes: texts as they are compared, postings of trigrams, the corpus figures, and the edges. Each table is written once, by the first
who reads it, and read by every query after that.

Notes lie in blocks, a folder each: a query reads the postings of its trigrams only, which are sorted by trigram, and then the blocks that hold
a note with all trigrams of some phrase. What is found there is compared in full, as trigrams that occur need not stand side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve

TEXTS = ("title", "path", "body", "tags", "aliases")
#: Notes of a block, unless that made more than MOST_BLOCKS.
PER_BLOCK, MOST_BLOCKS = 1_000, 10_000
_BLOCK_BITS = 33


def texts(notes: DataFrame) -> DataFrame:
    """notes with the five texts that are searched, lower-cased, as _title, _path, ..., tags and aliases joined by blanks; and dl, how many trigrams they have."""
    lists = {"tags": F.array_join("tags", " "), "aliases": F.array_join("aliases", " ")}
    low = notes.withColumns({f"_{c}": F.lower(F.coalesce(lists.get(c, F.col(c)), F.lit(""))) for c in TEXTS})
    return low.withColumn("dl", sum((F.greatest(F.lit(0), F.length(F.col(f"_{c}")) - 2) for c in TEXTS), F.lit(0)))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))"), F.lit(1)))


class Index:
    def __init__(self, spark: SparkSession, path: str, source: Callable[[], DataFrame]):
        self.spark, self.path, self.source = spark, path.rstrip("/"), source

    def _there(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _table(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        if not self._there(name):
            df = build()
            # without rows there are no folders, so the schema lies in a file of its own
            writer = df.write if by is None or df.isEmpty() else df.write.partitionBy(by)
            writer.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def notes(self) -> DataFrame:
        """The rows of the source with their texts, dl, no (a number, fixed by this table) and block."""

        def build() -> DataFrame:
            rows = self.source()
            n = rows.count()
            blocks = max(1, -(-n // max(PER_BLOCK, -(-n // MOST_BLOCKS))))
            return texts(rows.repartition(blocks)).withColumn("no", F.monotonically_increasing_id()).withColumn("block", F.shiftright("no", _BLOCK_BITS).cast("int"))

        return self._table("notes", build, "block")

    def postings(self) -> DataFrame:
        """(gram, no): each trigram of a note's texts once, sorted by gram."""

        def build() -> DataFrame:
            of = F.array_union(trigrams(F.concat_ws("\n", "_title", "_path", "_tags", "_aliases")), trigrams(F.col("_body")))
            each = self.notes().select("no", F.explode(of).alias("gram"))
            return each.repartitionByRange("gram").sortWithinPartitions("gram", "no")

        return self._table("postings", build)

    def figures(self) -> tuple[int, float]:
        """How many live notes there are, and how many trigrams they have on average."""
        row = self._table("figures", lambda: self.notes().where("status <> 'deleted'").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))).first()
        return row["n"], row["avgdl"] or 1.0

    def edges(self) -> DataFrame:
        return self._table("edges", lambda: resolve.edges(self.notes()))

    def cards(self) -> DataFrame:
        """The rows of the source without texts: what links need."""
        return self._table("cards", lambda: self.source().select("id", "path", "title", "status", "aliases", "links"))

    def answers(self) -> DataFrame:
        """(target, rule, id): the notes that answer each target."""
        return self._table("answers", lambda: resolve.answers(resolve.targets(self.cards()), self.cards()))

    def links(self) -> DataFrame:
        """edges without their candidates: a row of bounded size for each link."""
        return self._table("links", lambda: resolve.links(self.cards(), self.answers()))

    def holding(self, phrases: Iterable[str]) -> DataFrame:
        """The notes of all blocks in which some note has every trigram of one of the phrases (three characters or more)."""
        sets = [sorted({p[k : k + 3] for k in range(len(p) - 2)}) for p in dict.fromkeys(phrases)]
        wanted = sorted({g for s in sets for g in s})
        if not wanted:
            return self.notes().where(F.lit(False))
        has = self.postings().where(F.col("gram").isin(wanted)).groupBy("no").agg(F.collect_set("gram").alias("grams"))  # as many as the query has
        some = [F.size(F.array_intersect("grams", F.array(*map(F.lit, s)))) == len(s) for s in sets]
        hit = some[0]
        for s in some[1:]:
            hit = hit | s
        blocks = [r[0] for r in has.where(hit).select(F.shiftright("no", _BLOCK_BITS).cast("int")).distinct().collect()]  # MOST_BLOCKS numbers at most
        return self.notes().where(F.col("block").isin(blocks) if blocks else F.lit(False))

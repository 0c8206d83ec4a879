"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int | None = None) -> DataFrame:
    """(node, label) for every node of a link; label is the least node that links reach. Each round is a written table in the shared folder.

    Minima are summed up in each task before a shuffle, and joins on a hub are left to adaptive execution to split. Links to itself and
    null ends are left out; repeated links do no harm; no links give no rows. Rounds go on until nothing changes; if most_rounds is given and that takes
    more, it is an error.
    """
    spark = links.sparkSession
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    kept, before = [], None
    for n in itertools.count():
        if n == most_rounds:
            raise RuntimeError(f"links are not settled after {n} rounds")
        # large star: every greater neighbour of u hangs on the least one
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lesser neighbours hang on the least one
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        path = scratch(spark, "components")
        small.write.parquet(path)
        edges = spark.read.schema(small.schema).parquet(path)
        kept.append(path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        for old in kept[:-2]:
            drop_scratch(spark, old)
        kept = kept[-2:]
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(edges.select(F.col("v"), F.col("v")).distinct())

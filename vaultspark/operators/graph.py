"""Graph queries over the edge table: backlinks, one-hop context, summaries, breadth-first search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .resolve import small


def backlinks(edges: DataFrame) -> DataFrame:
    """(dst, src, src_path, raw): each source of a note once, with the first of its targets that resolves to it; a note is no source of its own."""
    one = edges.where((F.col("state") == "resolved") & (F.col("src") != F.col("dst")))
    return one.groupBy("dst", "src").agg(F.min("src_path").alias("src_path"), F.min("raw").alias("raw"))


def ambiguous_mentions(edges: DataFrame) -> DataFrame:
    """(dst, src, src_path, raw, candidates): ambiguous links of other notes that may mean dst. A source's mentions count up to its first target
    that resolves to dst."""
    each = edges.where(F.col("state") == "ambiguous").select(F.explode("candidates").alias("dst"), "src", "src_path", "raw", "candidates").where("src <> dst")
    first = backlinks(edges).select("dst", "src", F.col("raw").alias("sure"))
    return each.join(first, ["dst", "src"], "left").where(F.col("sure").isNull() | (F.col("raw") < F.col("sure"))).drop("sure")


def _first(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n)


def first_mentions(edges: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Of ambiguous_mentions as (id, other, raw, src_path) those that may be among the first `limit` of their note by source path. hits: (target, id) of the ambiguous targets.

    A target's sources are listed once, and not for each note that it may mean: of that list a note needs the first `limit`, and as many more as don't count for it."""
    said = edges.where("state = 'ambiguous'").select("target", "src", "src_path", "raw")
    sure = backlinks(edges).select(F.col("dst").alias("id"), "src", F.col("raw").alias("sure"))
    own = said.select("target", F.col("src").alias("id"))
    known = sure.join(said, "src").where("raw >= sure").select("target", "id")
    less = written(own.union(known).join(hits, ["target", "id"], "left_semi").groupBy("target", "id").agg(F.count("*").alias("less")))
    most = less.agg(F.max("less")).first()[0] or 0
    listed = said.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("src_path", "raw"))).where(F.col("n") <= limit + most)
    near = hits.join(less, ["target", "id"], "left").join(small(listed), "target").where(F.col("n") <= limit + F.coalesce("less", F.lit(0)))
    # only where something doesn't count is that sought
    some = near.where("less is not null and id <> src").join(sure, ["id", "src"], "left").where("sure is null or raw < sure")
    return near.where("less is null").select("id", F.col("src").alias("other"), "raw", "src_path").union(some.select("id", F.col("src").alias("other"), "raw", "src_path"))


def context(notes: DataFrame, edges: DataFrame, limit: int = 20, hits: DataFrame | None = None) -> DataFrame:
    """(id, kind, ord, other, raw): the first `limit` of each note's out-links and broken links by target, and backlinks and ambiguous mentions by source path. hits: (target, id)
    of the ambiguous targets; else they are taken from the candidates of edges."""
    if hits is None:
        hits = edges.where("state = 'ambiguous'").groupBy("target").agg(F.first("candidates").alias("ids")).select("target", F.explode("ids").alias("id")).join(notes.select("id"), "id", "left_semi")
    own = edges.withColumnRenamed("src", "id")
    parts = [
        ("out", own.where("state = 'resolved'").select("id", F.col("dst").alias("other"), "raw", F.col("raw").alias("o1"), F.lit("").alias("o2"))),
        ("broken", own.where("state = 'broken'").select("id", F.lit(None).cast("string").alias("other"), "raw", F.col("raw").alias("o1"), F.lit("").alias("o2"))),
        ("back", backlinks(edges).select(F.col("dst").alias("id"), F.col("src").alias("other"), "raw", F.col("src_path").alias("o1"), F.col("raw").alias("o2"))),
        (
            "ambiguous",
            # a note's own ambiguous links come before what others may mean by it
            own.where("state = 'ambiguous'").select("id", F.col("id").alias("other"), "raw", F.lit("").alias("o1"), F.col("raw").alias("o2")).union(first_mentions(edges, hits, limit).select("id", "other", "raw", F.concat(F.lit("/"), F.col("src_path")).alias("o1"), F.col("raw").alias("o2"))),
        ),
    ]
    out = None
    for kind, df in parts:
        cut = _first(df, "id", ["o1", "o2"], limit).select("id", F.lit(kind).alias("kind"), F.col("_n").alias("ord"), "other", "raw")
        out = cut if out is None else out.union(cut)
    return out.join(notes.select("id"), "id", "left_semi")


def totals(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, total_out, total_broken, total_ambiguous, total_back) for every note."""
    n = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0))
    own = edges.groupBy(F.col("src").alias("id")).agg(n("resolved").alias("total_out"), n("broken").alias("total_broken"), n("ambiguous").alias("own_ambiguous"))
    back = backlinks(edges).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("total_back"))
    said = ambiguous_mentions(edges).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("others"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return notes.select("id").join(own, "id", "left").join(back, "id", "left").join(said, "id", "left").select("id", z("total_out").alias("total_out"), z("total_broken").alias("total_broken"), (z("own_ambiguous") + z("others")).alias("total_ambiguous"), z("total_back").alias("total_back"))


def summaries(notes: DataFrame, edges: DataFrame, preview: int = 3) -> DataFrame:
    """(id, outlinks, broken, backlinks, out_preview, back_preview) for live notes: outlinks counts every link as written; previews are the first few notes."""
    live = notes.where("status <> 'deleted'").select("id", "title")
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outlinks"), F.count_if(F.col("state") == "broken").alias("broken"))
    back = backlinks(edges)
    named = lambda df, other: df.join(live.select(F.col("id").alias(other), "title"), other)
    outs = named(_first(edges.where("state = 'resolved'").select(F.col("src").alias("id"), F.col("dst").alias("other"), F.col("raw").alias("o")), "id", ["o"], preview), "other")
    ins = named(_first(back.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.col("src_path").alias("o")), "id", ["o"], preview), "other")
    listed = lambda df, name: df.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("other").alias("id"), "title"))), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"))).alias(name))
    n_back = back.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("backlinks"))
    none = F.array().cast("array<struct<id:string,title:string>>")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return live.select("id").join(counts, "id", "left").join(n_back, "id", "left").join(listed(outs, "out_preview"), "id", "left").join(listed(ins, "back_preview"), "id", "left").select("id", z("outlinks"), z("broken"), z("backlinks"), F.coalesce("out_preview", none).alias("out_preview"), F.coalesce("back_preview", none).alias("back_preview"))


def bfs(notes: DataFrame, edges: DataFrame, root: str, depth: int = 1, direction: str = "both", max_nodes: int = 100, back_limit: int = 25) -> tuple[DataFrame, DataFrame] | None:
    """(nodes (id, depth, ord), links (src, dst, raw)) around a live note, or None if it isn't one.

    One join of the frontier with the edges for each level. Candidates are ordered by the parent's place in the queue, out-links by target before
    backlinks by source path; once max_nodes are known no further link is taken. The frontier never exceeds max_nodes rows, a bound that the
    caller sets, so it is kept on the driver.
    """
    spark = notes.sparkSession
    if not notes.where((F.col("id") == root) & (F.col("status") != "deleted")).limit(1).count():
        return None
    order, level = {root: 0}, {root: 0}
    taken: dict[tuple[str, str], str] = {}
    frontier, at = [root], 0

    def steps(ids: DataFrame) -> DataFrame:
        """The links that may be taken from the frontier: only its own edges are sorted."""
        ways, here = [], F.broadcast(ids.select("near"))
        if direction in ("out", "both"):
            own = edges.where("state = 'resolved'").join(here, F.col("src") == F.col("near"), "left_semi")
            ways.append(own.select(F.col("src").alias("near"), F.col("dst").alias("far"), "raw", F.lit(0).alias("way"), F.col("raw").alias("o")))
        if direction in ("back", "both"):
            back = _first(backlinks(edges.join(here, F.col("dst") == F.col("near"), "left_semi")), "dst", ["src_path", "raw"], back_limit)
            ways.append(back.select(F.col("dst").alias("near"), F.col("src").alias("far"), "raw", F.lit(1).alias("way"), F.col("src_path").alias("o")))
        return ways[0] if len(ways) == 1 else ways[0].union(ways[1])

    while frontier and at < depth and len(order) < max_nodes:
        near = spark.createDataFrame([(n, order[n]) for n in frontier], "near string, place int")
        found = steps(near).join(F.broadcast(near), "near")
        # first sight of each unknown node, then all links up to the last one that may be taken
        known = list(order)
        fresh = found.where(~F.col("far").isin(known)).groupBy("far").agg(F.min(F.struct("place", "way", "o", "far")).alias("key"))
        last = fresh.orderBy("key").limit(max_nodes - len(order)).select(F.col("key")).collect()
        full = len(last) == max_nodes - len(order)
        mine = found.withColumn("key", F.struct("place", "way", "o", "far"))
        if full:
            end = last[-1]["key"]
            mine = mine.where(F.col("key") <= F.struct(F.lit(end["place"]), F.lit(end["way"]), F.lit(end["o"]), F.lit(end["far"])))
        links = mine.select("near", "far", "raw", "way", "o").collect() if full or len(known) < max_nodes else []
        for r in sorted(links, key=lambda r: (order[r["near"]], r["way"], r["o"], r["far"])):
            pair = (r["near"], r["far"]) if r["way"] == 0 else (r["far"], r["near"])
            taken.setdefault(pair, r["raw"])
        frontier = []
        for r in last:
            far = r["key"]["far"]
            order[far], level[far] = len(order), at + 1
            frontier.append(far)
        at += 1
    nodes = spark.createDataFrame([(n, level[n], k) for n, k in order.items()], "id string, depth int, ord int")
    kept = [(a, b, raw) for (a, b), raw in taken.items()]
    return nodes, spark.createDataFrame(kept, "src string, dst string, raw string")


def reach(notes: DataFrame, edges: DataFrame, root: str, depth: int = 1, direction: str = "both") -> DataFrame:
    """(id, depth) of every note within `depth` steps of the root, which is one of them: bfs without its caps. Steps, frontier and what is known are written tables."""
    ways = []
    if direction in ("out", "both"):
        ways.append(edges.where("state = 'resolved'").select(F.col("src").alias("near"), F.col("dst").alias("far")))
    if direction in ("back", "both"):
        ways.append(backlinks(edges).select(F.col("dst").alias("near"), F.col("src").alias("far")))
    steps = written((ways[0] if len(ways) == 1 else ways[0].union(ways[1])).distinct())
    known = frontier = notes.sparkSession.createDataFrame([(root, 0)], "id string, depth int")
    for at in range(1, depth + 1):
        far = steps.join(frontier.select(F.col("id").alias("near")), "near", "left_semi").select(F.col("far").alias("id")).distinct()
        frontier = written(far.join(known, "id", "left_anti").select("id", F.lit(at).alias("depth")))
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known

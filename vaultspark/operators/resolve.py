"""Link resolution: every link of every live note, once, as a table of edges.

A target is tried as an id, a path, a path stem, a title and an alias, in this order; the first rule under which any live note answers decides:
one answer resolves it, several leave it ambiguous, none breaks it. All five are hash joins on one key column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, dirname, posix_normalize

RULES = ("id", "path", "stem", "title", "alias")


def normalize_target(target: Column, source_path: Column) -> Column:
    """A relative target, or one that ends in .md, is taken from the source's folder; any other stays as it is."""
    relative = F.startswith(target, F.lit("./")) | F.startswith(target, F.lit("../")) | F.endswith(target, F.lit(".md"))
    folder = dirname(source_path)
    full = F.when(folder == "", target).otherwise(F.concat_ws("/", folder, target))
    return F.when(relative, posix_normalize(full)).otherwise(target)


def _stems(live: DataFrame) -> DataFrame:
    """(id, whole, stem): for each .md note its path without the extension, compared as it is, and every proper suffix of it, compared without ASCII case."""
    cut = live.where(F.endswith("path", F.lit(".md"))).select("id", F.substr("path", F.lit(1), F.length("path") - 3).alias("whole"))
    rows = cut.select("id", "whole", F.split("whole", "/").alias("parts"))
    tails = F.transform(F.sequence(F.lit(2), F.size("parts")), lambda k: F.array_join(F.slice("parts", k, F.size("parts")), "/"))
    return rows.select("id", "whole", F.explode(F.when(F.size("parts") > 1, tails).otherwise(F.array().cast("array<string>"))).alias("stem"))


def _masked(c: Column, mask: Column) -> Column:
    """c with "_" wherever mask has one."""
    return F.array_join(F.transform(F.split(mask, ""), lambda m, i: F.when(m == "_", m).otherwise(F.substr(c, i + 1, F.lit(1)))), "")


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows (counted); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _stem_hits(targets: DataFrame, live: DataFrame, wildcards: bool) -> DataFrame:
    """(target, id) by stem. In a target "_" stands for any one character and "%" for any run, as the comparison is by LIKE.

    A target with "_" joins by its mask: where its underscores are. Stems are masked by each mask of their length, so this too is a hash join.
    A target with "%" joins by an anchor, the longest stretch without wildcards that it has, and is then compared in full."""
    stems = _stems(live).withColumn("low", ascii_lower(F.col("stem")))
    whole = targets.join(live.where(F.endswith("path", F.lit(".md"))).select("id", F.substr("path", F.lit(1), F.length("path") - 3).alias("target")), "target").select("target", "id")
    low = targets.withColumn("low", ascii_lower(F.col("target")))
    if not wildcards:
        return whole.union(low.join(stems, "low").select("target", "id")).distinct()
    plain = low.where(~F.contains("target", F.lit("_")) & ~F.contains("target", F.lit("%"))).join(stems, "low").select("target", "id")
    one = low.where(F.contains("target", F.lit("_")) & ~F.contains("target", F.lit("%"))).withColumn("mask", F.regexp_replace("low", "[^_]", "."))
    masks = one.select("mask", F.length("mask").alias("n")).distinct()
    keyed = stems.withColumn("n", F.length("low")).join(small(masks), "n").select("id", "mask", _masked(F.col("low"), F.col("mask")).alias("low"))
    by_mask = one.join(keyed, ["mask", "low"]).select("target", "id")
    return whole.union(plain).union(by_mask).union(_by_anchor(low.where(F.contains("target", F.lit("%"))), stems)).distinct()


def _by_anchor(patterns: DataFrame, stems: DataFrame) -> DataFrame:
    """(target, id) of patterns with "%". An anchor of three characters or more is sought by its first trigram among those of the stems; a shorter one at the pattern's end or
    beginning by as many characters of the stem's; a pattern that has neither is held against all stems, as nearly all of them answer it."""
    literal = F.filter(F.split("low", "[%_]"), lambda p: p != "")
    longest = F.element_at(F.array_sort(F.transform(literal, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), 1)["p"]
    rx = F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("low", r"([\\^$.|?*+()\[\]{}])", r"\\$1"), "%", ".*"), "_", "."), F.lit("$"))
    tail, head = F.regexp_extract("low", r"[^%_]*\z", 0), F.regexp_extract("low", r"^[^%_]*", 0)
    cut = patterns.select("target", rx.alias("rx"), F.when(F.size(literal) > 0, longest).otherwise("").alias("part"), head.alias("head"), tail.alias("tail"))
    kind = F.when(F.length("part") >= 3, "gram").when(F.col("tail") != "", "tail").when(F.col("head") != "", "head").otherwise("any")
    keyed = cut.withColumn("kind", kind).withColumn("key", F.when(F.col("kind") == "gram", F.substr("part", F.lit(1), F.lit(3))).when(F.col("kind") == "tail", F.col("tail")).when(F.col("kind") == "head", F.col("head")).otherwise(""))
    text = F.col("low")
    ends = F.array(*[F.struct(F.lit("tail").alias("kind"), F.when(F.length(text) >= n, F.substr(text, F.length(text) - n + 1, F.lit(n))).alias("key")) for n in (1, 2)], *[F.struct(F.lit("head").alias("kind"), F.when(F.length(text) >= n, F.substr(text, F.lit(1), F.lit(n))).alias("key")) for n in (1, 2)])
    grams = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))"), F.lit(1))), lambda g: F.struct(F.lit("gram").alias("kind"), g.alias("key")))
    every = F.array(F.struct(F.lit("any").alias("kind"), F.lit("").alias("key")))
    # only as many keys of a stem as some pattern asks for
    asked = small(keyed.select("kind", "key").distinct())
    found = stems.select("id", F.col("low").alias("stem_low"), F.explode(F.concat(grams, ends, every)).alias("k")).select("id", "stem_low", "k.kind", "k.key").join(asked, ["kind", "key"])
    return found.join(small(keyed), ["kind", "key"]).where(F.expr("stem_low rlike rx")).select("target", "id")


def answers(targets: DataFrame, notes: DataFrame, wildcards: bool = True) -> DataFrame:
    """(target, rule, id): all live notes that answer a target under the first rule that has any. targets: one column `target`, distinct."""
    live = notes.where(F.col("status") != "deleted").select("id", "path", "title", "aliases")
    keyed = live.select(
        "id",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(1).alias("rule"), F.col("id").alias("target")), F.struct(F.lit(2).alias("rule"), F.col("path").alias("target")), F.struct(F.lit(4).alias("rule"), F.col("title").alias("target"))),
                F.transform("aliases", lambda a: F.struct(F.lit(5).alias("rule"), a.alias("target"))),
            )
        ).alias("k"),
    ).select("id", "k.rule", "k.target")
    hits = targets.join(keyed, "target").select("target", "rule", "id").union(_stem_hits(targets, live, wildcards).select("target", F.lit(3).alias("rule"), "id"))
    first = F.min("rule").over(Window.partitionBy("target"))
    return hits.distinct().withColumn("first", first).where(F.col("rule") == F.col("first")).select("target", "rule", "id")


def _links(notes: DataFrame) -> DataFrame:
    live = notes.where(F.col("status") != "deleted")
    return live.select(F.col("id").alias("src"), F.col("path").alias("src_path"), F.explode(F.array_distinct("links")).alias("raw")).withColumn("target", normalize_target(F.col("raw"), F.col("src_path")))


def links(notes: DataFrame, found: DataFrame) -> DataFrame:
    """edges without their candidates, which are as many for each link as notes that it may mean; found: what answers() gives for the notes' targets."""
    one = found.groupBy("target").agg(F.min("rule").alias("rule"), F.count("*").alias("n"), F.min("id").alias("first"))
    state = F.when(F.col("n").isNull(), "broken").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return _links(notes).join(one, "target", "left").select("src", "src_path", "raw", "target", state.alias("state"), "rule", F.when(F.col("n") == 1, F.col("first")).alias("dst"))


def targets(notes: DataFrame) -> DataFrame:
    return _links(notes).select("target").distinct()


def edges(notes: DataFrame, wildcards: bool = True) -> DataFrame:
    """One row per link: src, src_path, raw (as written), target (normalised), state (resolved, ambiguous, broken), rule, dst and candidates (ids in order)."""
    links = _links(notes)
    found = answers(targets(notes), notes, wildcards).groupBy("target").agg(F.min("rule").alias("rule"), F.array_sort(F.collect_set("id")).alias("candidates"))
    joined = links.join(found, "target", "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    state = F.when(F.col("candidates").isNull(), "broken").when(n > 1, "ambiguous").otherwise("resolved")
    return joined.select("src", "src_path", "raw", "target", state.alias("state"), "rule", F.when(n == 1, F.element_at("candidates", 1)).alias("dst"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))

"""Tag derivation and index statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions.text import has_han, normalize_tag, utf16_length

MAX_DERIVED, MAX_VOCABULARY = 10, 5


def strip_prefix(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(segment, r"^\d{8}_\d{6}_", ""), r"^\d+_", "")


def folder_tag(path: Column) -> Column:
    """The deepest folder that is left after its prefixes go, if it has two characters; else null."""
    folders = F.filter(F.transform(F.split(path, "/"), lambda s, i: F.when(i < F.size(F.split(path, "/")) - 1, strip_prefix(s)).otherwise("")), lambda s: s != "")
    deepest = F.try_element_at(folders, F.lit(-1))
    return F.when(F.length(deepest) >= 2, normalize_tag(deepest))


def vocabulary(notes: DataFrame) -> DataFrame:
    """(stored, tag): the distinct tags of the index that are long enough to be looked for, as stored and as normalised."""
    tag = normalize_tag(F.col("stored"))
    stored = notes.select(F.explode("tags").alias("stored")).distinct()
    return stored.withColumn("tag", tag).where((F.length("tag") >= 2) & (has_han(F.col("tag")) | (utf16_length(F.col("tag")) >= 3)))


def vocabulary_tags(docs: DataFrame, words: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(key, tags): for each of docs (key, path, title, content) the five longest tags of the vocabulary that occur in it.

    One join, whatever the sizes: a tag's first three characters (of a Han tag of two characters, these) against the trigrams of the texts, or Han pairs, then the
    pairs so found are compared in full. postings: (gram, key) of the docs' trigrams, where an index has them; else they are made here."""
    text = docs.select("key", F.lower(F.concat_ws("\n", "title", "content", "path")).alias("hay"))
    heads = words.select("stored", "tag", F.substr("tag", F.lit(1), F.lit(3)).alias("gram"))
    each = postings if postings is not None else text.select("key", F.explode(F.array_distinct(F.regexp_extract_all("hay", F.lit(r"(?s)(?=(...))"), F.lit(1)))).alias("gram"))
    pairs = text.where(has_han(F.col("hay"))).select("key", F.explode(F.array_distinct(F.regexp_extract_all("hay", F.lit(r"(?s)(?=(\p{IsHan}.|.\p{IsHan}))"), F.lit(1)))).alias("gram"))
    maybe = each.select("key", "gram").join(heads.where(F.length("tag") > 2), "gram").union(pairs.join(heads.where(F.length("tag") == 2), "gram")).select("key", "stored", "tag")
    found = maybe.join(text, "key").where(F.contains("hay", F.col("tag"))).select("key", "stored", "tag")
    order = Window.partitionBy("key").orderBy(utf16_length(F.col("tag")).desc(), "stored")
    top = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MAX_VOCABULARY)
    return top.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "tag"))), lambda t: t["tag"]).alias("tags"))


def derive_tags(docs: DataFrame, notes: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(key, tags) for docs (key, path, title, content): inline tags, the folder's, then the vocabulary's; ten at most. postings: as vocabulary_tags takes them."""
    none = F.array().cast("array<string>")
    own = docs.select("key", F.concat(markdown.inline_tags(F.col("content")), F.filter(F.array(folder_tag(F.col("path"))), lambda t: t.isNotNull())).alias("own"))
    vocab = vocabulary_tags(docs, vocabulary(notes), postings)
    return own.join(vocab, "key", "left").select("key", F.slice(F.array_distinct(F.concat("own", F.coalesce("tags", none))), 1, MAX_DERIVED).alias("tags"))


def status_counts(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count_if(F.col("status") != "deleted").alias("total"), F.count_if(F.col("status") == "deleted").alias("deleted"))


def top_tags(notes: DataFrame, n: int = 20) -> DataFrame:
    return notes.where("status <> 'deleted'").select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag").limit(n)


def type_histogram(notes: DataFrame) -> DataFrame:
    return notes.where("status <> 'deleted'").groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")

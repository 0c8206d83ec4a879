"""Benchmark decontamination: a distributed positional inverted index, with DataFrame operations only.

A text's words are cut once into a stored forward table of blocks: BLOCK words each, with SPAN - 1 words of the neighbouring blocks on both sides,
so that no row grows with a text. From it come the corpus frequency of each benchmark word, and then the stored index: postings
(term, document, position) of the rarest terms of the benchmark's windows, with the words around them. A window is SPAN consecutive words
of an item (a whole shorter item). Its two rarest terms are looked up: the rarest one's list is joined by term, then intersected with
the second's, adjusted by the offset between the two; the words around the posting then tell how far the item agrees with
the document around it. A run of at least a window's length is an occurrence of each window in it; as every window holds its rarest term,
none is missed. Neighbouring windows that share their rarest terms share one lookup.

Proximity: `n_near` counts the items of which some window's two rarest terms lie within SPAN - 1 words of each other, in any order; exact
occurrences among them.

The benchmark's side is broadcast only if it has at most `max_broadcast` rows (counted), else joined by a shuffle, in which adaptive
execution splits hot terms.

Defined results: a null or empty text has no words, no hits and no items. Items without words, and null item_ids in the list of items, are
left out. Documents are told apart by doc_id and text, so rows that repeat both get equal results, each its own; a null doc_id is one like any
other. An empty benchmark contaminates nothing; an empty document table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, materialise

SPAN = 10
BLOCK = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; no words for null. Only A-Z are lower-cased: `lower` would change other letters, so it serves pure ASCII only."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), _SEPARATORS), lambda w: w != "")


def forward(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, h, n_words, base, words): blocks of a document's words; base is the position of the first of `words`. A document without words has one empty block."""
    text = F.col("text").cast("string")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), words_of(text).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_words") - 1) / BLOCK).cast("int")))
    pieces = F.transform(starts, lambda c: F.struct((c * BLOCK).alias("core"), F.greatest(F.lit(0), c * BLOCK - (span - 1)).alias("base"), F.slice("w", F.greatest(F.lit(0), c * BLOCK - (span - 1)) + 1, c * BLOCK + BLOCK + span - 1 - F.greatest(F.lit(0), c * BLOCK - (span - 1))).alias("words")))
    return cut.select("doc_id", "h", "n_words", F.explode(pieces).alias("p")).select("doc_id", "h", "n_words", "p.core", "p.base", "p.words")


def _core(blocks: DataFrame, *more: str) -> DataFrame:
    """(doc_id, h, pos, term) of each word, once."""
    core = F.slice("words", F.col("core") - F.col("base") + 1, F.lit(BLOCK))
    return blocks.select("doc_id", "h", "core", *more, F.posexplode(core).alias("k", "term")).select("doc_id", "h", (F.col("core") + F.col("k")).alias("pos"), "term", *more)


def _lookups(items: DataFrame, freq: DataFrame, span: int) -> DataFrame:
    """(term, p, term2, q, uid, words): for each window its rarest position p and second rarest q; windows with a word that no document has are left out."""
    starts = items.select("uid", F.size("words").alias("n"), F.posexplode("words").alias("pos", "term")).join(freq, "term", "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    # each position belongs to the windows that start at most span - 1 before it
    last = F.greatest(F.lit(0), F.col("n") - span)
    member = starts.select("uid", "pos", "term", "tf", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - (span - 1)), F.least(last, F.col("pos")))).alias("start"))
    ranked = member.groupBy("uid", "start").agg(F.array_sort(F.collect_list(F.struct("tf", "term", "pos"))).alias("by"))  # span rows a group
    live = ranked.where(F.col("by")[0]["tf"] > 0).select("uid", F.col("by")[0]["term"].alias("term"), F.col("by")[0]["pos"].alias("p"), F.coalesce(F.get("by", F.lit(1))["term"], F.col("by")[0]["term"]).alias("term2"), F.coalesce(F.get("by", F.lit(1))["pos"], F.col("by")[0]["pos"]).alias("q"))
    return live.distinct().join(items.select("uid", "words"), "uid")


def _run(step: int, span: int) -> Column:
    """How many words in a row agree, going from the posting in one direction."""
    at = lambda j: F.get("near", F.col("at") + step * j) == F.get("words", F.col("p") + step * j)
    same = F.transform(F.sequence(F.lit(1), F.lit(span - 1)), lambda j: F.coalesce(at(j), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.lit(span - 1)).otherwise(first - 1).cast("int")


def matches(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, max_broadcast: int = 500_000, work: Workspace | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, items): documents (doc_id, h, n_words), one row per input row; hits (doc_id, h, uid, first, after, exact): stretches of words that agree with item text uid, or with exact false
    a proximity match; items (uid, item_id)."""
    work = work or Workspace(docs.sparkSession)
    blocks = work.table(forward(docs, span), "decontam-forward")
    said = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    texts = work.table(said.select("words").distinct().withColumn("uid", F.monotonically_increasing_id()), "decontam-items")
    items = said.join(texts, "words").select("uid", "item_id").where("item_id is not null").distinct()
    terms, _ = broadcast_if_small(texts.select(F.explode("words").alias("term")).distinct(), max_broadcast)
    freq = work.table(_core(blocks).select("term").join(terms, "term").groupBy("term").agg(F.count("*").alias("tf")), "decontam-frequencies")
    lookups = work.table(_lookups(texts, freq, span), "decontam-lookups")
    wanted, _ = broadcast_if_small(lookups.select("term").union(lookups.select("term2")).distinct(), max_broadcast)
    near_from = F.greatest(F.lit(0), F.col("pos") - F.col("base") - (span - 1))
    index = (
        _core(blocks, "base", "words")
        .join(wanted, "term")
        .select("term", "doc_id", "h", "pos", F.slice("words", near_from + 1, F.col("pos") - F.col("base") - near_from + span).alias("near"), (F.col("pos") - F.col("base") - near_from).cast("int").alias("at"))
    )
    index = work.table(index, "decontam-postings")
    small, _ = broadcast_if_small(lookups, max_broadcast)
    first = index.join(small, "term").where(F.array_contains("near", F.col("term2"))).withColumn("pos2", F.col("pos") - F.col("p") + F.col("q"))
    second = index.select(F.col("term").alias("t2"), F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("pos").alias("p2"))
    both = first.join(second, (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("pos2") == F.col("p2")) & (F.col("term2") == F.col("t2")), "left_semi")
    agreed = both.withColumn("before", _run(-1, span)).withColumn("beyond", _run(1, span)).where(F.col("before") + F.col("beyond") + 1 >= F.least(F.lit(span), F.size("words")))
    exact = agreed.select("doc_id", "h", "uid", (F.col("pos") - F.col("before")).alias("first"), (F.col("pos") + F.col("beyond") + 1).alias("after"), F.lit(True).alias("exact"))
    near = first.select("doc_id", "h", "uid", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("after"), F.lit(False).alias("exact"))
    hits = work.table(exact.union(near).distinct(), "decontam-hits")
    work.drop("decontam-postings", "decontam-frequencies", "decontam-lookups")
    return blocks.where("core = 0").select("doc_id", "h", "n_words"), hits, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, max_broadcast: int = 500_000, work: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, h (its text's hash), n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    every, hits, items = matches(docs, benchmark, span, max_broadcast, work)
    exact = hits.where("exact")
    # a document's stretches in order; each adds what lies beyond the furthest end before it
    by_doc = Window.partitionBy("doc_id", "h").orderBy("first", "after")
    reach = F.coalesce(F.max("after").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = exact.select("doc_id", "h", "first", "after").distinct().withColumn("new", F.greatest(F.lit(0), F.col("after") - F.greatest(F.col("first"), reach))).groupBy("doc_id", "h").agg(F.sum("new").alias("n_hit"))
    own, _ = broadcast_if_small(items, max_broadcast)
    named = exact.select("doc_id", "h", "uid").distinct().join(own, "uid").groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("item_id")).alias("names"))
    close = hits.select("doc_id", "h", "uid").distinct().join(own, "uid").groupBy("doc_id", "h").agg(F.count("*").alias("n_near"))
    found = close.alias("a")
    for other in (covered, named):
        b = other.withColumnsRenamed({"doc_id": "d2", "h": "h2"})
        found = found.join(b, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left").drop("d2", "h2")
    found = found.withColumnsRenamed({"doc_id": "d2", "h": "h2"})
    names = F.coalesce("names", F.array().cast("array<string>"))
    return every.join(found, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left").select(
        "doc_id",
        "h",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no window of the benchmark."""
    work = Workspace(docs.sparkSession)
    found = decontaminate(docs, benchmark, span, work=work).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"))
    bad = materialise(docs.sparkSession, found.distinct(), "decontam-contaminated")
    work.drop()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_h")), "left_anti")

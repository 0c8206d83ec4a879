"""A corpus pipeline over the documents table: each stage works on all that the one before kept, read back from a written table. Columns besides doc_id, text and n_chars are passed on as they are; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm import bpe, decontam, ngram_join, pii, toxicity
from vaultspark.llm.common import materialise, prepare, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go. It is fitted on the labelled documents among its input.

    A null or empty text is judged by the thresholds alone, and stays unless toxic documents are the rule; without labels of both classes all stay. Each of several equal
    rows is judged, and alike; rows with a null doc_id are judged by their text and take no part in the fit."""
    prepare(spark)
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more, linked in any number of steps) one row stays: that of the smallest doc_id, null after
    all others; among rows of one doc_id that of the least text hash, then the first row. Texts without words (null, empty, blank) resemble nothing, so all stay."""
    prepare(spark)
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Documents and items without words hold nothing; an item with a null id counts; without items all documents stay.
    Rows are told apart by doc_id and text, null ids included, so equal rows go or stay together."""
    prepare(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars follows the new text. No document goes: a null text stays null (and n_chars becomes null), an empty one empty."""
    prepare(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of what they decode to: a row for each row, equal ones too. A null text has no ids, as an empty one."""
    prepare(spark)
    import public_tokenizers as P

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    # small chunks: by now the executors' JVMs have grown, and the shuffle may take more of the disk than that of the query alone
    whole = bpe.encode(docs, ranks, P.PATTERN, chunk_chars=4_000_000, decoded=True)
    return whole.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: Stages with a model, a join by search or a tokenizer have no SQL. Tests hold the whole against a plain version on a small fixture.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(spark, docs, f"pipeline-{name}")
    return docs

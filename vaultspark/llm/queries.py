"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, html_text, ngram_join, pii, sharding, toxicity, url_filter, warc
from .common import prepare, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("row", "page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h", "n_near")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    whole = bpe.encode(table(spark, sf_dir, "documents"), ranks, P.PATTERN, decoded=True)
    return whole.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_warc": op2_warc,
    "op3_ann": op3_ann,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_join": op8_ngram_join,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
}
QUERIES = {name: _prepared(query) for name, query in QUERIES.items()}

_REST = "substr(url, strpos(url, '://') + 3)"
_HOST = f"translate(CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract({_REST}, '^[^/?#]*') END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = f"CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) END"


def _fits(rule: url_filter.SiteRule) -> str:
    return f"(ends_with('.' || host, '.{rule.host}') AND starts_with(path, '{rule.path}'))"


def _glob_regex(glob: str) -> str:
    import re

    return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.sub(r"([.+(){}\[\]^$|\\])", r"\\\1", p) for p in re.findall(r"\*\*|\*|\?|[^*?]+", glob)) + "$"


_BY_LENGTH = sorted(url_filter.SITE_RULES, key=lambda r: -len(r.name))
_GLOB = "CASE " + " ".join(f"WHEN host <> '' AND regexp_matches('.' || host || path, '{_glob_regex(g)}') THEN '{g}'" for g in url_filter.BLOCK_GLOBS) + " END"

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, list_slice(w, s, s + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS k FROM bw),
dw AS (SELECT doc_id, s, k, list_slice(w, s, s + k - 1) AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, s, k, item_id FROM dw JOIN bw ON dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op8_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s), t AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
walk AS (SELECT doc_id, doc_id AS at FROM n UNION SELECT walk.doc_id, e.b FROM walk JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON e.a = walk.at)
SELECT n.doc_id, n.n AS n_shingles, min(walk.at) AS component_id FROM n JOIN walk USING (doc_id) GROUP BY ALL""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND keeper <> page_id THEN keeper END AS refers_to
FROM k""",
    "op5_url_filter": f"""
WITH parts AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
ruled AS (SELECT *, CASE {' '.join(f"WHEN {_fits(r)} THEN '{r.name}'" for r in _BY_LENGTH)} END AS rule, {_GLOB} AS held FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN held END AS glob,
  CASE {' '.join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in _BY_LENGTH)} WHEN held IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
}

"""The registered queries over the virtual vault and the driver's tables, each beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown, text
from ..operators import explore, graph, search, sync, tags
from ..streaming import changes
from . import virtual_vault
from .virtual_vault import NOTES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_BASE = f"WITH RECURSIVE base AS ({NOTES_SQL}), live AS (SELECT * FROM base WHERE status <> 'deleted')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"{_BASE} {sql}"
        return f

    return register


_base, _index = virtual_vault.base_notes, virtual_vault.index


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).notes()


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _notes(spark, d), _index(spark, d).edges()


# --- parsing ---

_WIKI = r"'\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]'"
_MD = r"'\[[^\]]+\]\(([^)#]+)(?:#[^)]+)?\)'"
_WIKI_LIST = f"list_transform(regexp_extract_all(body, {_WIKI}, 1), lambda x: trim(x))"
_MD_LIST = f"list_filter(regexp_extract_all(body, {_MD}, 1), lambda x: ends_with(x, '.md'))"


@query(f"SELECT id, len(l) AS n, array_to_string(l, '|') AS targets FROM (SELECT id, {_WIKI_LIST} AS l FROM base)")
def parse_wiki_links(spark, d):
    l = markdown.wiki_links(F.col("body"))  # noqa: E741
    return _base(spark, d).select("id", F.size(l).cast("long").alias("n"), F.array_join(l, "|").alias("targets"))


@query(f"SELECT id, len(l) AS n, array_to_string(l, '|') AS targets FROM (SELECT id, {_MD_LIST} AS l FROM base)")
def parse_md_links(spark, d):
    l = markdown.markdown_links(F.col("body"))  # noqa: E741
    return _base(spark, d).select("id", F.size(l).cast("long").alias("n"), F.array_join(l, "|").alias("targets"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_concat({_WIKI_LIST}, {_MD_LIST}))), '|') AS targets FROM base")
def link_set(spark, d):
    return _base(spark, d).select("id", F.array_join(F.array_sort(markdown.links(F.col("body"))), "|").alias("targets"))


_LINES = """, lines AS (SELECT id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS raw FROM (SELECT id, string_split(body, chr(10)) AS l FROM base)),
placed AS (SELECT id, line, raw, sum(length(raw) + 1) OVER (PARTITION BY id ORDER BY line) - length(raw) - 1 AS position FROM lines),
heads AS (SELECT id, line, CAST(position AS BIGINT) AS position, CAST(length(regexp_extract(raw, '^(#{1,6})[ \\t]+(.+?)\\s*$', 1)) AS BIGINT) AS level,
  trim(regexp_replace(regexp_extract(raw, '^(#{1,6})[ \\t]+(.+?)\\s*$', 2), '[ \\t]+#+[ \\t]*$', '')) AS text FROM placed),
h AS (SELECT * FROM heads WHERE level > 0 AND text <> '')"""


def _outline(spark, d):
    return _base(spark, d).select("id", F.explode(markdown.headings(F.col("body"))).alias("h"))


@query(_BASE + _LINES + " SELECT id, line, level, position, text FROM h")
def headings(spark, d):
    return _outline(spark, d).select("id", F.col("h.line").cast("long").alias("line"), F.col("h.level").cast("long").alias("level"), F.col("h.position").cast("long").alias("position"), "h.text")


@query(
    _BASE
    + _LINES
    + """ SELECT h.id, h.line, concat_ws(' > ', (SELECT string_agg(a.text, ' > ' ORDER BY a.line) FROM h a WHERE a.id = h.id AND a.line < h.line AND a.level < h.level
  AND NOT EXISTS (SELECT 1 FROM h b WHERE b.id = h.id AND b.line > a.line AND b.line < h.line AND b.level <= a.level)), h.text) AS path FROM h"""
)
def heading_path(spark, d):
    return _outline(spark, d).select("id", F.col("h.line").cast("long").alias("line"), F.array_join("h.path", " > ").alias("path"))


@query(
    _BASE
    + _LINES
    + r""", bases AS (SELECT id, line, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(text)), '[`*_~]', '', 'g'), '[^\p{L}\p{N}\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), ''), 'heading') AS b FROM h)
SELECT id, line, CASE WHEN n = 1 THEN b ELSE b || '-' || n END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY id, b ORDER BY line) AS n FROM bases)"""
)
def heading_slug(spark, d):
    return _outline(spark, d).select("id", F.col("h.line").cast("long").alias("line"), "h.slug")


_TAGS = r"""list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(body, '(?s)```.*?```', ' ', 'g'), '`[^`\n]+`', ' ', 'g'), '(?:^|[\s(（\[【"''，。；：、])#([\p{L}_][\p{L}\p{N}_\-/]{0,63})', 1), lambda x: lower(x)))"""


@query(f"SELECT id, array_to_string(list_sort({_TAGS}), ',') AS tags FROM base")
def inline_tags(spark, d):
    return _base(spark, d).select("id", F.array_join(F.array_sort(markdown.inline_tags(F.col("body"))), ",").alias("tags"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_concat([upper(type), 'tag1'], {_TAGS}))), ',') AS tags FROM base")
def tag_union(spark, d):
    both = F.array_union(F.array(F.upper("type"), F.lit("tag1")), markdown.inline_tags(F.col("body")))
    return _base(spark, d).select("id", F.array_join(F.array_sort(both), ",").alias("tags"))


@query("SELECT id, sha256(body) AS hash FROM base")
def content_hash(spark, d):
    return _base(spark, d).select("id", text.sha256(F.col("body")).alias("hash"))


# --- search ---

_FTS_COLUMNS = {"title": "lower(title)", "path": "lower(path)", "body": "lower(body)", "tags": f"lower(array_to_string({_TAGS}, ' '))", "aliases": "lower(alias)"}


def _fts_sql(phrases: list[str], match: str, where: str = "TRUE", limit: int = 10) -> str:
    """match: over has0, has1, ..."""
    lit = [p.replace("'", "''") for p in phrases]
    has = ", ".join("(" + " OR ".join(f"contains(c_{c}, '{p}')" for c in _FTS_COLUMNS) + f") AS has{k}" for k, p in enumerate(lit))
    f = ", ".join("(" + " + ".join(f"{w} * ((length(c_{c}) - length(replace(c_{c}, '{p}', ''))) // {len(phrases[k])})" for c, w in search.WEIGHTS.items()) + f") AS f{k}" for k, p in enumerate(lit))
    size = " + ".join(f"greatest(0, length(c_{c}) - 2)" for c in _FTS_COLUMNS)
    n = ", ".join(f"sum(CASE WHEN has{k} THEN 1 ELSE 0 END) AS n{k}" for k in range(len(phrases)))
    idf = ", ".join(f"CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) > 0 THEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) ELSE 1e-6 END AS idf{k}" for k in range(len(phrases)))
    rank = " - ".join(["0"] + [f"idf{k} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(phrases))])
    return f"""{_BASE}, cols AS (SELECT id, path, type, status, {', '.join(f"{e} AS c_{c}" for c, e in _FTS_COLUMNS.items())} FROM live),
m AS (SELECT id, path, type, status, c_tags, ({size}) AS dl, {has}, {f} FROM cols),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {n} FROM m), i AS (SELECT avgdl, {idf} FROM s)
SELECT id, round({rank}, 9) AS rank FROM m, i WHERE ({match}) AND {where} ORDER BY {rank}, path LIMIT {limit}"""


def _fts(spark, d, q, **more):
    return search.search_fts(_index(spark, d), q, **more).select("id", F.round("rank", 9).alias("rank"))


@query(_fts_sql(["thing", "tion"], "has0 AND has1"))
def search_fts_and(spark, d):
    return _fts(spark, d, "thing tion")


@query(_fts_sql(["ciónes", "keitver", "eauxre"], "has0 OR has1 OR has2", limit=50))
def search_fts_or(spark, d):
    return _fts(spark, d, "ciónes OR keitver OR eauxre", limit=50)


@query(_fts_sql(["tion", "thing", "heed"], "has0 AND NOT (has1 AND has2)", limit=25))
def search_fts_not(spark, d):
    return _fts(spark, d, "tion NOT thing heed", limit=25)


@query(_fts_sql(["of the"], "has0"))
def search_phrase(spark, d):
    return _fts(spark, d, '"of the"')


@query(_fts_sql(["tion"], "has0", "type = 'en' AND status = 'archived' AND regexp_matches(c_tags, '(^| )tag3( |$)')"))
def search_filtered(spark, d):
    return _fts(spark, d, "tion", type="en", status="archived", tag="tag3")


_FOLD = {c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" for c in ("title", "path", "body")}
_LIKE_HIT = " AND ".join("(" + " OR ".join(f"contains({e}, '{t}')" for e in _FOLD.values()) + ")" for t in ("src1", "the"))
_LIKE_ORDER = f"contains({_FOLD['title']}, 'src1') DESC, contains({_FOLD['path']}, 'src1') DESC, length(body), title, path"


@query(f"SELECT id, path FROM live WHERE {_LIKE_HIT} ORDER BY {_LIKE_ORDER} LIMIT 20")
def search_like(spark, d):
    return search.search_like(_notes(spark, d), "SRC1 the", 20).select("id", "path")


@query(
    """SELECT id, CASE WHEN a > 0 THEN CASE WHEN greatest(1, a - 20) > 1 THEN '… ' ELSE '' END || substr(body, greatest(1, a - 20), a - greatest(1, a - 20)) || '[' || substr(body, a, 4) || ']' || substr(body, a + 4, 40)
  || CASE WHEN a + 44 <= length(body) THEN ' …' ELSE '' END ELSE substr(body, 1, 80) END AS snippet FROM (SELECT *, instr(lower(body), 'tion') AS a FROM live)"""
)
def like_snippet(spark, d):
    return _base(spark, d).where("status <> 'deleted'").select("id", search.like_snippet(F.col("body"), ["tion"]).alias("snippet"))


# --- links and graph ---

_EDGES = f""", links AS (SELECT id AS src, path AS src_path, unnest(list_distinct(list_concat({_WIKI_LIST}, {_MD_LIST}))) AS raw FROM live),
norm AS (SELECT *, CASE WHEN starts_with(raw, './') THEN regexp_replace(src_path, '/[^/]*$', '') || '/' || substr(raw, 3) WHEN ends_with(raw, '.md') THEN regexp_replace(src_path, '/[^/]*$', '') || '/' || raw ELSE raw END AS target FROM links),
t AS (SELECT DISTINCT target FROM norm),
hits AS (SELECT target, 1 AS rule, id FROM t JOIN live ON id = target UNION ALL SELECT target, 2, id FROM t JOIN live ON path = target
  UNION ALL SELECT target, 3, id FROM t JOIN live ON path = target || '.md' OR lower(path) LIKE lower('%/' || target || '.md')
  UNION ALL SELECT target, 4, id FROM t JOIN live ON title = target UNION ALL SELECT target, 5, id FROM t JOIN live ON alias = target),
best AS (SELECT target, min(rule) AS rule FROM hits GROUP BY target),
ans AS (SELECT target, rule, count(DISTINCT id) AS n, min(id) AS one, string_agg(DISTINCT id, ',' ORDER BY id) AS candidates FROM hits JOIN best USING (target, rule) GROUP BY target, rule),
e AS (SELECT src, src_path, raw, norm.target, CASE WHEN n IS NULL THEN 'broken' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS state, rule, CASE WHEN n = 1 THEN one END AS dst, coalesce(candidates, '') AS candidates FROM norm LEFT JOIN ans USING (target)),
back AS (SELECT dst, src, min(src_path) AS src_path, min(raw) AS raw FROM e WHERE state = 'resolved' AND src <> dst GROUP BY dst, src)"""


@query(_BASE + _EDGES + " SELECT src, raw, target, state, CAST(rule AS INTEGER) AS rule, dst FROM e")
def resolve_links(spark, d):
    return _edges(spark, d)[1].select("src", "raw", "target", "state", "rule", "dst")


@query(_BASE + _EDGES + " SELECT src, raw FROM e WHERE state = 'broken'")
def broken_links(spark, d):
    return _edges(spark, d)[1].where("state = 'broken'").select("src", "raw")


@query(_BASE + _EDGES + " SELECT src, raw, candidates FROM e WHERE state = 'ambiguous'")
def ambiguous_links(spark, d):
    return _edges(spark, d)[1].where("state = 'ambiguous'").select("src", "raw", F.array_join("candidates", ",").alias("candidates"))


@query(_BASE + _EDGES + " SELECT dst, src, raw FROM back")
def backlinks(spark, d):
    return graph.backlinks(_edges(spark, d)[1]).select("dst", "src", "raw")


@query(
    _BASE
    + _EDGES
    + """, k AS (SELECT src AS id, 'out' AS kind, dst AS other, raw, raw AS o1, '' AS o2 FROM e WHERE state = 'resolved' UNION ALL SELECT src, 'broken', NULL, raw, raw, '' FROM e WHERE state = 'broken'
  UNION ALL SELECT dst, 'back', src, raw, src_path, raw FROM back UNION ALL SELECT src, 'ambiguous', src, raw, '', raw FROM e WHERE state = 'ambiguous'
  UNION ALL SELECT m.id, 'ambiguous', e.src, e.raw, '/' || e.src_path, e.raw FROM e JOIN hits m ON m.target = e.target AND m.rule = e.rule LEFT JOIN back b ON b.dst = m.id AND b.src = e.src WHERE e.state = 'ambiguous' AND m.id <> e.src AND (b.raw IS NULL OR e.raw < b.raw))
SELECT id, kind, CAST(n AS INTEGER) AS ord, other, raw FROM (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY o1, o2) AS n FROM k) WHERE n <= 20"""
)
def graph_context(spark, d):
    # without the texts, and without the candidates of each link: those of an alias are a share of all notes
    index = _index(spark, d)
    unsure = index.answers().join(index.links().where("state = 'ambiguous'").select("target").distinct(), "target", "left_semi")
    return graph.context(index.cards(), index.links(), hits=unsure.select("target", "id"))


@query(
    _BASE
    + _EDGES
    + """, o AS (SELECT src, count(*) AS outlinks, sum(CASE WHEN state = 'broken' THEN 1 ELSE 0 END) AS broken FROM e GROUP BY src), b AS (SELECT dst, count(*) AS backlinks FROM back GROUP BY dst),
op AS (SELECT src, string_agg(dst, ',' ORDER BY raw) AS p FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY raw) AS n FROM e WHERE state = 'resolved') WHERE n <= 3 GROUP BY src),
bp AS (SELECT dst, string_agg(src, ',' ORDER BY src_path) AS p FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src_path) AS n FROM back) WHERE n <= 3 GROUP BY dst)
SELECT id, coalesce(outlinks, 0) AS outlinks, CAST(coalesce(broken, 0) AS BIGINT) AS broken, coalesce(backlinks, 0) AS backlinks, coalesce(op.p, '') AS out_preview, coalesce(bp.p, '') AS back_preview
FROM live LEFT JOIN o ON o.src = id LEFT JOIN b ON b.dst = id LEFT JOIN op ON op.src = id LEFT JOIN bp ON bp.dst = id"""
)
def graph_summary(spark, d):
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",").alias(c)
    return graph.summaries(*_edges(spark, d)).select("id", "outlinks", "broken", "backlinks", ids("out_preview"), ids("back_preview"))


def _bfs_sql(way: str) -> str:
    step = {"out": "SELECT src AS a, dst AS b FROM e WHERE state = 'resolved'", "both": "SELECT src AS a, dst AS b FROM e WHERE state = 'resolved' UNION SELECT dst, src FROM back"}[way]
    return f"""{_BASE}{_EDGES}, s AS ({step}), walk AS (SELECT 'doc_1' AS id, 0 AS depth UNION SELECT s.b, depth + 1 FROM walk JOIN s ON s.a = walk.id WHERE depth < 2)
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id"""


def _bfs(spark, d, way):
    # no cut: as many nodes as there are, and backlinks without their limit
    return graph.reach(*_edges(spark, d), "doc_1", depth=2, direction=way)


@query(_bfs_sql("out"))
def graph_bfs_out(spark, d):
    return _bfs(spark, d, "out")


@query(_bfs_sql("both"))
def graph_bfs_both(spark, d):
    return _bfs(spark, d, "both")


#: A search that meets both of its limits: so many nodes, and so many backlinks of each.
_CUT_NODES, _CUT_BACK = 12, 2
_CUT_SQL = f"""{_BASE}{_EDGES}, b AS (SELECT dst, src, raw, src_path FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src_path, raw) AS n FROM back) WHERE n <= {_CUT_BACK}),
s AS (SELECT src AS near, dst AS far, raw, 0 AS way, raw AS o FROM e WHERE state = 'resolved' UNION ALL SELECT dst, src, raw, 1, src_path FROM b),
f1 AS (SELECT *, 0 AS place FROM s WHERE near = 'doc_1'),
n1 AS (SELECT far AS id, place, way, o FROM f1 WHERE far <> 'doc_1' QUALIFY row_number() OVER (PARTITION BY far ORDER BY place, way, o) = 1),
k1 AS (SELECT *, row_number() OVER (ORDER BY place, way, o, id) AS ord FROM n1 QUALIFY row_number() OVER (ORDER BY place, way, o, id) < {_CUT_NODES}),
c1 AS (SELECT count(*) AS n FROM k1), e1 AS (SELECT (place, way, o, id) AS last FROM k1 ORDER BY ord DESC LIMIT 1),
f2 AS (SELECT s.*, k1.ord AS place FROM s JOIN k1 ON s.near = k1.id WHERE (SELECT n FROM c1) < {_CUT_NODES} - 1),
n2 AS (SELECT far AS id, place, way, o FROM f2 WHERE far <> 'doc_1' AND far NOT IN (SELECT id FROM k1) QUALIFY row_number() OVER (PARTITION BY far ORDER BY place, way, o) = 1),
k2 AS (SELECT *, (SELECT n FROM c1) + row_number() OVER (ORDER BY place, way, o, id) AS ord FROM n2 QUALIFY row_number() OVER (ORDER BY place, way, o, id) < {_CUT_NODES} - (SELECT n FROM c1)),
e2 AS (SELECT (place, way, o, id) AS last, count(*) OVER () AS n FROM k2 ORDER BY ord DESC LIMIT 1),
taken AS (SELECT 1 AS level, near, far, raw, way, place, o FROM f1 WHERE (SELECT n FROM c1) < {_CUT_NODES} - 1 OR (place, way, o, far) <= (SELECT last FROM e1)
  UNION ALL SELECT 2, near, far, raw, way, place, o FROM f2 WHERE coalesce((SELECT n FROM e2), 0) < {_CUT_NODES} - 1 - (SELECT n FROM c1) OR (place, way, o, far) <= (SELECT last FROM e2))"""


def _cut(spark, d):
    return graph.bfs(*_edges(spark, d), "doc_1", depth=2, max_nodes=_CUT_NODES, back_limit=_CUT_BACK)


@query(_CUT_SQL + " SELECT 'doc_1' AS id, 0 AS depth, 0 AS ord UNION ALL SELECT id, 1, CAST(ord AS INTEGER) FROM k1 UNION ALL SELECT id, 2, CAST(ord AS INTEGER) FROM k2")
def graph_bfs_cut(spark, d):
    return _cut(spark, d)[0]


@query(
    _CUT_SQL
    + """ SELECT src, dst, raw FROM (SELECT CASE WHEN way = 0 THEN near ELSE far END AS src, CASE WHEN way = 0 THEN far ELSE near END AS dst, raw, level, place, way, o, far FROM taken)
QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY level, place, way, o, far) = 1"""
)
def graph_bfs_cut_edges(spark, d):
    return _cut(spark, d)[1]


# --- statistics and tags ---


@query("SELECT count(*) FILTER (WHERE status <> 'deleted') AS total, count(*) FILTER (WHERE status = 'deleted') AS deleted FROM base")
def status_counts(spark, d):
    return tags.status_counts(_notes(spark, d))


@query(f'SELECT tag, count(*) AS "count" FROM (SELECT unnest({_TAGS}) AS tag FROM live) GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 20')
def top_tags(spark, d):
    return tags.top_tags(_notes(spark, d))


@query('SELECT type, count(*) AS "count" FROM live GROUP BY type')
def type_histogram(spark, d):
    return tags.type_histogram(_notes(spark, d))


_PREFIXED = "('20240102_030405_' || source || '/' || doc_id || '_' || lang || '/n.md')"
_STRIP = lambda e: f"regexp_replace(regexp_replace({e}, '^\\d{{8}}_\\d{{6}}_', ''), '^\\d+_', '')"


@query(f"WITH p AS (SELECT doc_id, {_PREFIXED} AS path FROM documents) SELECT doc_id, lower({_STRIP('string_split(path, chr(47))[2]')}) AS tag FROM p")
def folder_tag(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", tags.folder_tag(F.expr(_PREFIXED)).alias("tag"))


_VOCAB = f""", words AS (SELECT DISTINCT unnest({_TAGS}) AS tag FROM live),
found AS (SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY length(tag) DESC, tag) AS n FROM base JOIN words ON length(tag) >= 3 AND contains(lower(title || chr(10) || body || chr(10) || path), tag)),
vocab AS (SELECT id, string_agg(tag, ',' ORDER BY n) AS tags FROM found WHERE n <= 5 GROUP BY id)"""


def _as_docs(spark, d):
    """The notes, the same as texts to be tagged, by number, and their postings."""
    notes = _notes(spark, d)
    return notes, notes.select(F.col("no").alias("key"), "id", "path", "title", F.col("body").alias("content")), _index(spark, d).postings().withColumnRenamed("no", "key")


@query(_BASE + _VOCAB + " SELECT id, tags FROM vocab")
def vocab_tags(spark, d):
    notes, docs, postings = _as_docs(spark, d)
    return tags.vocabulary_tags(docs, tags.vocabulary(notes), postings).join(docs, "key").select("id", F.array_join("tags", ",").alias("tags"))


@query(
    _BASE
    + _VOCAB
    + f""", own AS (SELECT id, list_concat(list_sort({_TAGS}), [lower(regexp_extract(path, '([^/]*)/[^/]*$', 1))]) AS l FROM base), every AS (SELECT own.id, list_concat(l, coalesce(string_split(tags, ','), [])) AS l FROM own LEFT JOIN vocab USING (id))
SELECT id, array_to_string(list_sort(list_distinct(l)), ',') AS tags FROM every"""
)
def derive_tags(spark, d):
    notes, docs, postings = _as_docs(spark, d)
    return tags.derive_tags(docs, notes, postings).join(docs.select("key", "id"), "key").select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


# --- sync and changes ---

_SCAN = "SELECT 'n' || doc_id || '.md' AS path, length(text) AS size, doc_id * 10 AS mtime_ms FROM documents WHERE doc_id % 7 <> 0"
_FILES = "SELECT 'n' || doc_id || '.md' AS path, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE length(text) END AS size, CASE WHEN doc_id % 13 = 0 THEN 5 ELSE doc_id * 10 END AS mtime_ms, doc_id % 17 = 0 AS deleted FROM documents WHERE doc_id % 5 <> 0"


@query(
    f"""WITH s AS ({_SCAN}), f AS (SELECT * FROM ({_FILES}) WHERE NOT deleted)
SELECT coalesce(s.path, f.path) AS path, CASE WHEN s.path IS NULL THEN 'removed' WHEN f.path IS NULL THEN 'added' WHEN s.size = f.size AND s.mtime_ms = f.mtime_ms THEN 'unchanged' ELSE 'changed' END AS action FROM s FULL OUTER JOIN f ON s.path = f.path"""
)
def sync_diff(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scan, files = (spark.sql(q.replace("FROM documents", "FROM {documents}"), documents=docs) for q in (_SCAN, _FILES))
    return sync.diff(scan, files)


@query("WITH p AS (SELECT 'k' || (doc_id % 300) AS id, 'n' || doc_id || '.md' AS path FROM documents), k AS (SELECT *, min(path) OVER (PARTITION BY id) AS keeper FROM p) SELECT id, path, keeper FROM k WHERE path <> keeper")
def duplicate_ids(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return sync.first_of_id(docs.selectExpr("'k' || (doc_id % 300) AS id", "'n' || doc_id || '.md' AS path"))


@query(
    """WITH g AS (SELECT user_id, ts, event_type, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, count(DISTINCT event_type) AS paths FROM n GROUP BY user_id, session"""
)
def debounce_sessions(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "path")
    return changes.sessions(events, "user_id", "ts", 3_600_000).select("user_id", "session", "events", "paths")


@query(
    f"""WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS pending FROM events GROUP BY 1)
SELECT hour, pending, pending > 0 AND pending <= {changes.SCOPED_PATHS} AS scoped, CASE WHEN pending <= {changes.QUICK_PATHS} THEN {changes.QUICK_MS} ELSE {changes.FULL_MS} END AS window_ms FROM h"""
)
def scoped_or_full(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    pending = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count_distinct("user_id").alias("pending"))
    return pending.select("hour", "pending", F.col("pending").between(1, changes.SCOPED_PATHS).alias("scoped"), F.when(F.col("pending") <= changes.QUICK_PATHS, changes.QUICK_MS).otherwise(changes.FULL_MS).alias("window_ms"))


_QUICK, _FULL = 1_200_000, 9_000_000  # twenty minutes and two and a half hours: the events lie hours apart


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type AS path, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type) AS n FROM events),
r AS (SELECT user_id, n, [path] AS pending, ms + {_QUICK} AS due, CAST(NULL AS BIGINT) AS flushed, CAST(NULL AS VARCHAR[]) AS paths FROM e WHERE n = 1
  UNION ALL SELECT user_id, n, pending, ms + CASE WHEN len(pending) <= {changes.QUICK_PATHS} THEN {_QUICK} ELSE {_FULL} END, flushed, paths FROM (
    SELECT e.user_id, e.n, e.ms, CASE WHEN e.ms >= r.due THEN [e.path] ELSE list_distinct(list_append(r.pending, e.path)) END AS pending,
      CASE WHEN e.ms >= r.due THEN r.due END AS flushed, CASE WHEN e.ms >= r.due THEN r.pending END AS paths FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)),
f AS (SELECT user_id, flushed AS due_ms, paths FROM r WHERE flushed IS NOT NULL UNION ALL SELECT user_id, due, pending FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id, due_ms, array_to_string(list_sort(paths), ',') AS paths FROM f"""
)
def debounce_flushes(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    found = changes.flushes(events, "user_id", "at", "event_type", quick_ms=_QUICK, full_ms=_FULL)
    return found.select("user_id", "due_ms", F.array_join("paths", ",").alias("paths"))


# --- exploration ---


@query("SELECT id, len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')) < 8 AS tiny FROM base")
def is_tiny_body(spark, d):
    return _base(spark, d).select("id", explore.tiny(F.col("body")).alias("tiny"))


@query("SELECT id, NOT (contains(lower(title || ' ' || path), 'thing') OR contains(lower(title || ' ' || path), 'src1')) AS weak FROM base")
def weak_match(spark, d):
    return _base(spark, d).select("id", explore.weak("Thing SRC1", F.concat_ws(" ", "title", "path")).alias("weak"))


@query()
def fts_snippet(spark, d):
    return search.search_fts(_index(spark, d), "thing OR ciónes OR keit", limit=50).select("id", "snippet")


_CAP = 600


@query(
    _BASE
    + _LINES
    + f""", places AS (SELECT id, body, coalesce((SELECT max(position) FROM h WHERE h.id = base.id AND position BETWEEN 1 AND {_CAP}), 0) AS at_heading,
  CASE WHEN strpos(reverse(substr(body, 1, {_CAP})), chr(10)) > 0 THEN {_CAP} + 1 - strpos(reverse(substr(body, 1, {_CAP})), chr(10)) ELSE 0 END AS at_line FROM base),
cut AS (SELECT id, body, CASE WHEN length(body) <= {_CAP} THEN length(body) WHEN at_heading >= {_CAP} * 0.6 THEN at_heading WHEN at_line >= {_CAP} * 0.6 THEN at_line ELSE {_CAP} END AS n FROM places)
SELECT id, substr(body, 1, n) AS body, length(body) > {_CAP} AS truncated,
  CASE WHEN length(body) > {_CAP} THEN coalesce((SELECT string_agg(text, '|' ORDER BY position) FROM (SELECT text, position FROM h WHERE h.id = cut.id AND position >= cut.n ORDER BY position LIMIT 8)), '') ELSE '' END AS omitted FROM cut"""
)
def slice_body(spark, d):
    cut = explore.slices(_base(spark, d).select("id", "body", markdown.headings(F.col("body")).alias("headings")), _CAP)
    return cut.withColumn("omitted", F.array_join("omitted", "|"))


@query()
def explore_notes(spark, d):
    notes = _notes(spark, d).withColumn("headings", markdown.headings(F.col("body")))
    got = explore.explore(notes, _index(spark, d), "thing tion", 3)
    rows = [("answer", a["id"], a["title"], a["body"], a["truncated"]) for a in got["answerNotes"]] + [("pointer", p["id"], p["title"], None, False) for p in got["relatedPointers"]]
    return spark.createDataFrame(rows, "kind string, id string, title string, body string, truncated boolean")

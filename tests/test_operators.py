"""Operators on small inputs whose results are known."""

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from vaultspark.functions import frontmatter, markdown
from vaultspark.functions.text import fallback_id, posix_normalize, utf16_length
from vaultspark.operators import explore, ftsquery, graph, resolve, search
from vaultspark.sources import index
from vaultspark.streaming import changes


def one(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(column.alias("x")).first()["x"]


def test_headings(spark):
    body = "# Overview\nIntro.\n## Research ##\nContext.\n### Method\nDetails.\n## Research\nDuplicate heading.\n#nope\n# \n"
    got = one(spark, markdown.headings(F.col("b")), b=body)
    assert [(h["level"], h["text"], h["slug"], h["line"]) for h in got] == [(1, "Overview", "overview", 1), (2, "Research", "research", 3), (3, "Method", "method", 5), (2, "Research", "research-2", 7)]
    assert got[3]["path"] == ["Overview", "Research"] and got[2]["path"] == ["Overview", "Research", "Method"]
    assert got[1]["position"] == body.index("## Research")
    assert one(spark, markdown.headings(F.col("b")), b="😀\n# `A` *b*!\n")[0]["position"] == 3
    assert one(spark, markdown.headings(F.col("b")), b="# `A` *b*!")[0]["slug"] == "a-b"


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from vaultspark.sources.shared import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_many_headings_take_little_time(spark):
    import time

    many = "".join(f"{'#' * (1 + k % 3)} h{k // 2}\ntext\n" for k in range(5000))
    began = time.time()
    got = one(spark, markdown.headings(F.col("b")), b=many)
    assert time.time() - began < 20 and [h["slug"] for h in got[:4]] == ["h0", "h0-2", "h1", "h1-2"] and got[-1]["line"] == 9999
    assert [h["line"] for h in got] == list(range(1, 10_000, 2)) and got[4999]["position"] == many.rindex("#" * (1 + 4999 % 3) + " h")
    assert one(spark, markdown.headings(F.col("b")), b="") == [] and spark.createDataFrame([(None,)], "b string").select(markdown.headings(F.col("b"))).first()[0] is None


def test_index_reads_blocks_that_may_match(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PER_BLOCK", 5)
    cols = "id string, path string, title string, type string, status string, tags array<string>, aliases array<string>, links array<string>, body string"
    rows = [(f"n{k}", f"p/{k}.md", f"t{k}", "note", "deleted" if k == 9 else "active", ["tag"], [], [], "common words " + ("rare needle" if k in (3, 9) else "need edle" if k == 30 else "need leaf")) for k in range(40)]
    idx = index.Index(spark, f"file://{tmp_path}/index", lambda: spark.createDataFrame(rows, cols))
    assert idx.notes().select("block").distinct().count() == 8 and idx.notes().count() == 40
    assert idx.figures()[0] == 39 and idx.postings().where("gram = 'nee'").count() == 40
    held = idx.holding(["needle"])
    assert {r["id"] for r in held.where(F.contains("_body", F.lit("needle"))).collect()} == {"n3", "n9"} and held.select("block").distinct().count() <= 3
    assert idx.holding(["zzz"]).count() == 0 and idx.holding([]).count() == 0 and 0 < idx.holding(["zzz", "rare needle"]).count() <= held.count()
    assert [r["id"] for r in search.search(idx, "needle").collect()] == ["n3"] and search.search(idx, "no such").count() == 0
    empty = index.Index(spark, f"file://{tmp_path}/empty", lambda: spark.createDataFrame([], cols))
    assert empty.figures() == (0, 1.0) and search.search(empty, "needle").count() == 0 and empty.edges().count() == 0


def test_links_and_tags(spark):
    body = "[[ a |x]] [[b#h]] ![i](c.md#x) [u](https://h/d.md) [e](f.mdx) [[#h]] [[a]]"
    assert one(spark, markdown.links(F.col("b")), b=body) == ["a", "b", "c.md", "https://h/d.md"]
    tags = "#One (#Two) a#no `#code`\n```\n#fenced\n```\n，#中文标签 #9no"
    assert one(spark, markdown.inline_tags(F.col("b")), b=tags) == ["one", "two", "中文标签"]


def test_paths_and_lengths(spark):
    assert one(spark, posix_normalize(F.col("p")), p="a/./b/../../../c//d.md") == "../c/d.md"
    assert one(spark, utf16_length(F.col("p")), p="a😀") == 3
    assert one(spark, fallback_id(F.col("p")), p="Über Ort/My Note.MD") == "ber_ort_my_note"


def test_frontmatter(spark):
    raw = "---\nid: 42\ntitle: yes\ncreated: 2024-05-06\ntags: a, B\naliases: [1, true]\n---\nbody\n"
    d = frontmatter.read_yaml(one(spark, frontmatter.block(F.col("r")), r=raw))
    assert (d["id"], d["title"], d["created"], d["tags"], d["aliases"]) == (None, "yes", "2024-05-06", ["a", "B"], ["1", "true"])
    assert one(spark, frontmatter.body(F.col("r")), r=raw) == "body\n"
    assert one(spark, frontmatter.body(F.col("r")), r="----\nx") == "----\nx"


def vault(spark, rows):
    cols = "id string, path string, title string, type string, status string, tags array<string>, aliases array<string>, links array<string>, body string"
    return spark.createDataFrame([(i, p, t, "note", s, [], a, l, "") for i, p, t, s, a, l in rows], cols)


def test_resolution_rules(spark):
    notes = vault(
        spark,
        [
            ("a", "x/a.md", "Same", "active", ["nick"], ["b", "./c.md", "C", "Same", "nick", "gone", "dead", "n_te"]),
            ("b", "x/b.md", "Same", "active", [], ["../y/C.md", "a"]),
            ("c", "x/c.md", "Title C", "active", [], []),
            ("d", "y/C.md", "D", "active", [], []),
            ("dead", "z/dead.md", "Dead", "deleted", [], []),
            ("n", "z/note.md", "N", "active", [], []),
        ],
    )
    got = {(r["src"], r["raw"]): (r["state"], r["rule"], r["candidates"]) for r in resolve.edges(notes).collect()}
    assert got["a", "b"] == ("resolved", 1, ["b"]) and got["a", "./c.md"] == ("resolved", 2, ["c"])
    assert got["a", "C"] == ("ambiguous", 3, ["c", "d"]) and got["a", "Same"] == ("ambiguous", 4, ["a", "b"])
    assert got["a", "nick"] == ("resolved", 5, ["a"]) and got["a", "gone"][0] == "broken" and got["a", "dead"][0] == "broken"
    assert got["b", "../y/C.md"] == ("resolved", 2, ["d"])
    assert got["a", "n_te"] == ("resolved", 3, ["n"])


def test_percent_in_a_target_stands_for_any_run(spark):
    rows = [(f"n{k}", p, "T", "active", [], []) for k, p in enumerate(["a/alpha beta.md", "a/Alphabet.md", "b/gamma.md", "b/x.y+z.md", "c/al.md", "c/d/ga.md", "q.md"])]
    targets = ["%beta", "alpha%", "%mm%", "a%a", "x.y%", "%", "g%", "%z", "al%_t", "%pha b_ta", "nothing%", "_%"]
    notes = vault(spark, [*rows, ("src", "z/src.md", "S", "active", [], targets)])
    import sqlite3 as db

    con = db.connect(":memory:")
    con.execute("CREATE TABLE n (id, path)")
    con.executemany("INSERT INTO n VALUES (?, ?)", [(i, p) for i, p, *_ in rows] + [("src", "z/src.md")])
    got = {r["raw"]: r["candidates"] for r in resolve.edges(notes).collect()}
    for t in targets:
        assert got[t] == sorted(r[0] for r in con.execute("SELECT id FROM n WHERE path LIKE '%/' || ? || '.md'", [t])), t


def test_bfs_cut(spark):
    notes = vault(spark, [("hub", "hub.md", "H", "active", [], ["a", "b", "c", "d"]), *[(x, f"{x}.md", x, "active", [], [{"a": "b", "b": "c"}.get(x, "zz")]) for x in "abcd"]])
    edges = resolve.edges(notes).cache()
    nodes, links = graph.bfs(notes, edges, "hub", depth=2, direction="out", max_nodes=3)
    assert [r["id"] for r in nodes.orderBy("ord").collect()] == ["hub", "a", "b"]
    nodes, links = graph.bfs(notes, edges, "hub", depth=3, direction="out")
    assert {r["id"] for r in nodes.collect()} == {"hub", *"abcd"} and {(r["src"], r["dst"]) for r in links.collect()} >= {("a", "b"), ("b", "c")}


def test_reach_has_no_cap(spark, monkeypatch):
    from vaultspark.plans import queries

    rows = [("doc_1", "r.md", "R", "active", [], ["n0", "doc_1"]), *[(f"n{k}", f"n{k}.md", f"t{k}", "active", [], ["doc_1"] if k % 2 else [f"n{k + 1}"]) for k in range(240)]]
    notes = vault(spark, rows)
    edges = resolve.edges(notes).cache()
    both, out = {"doc_1": 0, "n0": 1}, {"doc_1": 0, "n0": 1, "n1": 2}
    both |= {f"n{k}": 1 if k % 2 else 2 for k in range(1, 240)}
    monkeypatch.setattr(queries, "_edges", lambda s, d: (notes, edges))
    monkeypatch.setattr(graph, "bfs", None)  # the capped search of interactive calls
    for way, want in (("both", both), ("out", out)):
        got = queries._bfs(spark, "", way)
        assert got.dtypes == [("id", "string"), ("depth", "int")] and sorted(map(tuple, got.collect())) == sorted(want.items())


QUERIES = ["alpha", "alpha beta", "alpha OR gamma", "beta NOT alpha gamma", '"lpha be"', "a b needle", "needle AND no", "al*", "what is this?", "title:alpha", "-body:alpha", "{title body}:beta", "NEAR(alpha gamma, 20)", "(alpha OR beta) needle", "^alpha", '"say ""hi"""', "alpha AND (beta"]


@pytest.mark.parametrize("query", QUERIES)
def test_fts_agrees_with_sqlite(spark, query):
    rows = [("1", "p/alpha.md", "alpha one", "alpha beta gamma needle no"), ("2", "p/two.md", "two", "beta only needle, what is this? yes"), ("3", "p/three.md", "Alpha BETA", 'gamma gamma say "hi" alpha'), ("4", "p/four.md", "four", "beta needle alpha tail of a longer text about nothing at all, gamma")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(note_id UNINDEXED, title, path, body, tags, aliases, tokenize='trigram')")
    con.executemany("INSERT INTO f VALUES (?, ?, ?, ?, '', '')", [(i, t, p, b) for i, p, t, b in rows])
    sql = "SELECT note_id, bm25(f, 10.0, 8.0, 1.0, 4.0, 6.0) FROM f WHERE f MATCH ?"
    try:
        want = dict(con.execute(sql, [query]).fetchall())
    except sqlite3.OperationalError:
        want = dict(con.execute(sql, ['"' + query.replace('"', '""') + '"']).fetchall())
    notes = spark.createDataFrame([(i, p, t, "note", "active", [], [], b) for i, p, t, b in rows], "id string, path string, title string, type string, status string, tags array<string>, aliases array<string>, body string")
    indexed = index.texts(notes)
    figures = tuple(indexed.agg(F.count("*"), F.avg("dl")).first())
    got = {r["id"]: r["rank"] for r in search.bm25(indexed, ftsquery.parse(query), figures).collect()}
    assert got.keys() == want.keys()
    if not query.startswith(("^", "NEAR")):
        assert got == pytest.approx(want, abs=1e-9)


def test_snippets_agree_with_sqlite():
    import random

    rng = random.Random(5)
    words = ["needle", "hay", "stack.", "straw", "bale:", "farm", "grass"]
    for _ in range(60):
        body = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
        con = sqlite3.connect(":memory:")
        con.execute("CREATE VIRTUAL TABLE f USING fts5(body, tokenize='trigram')")
        con.execute("INSERT INTO f VALUES (?)", [body])
        got = con.execute("SELECT snippet(f, 0, '[', ']', ' … ', 24) FROM f WHERE f MATCH 'needle OR straw'").fetchone()
        if got:
            assert search.snippet(body, ["needle", "straw"]) == got[0], body


def test_like_path_and_limits():
    assert search.has_short_han_run("检索 engine") and not search.has_short_han_run("知识库") and not search.has_short_han_run("plain")
    assert [search.clamp_limit(x) for x in (None, 0, 7.9, 99, float("nan"))] == [10, 1, 7, 50, 10]
    assert search.normalize_query(" ｏｐｅｎ ") == "open"


def test_slice_body():
    body = "# One\n" + "x" * 30 + "\n## Two\n" + "y" * 30 + "\n## Three\nzzz\n## Four\n"
    outline = [{"line": n + 1, "text": re.sub("#+ ", "", x)} for n, x in enumerate(body.split("\n")) if x.startswith("#")]
    text, cut, omitted = explore.slice_body(body, outline, 80)
    assert cut and text == body[: body.index("## Three")] and omitted == ["Three", "Four"]
    assert explore.slice_body(body, outline, 1000) == (body, False, [])
    fenced, _, _ = explore.slice_body("```\n" + "code\n" * 20, [], 40)
    assert len(fenced) <= 40 and fenced.endswith("```") and fenced.count("```") == 2
    assert explore.is_weak("alpha", []) and not explore.is_weak("Alpha", [{"title": "alphabet", "path": "p", "snippet": ""}])


def test_answer_fits_and_remembers():
    full = {f"n{k}": {"id": f"n{k}", "title": "T" * 300, "path": f"{k}.md", "body": f"# H{k}\n" + "alpha line\n" * 900, "headings": [{"line": 1, "text": f"H{k}"}]} for k in range(5)}
    results = [{"id": f"n{k}", "title": "T" * 300, "path": f"{k}.md", "tags": [], "snippet": "alpha"} for k in range(20)]
    import json

    served = explore.ServedNotes()
    out = explore.answer("alpha", results, lambda ids: {i: full[i] for i in ids}, 5, served)
    assert len(json.dumps(out, indent=2, ensure_ascii=False)) <= explore.MAX_TOTAL - explore.STALE_RESERVE
    assert out["answerNotes"][0]["truncated"] and not out["lowConfidence"]
    small = explore.ServedNotes(2)
    for k in "abc":
        small.put(k, "d", 1)
    assert small.get("a") is None and small.get("c")


def test_debounce():
    assert [changes.window_ms(n) for n in (1, 2, 3, 100)] == [300, 300, 2000, 2000]
    assert [changes.is_scoped(n, False) for n in (0, 1, 500, 501)] == [False, True, True, False] and not changes.is_scoped(3, True)
    got = changes.debounce([(0, "a", False), (200, "b", False), (1000, "c", False), (1100, "", True), (1150, "d", False), (1200, "e", False)])
    assert got == [(500, ["a", "b"], False), (3200, ["c", "d", "e"], True)]


def test_flushes_agree_with_debounce(spark):
    import random

    rng = random.Random(3)
    rows = [(k, rng.randrange(20_000), rng.choice("abcdef"), rng.random() < 0.1) for k in range(5) for _ in range(60)] + [(None, 5, "x", False)]
    got = {}
    for r in changes.flushes(spark.createDataFrame(rows, "vault int, at long, path string, folder boolean"), "vault", "at", "path", "folder").collect():
        got.setdefault(r["vault"], []).append((r["due_ms"], r["paths"], r["full"]))
    for k in (*range(5), None):
        assert sorted(got[k]) == changes.debounce(sorted((at, p, d) for v, at, p, d in rows if v == k))


def test_first_mentions_are_those_of_all_pairs(spark):
    """An ambiguous target's sources are listed once; the notes it may mean leave out themselves and sources with an earlier sure link."""
    import random

    rng, rows = random.Random(4), []
    means = {f"t{k}": sorted(rng.sample(range(30), 20)) for k in range(4)}
    for src in range(30):
        for t, ids in means.items():
            if rng.random() < 0.7:
                rows.append((f"n{src}", f"p{src:02}", f"m{t}", t, "ambiguous", None, [f"n{i}" for i in ids]))
        for dst in rng.sample(range(30), 9):
            rows.append((f"n{src}", f"p{src:02}", f"{rng.choice('az')}{dst}", f"n{dst}", "resolved", f"n{dst}", [f"n{dst}"]))
    edges = spark.createDataFrame(rows, "src string, src_path string, raw string, target string, state string, dst string, candidates array<string>")
    notes = spark.createDataFrame([(f"n{i}",) for i in range(30)], "id string")
    hits = spark.createDataFrame([(t, f"n{i}") for t, ids in means.items() for i in ids], "target string, id string")
    want = {}
    for r in graph.ambiguous_mentions(edges).collect():
        want.setdefault(r["dst"], []).append((1, r["src_path"], r["raw"], r["src"]))
    for src, _, raw, _, state, _, _ in rows:
        if state == "ambiguous":
            want.setdefault(src, []).append((0, "", raw, src))
    for got in (graph.context(notes, edges.drop("candidates"), 7, hits), graph.context(notes, edges, 7)):
        found = {}
        for r in got.where("kind = 'ambiguous'").orderBy("id", "ord").collect():
            found.setdefault(r["id"], []).append((r["raw"], r["other"]))
        assert found == {i: [(raw, src) for _, _, raw, src in sorted(x)[:7]] for i, x in want.items()}

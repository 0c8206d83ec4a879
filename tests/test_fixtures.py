"""Small vaults with known outcomes: ids that change, updates, ignore rules that come later, relative links, limits, exploration, freshness, scoped syncs."""

import json
import os

from tests.test_vault import write
from vaultspark.operators import explore
from vaultspark.session import Vault
from vaultspark.sources import ignore


def test_id_change_update_and_late_ignore_rule(spark, tmp_path):
    write(tmp_path, {"test.md": "---\nid: alpha\ntags: [tag-a, tag-b]\naliases: [nick]\n---\n[[other-note]]\n", "up.md": "---\nid: up\ntitle: Old\n---\nOld body with [[source]].\n"})
    v = Vault(spark, str(tmp_path))
    assert v.sync() == {"indexed": 2, "removed": 0, "errors": []}
    write(tmp_path, {"test.md": "---\nid: beta\ntags: [tag-c]\n---\nnew\n"})
    v.sync()
    assert v.get_note("alpha") is None and v.get_note("beta")["tags"] == ["tag-c"] and v.get_note("beta")["links"] == []
    assert {t["tag"] for t in v.status()["topTags"]} == {"tag-c"}
    v.update_note("up", title="New", content="Replacement body with [[target]].\n", status="archived", tags=["new"])
    assert v.get_note("up")["body"] == "Replacement body with [[target]].\n" and v.get_note("up")["title"] == "New"
    assert [r["id"] for r in v.search("replacement", status="archived", tag="new")] == ["up"] and v.search("Old body") == []
    # scoped syncs: outside, ignored, the store itself; then a file that is gone
    write(tmp_path, {"private/x.md": "secret", ignore.IGNORE_FILE: "private/**\n"})
    assert v.sync_paths(["../outside.md", "private/x.md", f"{ignore.STORE_DIR}/y.md"]) == {"indexed": 0, "removed": 0, "errors": []}
    assert v.search("secret") == []
    os.remove(tmp_path / "test.md")
    assert v.sync_paths(["test.md"])["removed"] == 1 and v.get_note("beta")["status"] == "deleted" and v.status()["total"] == 1
    write(tmp_path, {ignore.IGNORE_FILE: "private/**\nup.md\n"})
    out = v.sync()
    assert (out["removed"], out["indexed"]) == (1, 0) and v.get_note("up")["status"] == "deleted"


def test_relative_links_and_limits(spark, tmp_path):
    write(
        tmp_path,
        {
            "a.md": "[x](./b.md)", "b.md": "b", "sub/a.md": "---\nid: suba\n---\n[y](b.md) [z](../b.md)", "sub/b.md": "---\nid: subb\n---\n",
            "x/y/deep.md": "[[../../other]] [o](../../other.md)", "other.md": "o",
            "hub.md": " ".join(f"[[leaf{k:02d}]]" for k in range(30)), **{f"leaf{k:02d}.md": "[[hub]]" if k < 2 else "leaf" for k in range(30)},
        },
    )
    v = Vault(spark, str(tmp_path))
    v.sync()
    edges = {(r["src"], r["raw"]): (r["state"], r["dst"]) for r in v.edges().collect()}
    assert edges["a", "./b.md"] == ("resolved", "b") and edges["suba", "b.md"] == ("resolved", "subb") and edges["suba", "../b.md"] == ("resolved", "b")
    assert edges["x_y_deep", "../../other"] == edges["x_y_deep", "../../other.md"] == ("resolved", "other")
    graph = v.get_note("hub")["graph"]
    assert len(graph["outlinks"]) == 20 and graph["total_out"] == 30 and len(graph["backlinks"]) == 2
    assert len(v.get_note("hub", 3)["graph"]["outlinks"]) == 3
    hit = next(r for r in v.search("leaf05", limit=50) if r["id"] == "hub")
    assert hit["graph"]["outlinks"] == 30 and len(hit["graph"]["out_preview"]) == 3


def test_exploration_of_a_vault(spark, tmp_path):
    lines = lambda k, n: "".join(f"alpha line {i} of note {k}, and more of it\n" for i in range(n))
    write(tmp_path, {**{f"n{k}.md": f"---\ntitle: Note {k}\n---\n{lines(k, 10)}" for k in range(6)}, "tiny.md": "---\ntitle: zeta\n---\nzeta\n"})
    v = Vault(spark, str(tmp_path))
    v.sync()
    first = v.explore("alpha")
    answers, pointers = {a["id"] for a in first["answerNotes"]}, {p["id"] for p in first["relatedPointers"]}
    assert len(answers) == len(pointers) == 3 and not answers & pointers and not any(a["truncated"] for a in first["answerNotes"])
    again = v.explore("alpha")
    assert all(a["deduped"] for a in again["answerNotes"])
    edited = first["answerNotes"][0]["path"]
    write(tmp_path, {edited: (tmp_path / edited).read_text() + "alpha once more\n"})
    fresh = {a["id"]: a["deduped"] for a in v.explore("alpha")["answerNotes"]}
    assert fresh[first["answerNotes"][0]["id"]] is False
    # a note of few lines is always given again
    assert [v.explore("zeta")["answerNotes"][0]["deduped"] for _ in range(2)] == [False, False]
    write(tmp_path, {f"n{k}.md": f"---\ntitle: {'T' * 400}\n---\n# H\n{lines(k, 220)}" for k in range(6)})
    v.sync()
    large = v.explore("alpha", 5)
    assert len(json.dumps(large, indent=2, ensure_ascii=False)) <= explore.MAX_TOTAL and large["answerNotes"][0]["truncated"] and len(large["answerNotes"][0]["body"]) >= explore.MIN_ANSWER


def test_freshness_of_a_note(spark, tmp_path):
    write(tmp_path, {"a.md": "first text\n"})
    v = Vault(spark, str(tmp_path))
    v.sync()
    assert v.ensure_fresh("a") == {"fresh": True, "reindexed": False, "stale": False}
    os.utime(tmp_path / "a.md", (5, 5))  # touched, with the same text
    assert v.ensure_fresh("a") == {"fresh": True, "reindexed": False, "stale": False}
    write(tmp_path, {"a.md": "other text\n"})  # of the same size
    os.utime(tmp_path / "a.md", (9, 9))
    assert v.ensure_fresh("a") == {"fresh": False, "reindexed": True, "stale": False} and "other" in v.get_note("a")["body"]
    os.remove(tmp_path / "a.md")
    (tmp_path / "a.md").mkdir()
    assert v.ensure_fresh("a")["stale"] and v.get_note_fresh("a")["stale"]

"""Vaults of files: what sync indexes, what search and links find, what writing leaves on disk."""

import os

import pytest

from vaultspark.session import Vault
from vaultspark.sources import ignore, scan


def write(root, files):
    for path, text in files.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text, encoding="utf-8")


def test_sync_search_links_and_tombstones(spark, tmp_path):
    write(
        tmp_path,
        {
            "alpha.md": "---\nid: alpha\ntitle: Alpha Note\ntags: [One, two]\naliases: nickname, other\n---\n# Alpha\n[[beta]] [[nickname]] #inline\n",
            "sub/beta.md": "---\nid: beta\n---\nneedle in the hay [a](../alpha.md) [[missing]]\n",
            "bad.md": "---\ninvalid yaml: [unclosed\n---\nx\n",
            "_template.md": "t",
            ".hidden.md": "hidden needle",
            "dup1.md": "---\nid: dup\n---\nfirst\n",
            "dup2.md": "---\nid: dup\n---\nsecond\n",
            "drafts/wip.md": "wip",
            ignore.IGNORE_FILE: "# comment\ndrafts/**\n",
        },
    )
    v = Vault(spark, str(tmp_path))
    out = v.sync()
    assert out["removed"] == 0 and out["indexed"] == 4
    assert [e["path"] for e in out["errors"]] == ["bad.md", "dup2.md"]
    assert 'Duplicate note id "dup"' in out["errors"][1]["error"]
    assert [r["id"] for r in v.search("needle")] and {r["id"] for r in v.search("needle")} == {"beta", "hidden"}
    note = v.get_note("alpha")
    assert note["title"] == "Alpha Note" and note["tags"] == ["One", "inline", "two"]
    assert [b["id"] for b in note["graph"]["backlinks"]] == ["beta"]
    assert {o["target"] for o in note["graph"]["outlinks"]} == {"beta", "nickname"}
    assert [b["target"] for b in v.get_note("beta")["graph"]["brokenLinks"]] == ["missing"]
    graph = v.get_graph("beta", depth=2)
    assert {n["id"] for n in graph["nodes"]} == {"alpha", "beta"} and v.get_graph("nobody") is None
    # an unchanged sync indexes nothing anew; a file that goes leaves a tombstone
    version = v.store.version()
    assert v.sync()["indexed"] == 4 and v.sync()["errors"]
    os.remove(tmp_path / "sub/beta.md")
    assert v.sync()["removed"] == 1 and v.store.version() != version
    assert v.get_note("beta")["status"] == "deleted"
    assert v.status()["deleted"] == 1 and {r["id"] for r in v.search("needle")} == {"hidden"}
    assert v.search("hidden needle", tag="none") == []


def test_create_update_freshness_and_explore(spark, tmp_path):
    v = Vault(spark, str(tmp_path))
    made = v.create_note("notes/20240102_030405_Search Plan/x", "Title", "body line about search #MyTag\n" * 12)
    assert made["id"] == "notes_20240102_030405_search_plan_x" and made["path"].endswith("x.md")
    assert made["tags"] == ["mytag", "search plan"]
    with pytest.raises(FileExistsError):
        v.create_note(made["path"], "again")
    v.update_note(made["id"], status="archived", tags=["#New", "new", ""])
    assert [r["id"] for r in v.search("search", status="archived", tag="new")] == [made["id"]]
    assert v.ensure_fresh(made["id"])["fresh"] and v.ensure_fresh("nobody")["fresh"]
    full = tmp_path / made["path"]
    full.write_text(full.read_text().replace("about", "again"), encoding="utf-8")
    os.utime(full, (1, 1))
    assert v.ensure_fresh(made["id"]) == {"fresh": False, "reindexed": True, "stale": False}
    first, second = v.explore("search"), v.explore("search")
    assert not first["answerNotes"][0]["deduped"] and second["answerNotes"][0]["deduped"]
    with pytest.raises(ValueError, match="escapes"):
        v.create_note("../out", "no")
    with pytest.raises(KeyError):
        v.update_note("nobody")


def test_ignore_patterns():
    import re

    rx = re.compile(ignore.regex([*ignore.BUILTIN, "drafts/**", "*.tmp.md", "{a,b}/x.md"]))
    for path in (".git/x.md", "a/node_modules/b/c.md", "_template.md", "deep/_template.md", "drafts/a/b.md", "n.tmp.md", "a/x.md", "b/x.md"):
        assert rx.match(path), path
    for path in ("x.md", "deep/n.tmp.md", "c/x.md", "distant/x.md"):
        assert not rx.match(path), path
    assert scan.is_markdown("A.MDX") and not scan.is_markdown("a.txt")

"""The change source and the command line."""

import os
import time

from vaultspark import cli
from vaultspark.session import Vault
from vaultspark.streaming import watch


def until(holds, seconds=60):
    end = time.time() + seconds
    while not holds():
        assert time.time() < end
        time.sleep(0.2)


def test_changes_wait_until_it_is_quiet(tmp_path, monkeypatch):
    (tmp_path / "v").mkdir()
    at = [time.time() * 1000 + 60_000]
    monkeypatch.setattr(watch.time, "time", lambda: at[0] / 1000)
    reader = watch._Reader(str(tmp_path / "v"), str(tmp_path / "l"), 0, 300, 2000)
    start = reader.initialOffset()

    def look(ms, *new):
        at[0] += ms
        for n in new:
            (tmp_path / "v" / n).write_text("x")
        rows, end = reader.read(start)
        return [p for p, _, _ in rows], end

    assert look(0, "a.md") == ([], start) and look(200, "b.md") == ([], start)  # the second arms the timer anew
    assert look(200) == ([], start) and look(50, "c.md") == ([], start)  # the third makes it longer
    assert look(1900) == ([], start)
    found, end = look(200)
    assert found == ["a.md", "b.md", "c.md"] and end == {"n": 1}
    assert [p for p, _, _ in reader.readBetweenOffsets(start, end)] == found
    (tmp_path / "v/d").mkdir()
    reader.read(end)
    at[0] += 301
    rows, last = reader.read(end)
    assert [(p, k) for p, k, _ in rows] == [("d", "addDir")]
    reader.commit(last)
    assert [f.name for f in (tmp_path / "l").glob("*.json")] == ["000000000002.json"]


def test_difference_and_follow(spark, tmp_path):
    assert watch.difference({"a": [1, 1], "b": [1, 1]}, {"b": [1, 2], "c": [1, 1]}, 7) == [("a", "unlink", 7), ("b", "change", 7), ("c", "add", 7)]
    assert watch.difference({"d": None}, {"e": None, "e/f": [1, 1]}, 7) == [("d", "unlinkDir", 7), ("e", "addDir", 7), ("e/f", "add", 7)]
    root = tmp_path / "vault"
    root.mkdir()
    (root / "a.md").write_text("first\n")
    vault = Vault(spark, str(root))
    query = watch.watch(spark, vault, str(tmp_path / "state"), settle_ms=0)
    try:
        query.processAllAvailable()
        (root / "b.md").write_text("second needle\n")
        os.remove(root / "a.md")
        until(lambda: (vault.get_note("a") or {}).get("status") == "deleted" and vault.get_note("b"))
        assert [r["id"] for r in vault.search("needle")] == ["b"]
        (root / "sub").mkdir()
        (root / "sub/c.md").write_text("third\n")
        until(lambda: vault.get_note("sub_c"))
        assert len(list((tmp_path / "state/listings").glob("*.json"))) <= 2 and "b.md" not in str(query.lastProgress["sources"][0]["endOffset"])
    finally:
        query.stop()
    args = cli.parser().parse_args(["search", "needle", "-l", "3", "--status", "active"])
    assert [r["id"] for r in cli.run(args, vault)] == ["b"]

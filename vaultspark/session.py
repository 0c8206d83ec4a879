"""A vault and its index: sync, search, graph, exploration, and the writing of notes."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
import threading
import uuid
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import frontmatter
from .operators import explore as exploring
from .operators import graph, search, sync, tags
from .operators.parse import parse_notes
from .sources import ignore, scan
from .sources.index import Index
from .sources.shared import written
from .sources.store import FILES, NOTES, Store

INSTRUCTIONS = (
    "A graph of Markdown notes. Explore open questions first; read single notes by id; search with metadata filters; follow links with the graph. "
    "The files are the truth and the index follows them."
)
STALE_WARNING = "Some notes could not be read again from disk; what is shown may be out of date."


class Vault:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, scan.resolve_root(root)
        self.store = Store(spark, self.root)
        self.served = exploring.ServedNotes()
        self.last_sync: dict | None = None
        self._lock, self._running = threading.Lock(), None

    # --- sync ---

    def sync(self) -> dict:
        """All files against the index. Callers that come while one runs get its result."""
        with self._lock:
            mine = self._running is None
            if mine:
                self._running = _Running()
            running = self._running
        if not mine:
            return running.wait()
        try:
            result = self.store.retry(lambda: self._sync(None))
            self.last_sync = {"at": dt.datetime.now(dt.UTC).isoformat(), "result": result}
            running.finish(result, None)
            return result
        except Exception as e:
            self.last_sync = {"at": dt.datetime.now(dt.UTC).isoformat(), "error": str(e)}
            running.finish(None, e)
            raise
        finally:
            with self._lock:
                self._running = None

    def sync_paths(self, paths: list[str]) -> dict:
        """Only the given files: those outside the vault and ignored ones don't count; those that are gone or aren't notes are removed."""
        return self.store.retry(lambda: self._sync(paths))

    def _sync(self, only: list[str] | None) -> dict:
        base = self.store.version()
        notes, files = self.store.notes(), self.store.files()
        if only is None:
            listed = scan.listing(self.root)
            mine = files
        else:
            ignored, listed, names = ignore.checker(self.root), [], []
            for p in dict.fromkeys(only):
                full = Path(os.path.normpath(self.root / p))
                if not full.is_relative_to(self.root) or full == self.root or ignored(scan.relative(self.root, full)):
                    continue
                names.append(scan.relative(self.root, full))
                if full.is_file() and scan.is_markdown(names[-1]):
                    listed.append(scan.stat(self.root, names[-1]))
            mine = files.join(self.spark.createDataFrame([(n,) for n in names], "path string"), "path", "left_semi")
        found = sync.diff(self.spark.createDataFrame(listed, scan.LISTING), mine).where("action <> 'unchanged'")
        actions = {r["path"]: r["action"] for r in found.collect()}  # what this sync has to do
        removed = sorted(p for p, a in actions.items() if a == "removed")
        changed = sorted(p for p, a in actions.items() if a in ("added", "changed"))
        n_removed = len(removed) if only is None else len(set(names) - {p for p, _, _ in listed})
        parsed = parse_notes(scan.read_files(self.spark, self.root, changed)) if changed else None
        errors: list[dict] = []
        if parsed is not None:
            old = mine.where("not deleted").select("path", F.col("hash").alias("known"))
            new = F.col("known").isNull() | (F.col("known") != F.col("hash"))
            # written, as later steps must see the same texts, not the files again
            fresh = written(parsed.join(old, "path", "left").where(new).drop("known"))
            errors += [{"path": r["path"], "error": r["error"]} for r in fresh.where("error is not null").select("path", "error").collect()]
            good = fresh.where("error is null")
            gone = self.spark.createDataFrame([(p,) for p in removed], "path string")
            live = notes.where("status <> 'deleted'").select("id", "path").join(gone, "path", "left_anti")
            accepted, refused = sync.guard_ids(good, live)
            errors += [r.asDict() for r in refused.collect()]
        else:
            accepted = None
        if not removed and accepted is None:
            return {"indexed": len(listed) - len(errors), "removed": n_removed, "errors": errors}
        gone = self.spark.createDataFrame([(p,) for p in removed], "path string")
        new_notes = sync.apply(notes, accepted, gone) if accepted is not None else sync.apply(notes, notes.limit(0), gone)
        stamped = files.join(gone, "path", "left_semi").withColumn("deleted", F.lit(True))
        kept = files.join(gone, "path", "left_anti")
        if accepted is not None:
            now = accepted.select("path", "hash", "size", "mtime_ms", F.lit(False).alias("deleted"), F.current_timestamp().alias("indexed_at"))
            kept = kept.join(accepted.select("path"), "path", "left_anti").unionByName(now)
        self.store.write(base, new_notes.select(*_columns(NOTES)), stamped.unionByName(kept).select(*_columns(FILES)))
        return {"indexed": len(listed) - len(errors), "removed": n_removed, "errors": sorted(errors, key=lambda e: e["path"])}

    def ensure_fresh(self, note_id: str) -> dict:
        """Reads a note's file again if it has changed. Ids that the index doesn't know count as fresh."""
        row = self.store.notes().where(F.col("id") == note_id).select("path").join(self.store.files().where("not deleted"), "path").first()
        if row is None:
            return {"fresh": True, "reindexed": False, "stale": False}
        try:
            _, size, mtime = scan.stat(self.root, row["path"])
            if (size, mtime) == (row["size"], row["mtime_ms"]):
                return {"fresh": True, "reindexed": False, "stale": False}
            raw = (self.root / row["path"]).read_bytes().decode("utf-8", "replace")
            if hashlib.sha256(raw.encode()).hexdigest() == row["hash"]:
                return {"fresh": True, "reindexed": False, "stale": False}
            bad = self.sync_paths([row["path"]])["errors"]
        except OSError:
            bad = True
        return {"fresh": False, "reindexed": not bad, "stale": bool(bad)}

    # --- reading ---

    def notes(self) -> DataFrame:
        return self.store.notes()

    def index(self) -> Index:
        """What is stored beside the snapshot that is read now; a vault never synced has one of its own."""
        at = self.store.version() or "empty"
        return Index(self.spark, f"file://{self.store.dir}/{at}/index", self.store.notes)

    def edges(self) -> DataFrame:
        return self.index().edges()

    def status(self) -> dict:
        notes = self.store.notes()
        counts = tags.status_counts(notes).first()
        return {
            "total": counts["total"],
            "deleted": counts["deleted"],
            "topTags": [r.asDict() for r in tags.top_tags(notes).collect()],
            "types": [r.asDict() for r in tags.type_histogram(notes).collect()],
        }

    def search(self, query: str, limit: float | None = 10, status: str | None = None, type: str | None = None, tag: str | None = None) -> list[dict]:  # noqa: A002
        notes = self.store.notes()
        hits = search.search(self.index(), query, limit, status=status, type=type, tag=tag)
        rows = [r.asDict(recursive=True) for r in hits.select("id", "title", "path", "type", "status", F.array_sort("tags").alias("tags"), "snippet", "rank", F.col("headings").alias("outline")).collect()]
        ids = [r["id"] for r in rows]
        graphs = {r["id"]: r.asDict(recursive=True) for r in graph.summaries(notes, self.edges()).where(F.col("id").isin(ids)).collect()} if ids else {}
        for r in rows:
            r["graph"] = {k: v for k, v in graphs.get(r["id"], {}).items() if k != "id"}
        return rows

    def get_note(self, note_id: str, graph_limit: int = 20) -> dict | None:
        """All of a note, deleted ones too, with its links to a distance of one."""
        notes = self.store.notes()
        row = notes.where(F.col("id") == note_id).first()
        if row is None:
            return None
        out = row.asDict(recursive=True)
        out["frontmatter"] = json.loads(out["frontmatter"] or "{}")
        out["outline"] = out.pop("headings")
        out["tags"], out["links"] = sorted(out["tags"], key=str.encode), sorted(out["links"], key=str.encode)
        # its own edges, and those of others that mean it or may
        edges = self.edges().where((F.col("src") == note_id) | (F.col("dst") == note_id) | F.array_contains("candidates", note_id))
        mine = notes.where(F.col("id") == note_id)
        titles = notes.select(F.col("id").alias("other"), "title", F.col("path").alias("other_path"))
        parts = graph.context(mine, edges, graph_limit).join(titles, "other", "left").orderBy("kind", "ord").collect()
        totals = graph.totals(mine, edges).first().asDict()
        kinds = {"out": "outlinks", "back": "backlinks", "broken": "brokenLinks", "ambiguous": "ambiguousLinks"}
        out["graph"] = {name: [{"id": r["other"], "title": r["title"], "path": r["other_path"], "target": r["raw"]} for r in parts if r["kind"] == k] for k, name in kinds.items()} | {k: v for k, v in totals.items() if k != "id"}
        return out

    def get_note_fresh(self, note_id: str, graph_limit: int = 20) -> dict:
        state = self.ensure_fresh(note_id)
        out = self.get_note(note_id, graph_limit) or {"error": f"Note not found: {note_id}"}
        return out | {"stale": True, "warning": STALE_WARNING} if state["stale"] else out

    def get_graph(self, note_id: str, depth: int = 1, direction: str = "both", max_nodes: int = 100) -> dict | None:
        notes = self.store.notes()
        found = graph.bfs(notes, self.edges(), note_id, depth, direction, max_nodes)
        if found is None:
            return None
        nodes, links = found
        named = nodes.join(notes.select("id", "title", "path"), "id").orderBy("ord")
        return {"nodes": [r.asDict() for r in named.collect()], "edges": [r.asDict() for r in links.collect()]}

    def explore(self, query: str, max_notes: int | None = None) -> dict:
        """The answer to an open question. If a note in it has changed on disk, it is made once more."""
        out = exploring.explore(self.store.notes(), self.index(), query, max_notes, self.served)
        state = {a["id"]: self.ensure_fresh(a["id"]) for a in out["answerNotes"]}
        if any(s["reindexed"] for s in state.values()):
            for a in out["answerNotes"]:
                if not a["deduped"]:
                    self.served.drop(a["id"])
            out = exploring.explore(self.store.notes(), self.index(), query, max_notes, self.served)
            state = {a["id"]: self.ensure_fresh(a["id"]) for a in out["answerNotes"]}
        for a in out["answerNotes"]:
            if state[a["id"]]["stale"]:
                a["stale"], out["warning"] = True, STALE_WARNING
        return out

    def suggest_tags(self, path: str, title: str, content: str = "") -> list[str]:
        docs = self.spark.createDataFrame([(0, path, title, content)], "key long, path string, title string, content string")
        return list(tags.derive_tags(docs, self.store.notes()).first()["tags"])

    # --- writing ---

    def create_note(self, path: str, title: str, content: str = "", type: str = "note", status: str = "active", tags: list[str] | None = None) -> dict:  # noqa: A002
        full = scan.inside(self.root, path if path.endswith(".md") else f"{path}.md")
        rel, today = scan.relative(self.root, full), dt.datetime.now(dt.UTC).date().isoformat()
        note_id = re.sub(r"^_+|_+$", "", re.sub(r"[^a-zA-Z0-9_-]+", "_", re.sub(r"(?i)\.md$", "", path))).lower()
        given = _normalized(tags or [])
        derived = [] if given else self.suggest_tags(rel, title, content)
        full.parent.mkdir(parents=True, exist_ok=True)
        with open(full, "x", encoding="utf-8") as f:
            f.write(_with_frontmatter(content, {"id": note_id, "title": title, "type": type, "status": status, "tags": given or derived, "created": today, "updated": today}))
        self._index(rel)
        return {"success": True, "id": note_id, "path": rel, "tags": given or derived, "derived_tags": derived}

    def update_note(self, note_id: str, title: str | None = None, content: str | None = None, type: str | None = None, status: str | None = None, tags: list[str] | None = None, aliases: list[str] | None = None) -> dict:  # noqa: A002
        row = self.store.notes().where(F.col("id") == note_id).select("path").first()
        if row is None:
            raise KeyError(f"Note not found: {note_id}")
        full = scan.inside(self.root, row["path"])
        try:
            raw = full.read_text("utf-8")
        except FileNotFoundError as e:
            raise FileNotFoundError(f"Note file not found on disk: {row['path']}") from e
        head, body = split_frontmatter(raw)
        data = yaml.load(head, frontmatter._Loader) if head and head.strip() else {}  # noqa: S506
        data = (data if isinstance(data, dict) else {}) | {"id": note_id, "updated": dt.datetime.now(dt.UTC).date().isoformat()}
        given = {"title": title, "type": type, "status": status, "tags": None if tags is None else _normalized(tags), "aliases": aliases}
        write_atomic(full, _with_frontmatter(body if content is None else content, data | {k: v for k, v in given.items() if v is not None}))
        self._index(row["path"])
        return {"success": True, "id": note_id, "path": row["path"]}

    def _index(self, path: str) -> None:
        errors = self.sync_paths([path])["errors"]
        if errors:
            raise ValueError(errors[0]["error"])


class _Running:
    def __init__(self):
        self.done, self.result, self.error = threading.Event(), None, None

    def finish(self, result, error) -> None:
        self.result, self.error = result, error
        self.done.set()

    def wait(self):
        self.done.wait()
        if self.error:
            raise self.error
        return self.result


def _columns(schema: str) -> list[str]:
    return [f.name for f in SparkSession.getActiveSession().createDataFrame([], schema).schema]


def _normalized(given: list[str]) -> list[str]:
    return list(dict.fromkeys(t for t in (g.strip().lstrip("#").lower() for g in given) if t))


def split_frontmatter(raw: str) -> tuple[str | None, str]:
    """As the column expressions split it."""
    raw = raw.removeprefix(chr(0xFEFF))
    if not raw.startswith("---") or raw[3:4] in ("", "-"):
        return None, raw
    head, close, rest = raw[3:].partition("\n---")
    return head, re.sub(r"^\r?\n?", "", rest) if close else ""


def _with_frontmatter(body: str, data: dict) -> str:
    head = yaml.safe_dump(data, sort_keys=False, allow_unicode=True, default_flow_style=False, width=1_000_000)
    return f"---\n{head}---\n{body}" + ("" if body.endswith("\n") else "\n")


def write_atomic(path: Path, text: str) -> None:
    fresh = path.with_name(f".{path.name}.{os.getpid()}.{uuid.uuid4().hex}.tmp")
    try:
        with open(fresh, "x", encoding="utf-8") as f:
            f.write(text)
        os.replace(fresh, path)
    finally:
        fresh.unlink(missing_ok=True)


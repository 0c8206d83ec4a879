"""Vault scan. The listing is the driver's, as Spark's own hides names that start with "." or "_"; contents are read on the executors, and only those that changed."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ignore

EXTENSIONS = (".md", ".mdx")
LISTING = "path string, size long, mtime_ms long"


def is_markdown(path: str) -> bool:
    return os.path.splitext(path)[1].lower() in EXTENSIONS


def resolve_root(root: str | None = None) -> Path:
    return Path(root or os.getcwd()).resolve()


def inside(root: Path, path: str | Path) -> Path:
    """The absolute path, if it lies in the vault."""
    full = Path(os.path.normpath(Path(root) / path))
    if not full.is_relative_to(root) or full == root:
        raise ValueError(f"Path escapes vault root: {path}")
    return full


def relative(root: Path, path: str | Path) -> str:
    return Path(path).relative_to(root).as_posix()


def stat(root: Path, path: str) -> tuple[str, int, int]:
    s = os.stat(Path(root) / path)
    return path, s.st_size, s.st_mtime_ns // 1_000_000


def listing(root: Path) -> list[tuple[str, int, int]]:
    """(path, size, time) of each note that isn't ignored; an ignored folder isn't entered."""
    ignored, out = ignore.checker(root), []
    for folder, folders, names in os.walk(root):
        at = relative(root, folder) if Path(folder) != Path(root) else ""
        folders[:] = sorted(f for f in folders if not ignored(f"{at}/{f}".lstrip("/")))
        for n in sorted(names):
            path = f"{at}/{n}".lstrip("/")
            if n.endswith(EXTENSIONS) and not ignored(path):
                out.append(stat(root, path))
    return out


def folders(root: Path) -> list[str]:
    """Each folder that isn't ignored, without the root."""
    ignored, out = ignore.checker(root), []
    for folder, inner, _ in os.walk(root):
        at = relative(root, folder) if Path(folder) != Path(root) else ""
        inner[:] = sorted(f for f in inner if not ignored(f"{at}/{f}".lstrip("/")))
        out += [f"{at}/{f}".lstrip("/") for f in inner]
    return out


def list_vault(spark: SparkSession, root: Path) -> DataFrame:
    return spark.createDataFrame(listing(root), LISTING)


def read_files(spark: SparkSession, root: Path, paths: list[str]) -> DataFrame:
    """(path, raw, size, mtime_ms) of the given notes; bytes that aren't UTF-8 become U+FFFD. A path that Spark's listing hides is read by the driver."""
    seen = [p for p in paths if not any(part[0] in "._" for part in p.split("/"))]
    hidden = [p for p in paths if p not in set(seen)]
    schema = "path string, raw string, size long, mtime_ms long"
    out = spark.createDataFrame([(p, (Path(root) / p).read_bytes().decode("utf-8", "replace"), *stat(root, p)[1:]) for p in hidden], schema)
    if not seen:
        return out
    known = spark.createDataFrame([stat(root, p) for p in seen], LISTING)
    files = spark.read.format("binaryFile").load([f"file://{root}/{p}".replace("%", "%25").replace("[", "\\[").replace("{", "\\{").replace("*", "\\*").replace("?", "\\?") for p in seen])
    path = F.expr(f"substr(url_decode(replace(regexp_replace(path, '^file:/+', '/'), '+', '%2B')), {len(str(root)) + 2})")
    texts = files.select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))
    return out.union(texts.join(known, "path").select("path", "raw", "size", "mtime_ms"))

"""Ignore rules: globs over vault-relative paths, as one regular expression."""

from __future__ import annotations

import glob
import re
from pathlib import Path

STORE_DIR = ".vaultspark"
IGNORE_FILE = ".vaultsparkignore"
# What is never indexed.
BUILTIN = ("**/.git", "**/.git/**", f"**/{STORE_DIR}", f"**/{STORE_DIR}/**", "**/node_modules", "**/node_modules/**", "**/dist", "**/dist/**", "**/_template.md")


def custom_patterns(root: str | Path) -> list[str]:
    """A pattern a line; blank lines and those that start with # don't count. A missing file has none."""
    try:
        lines = (Path(root) / IGNORE_FILE).read_text("utf-8").splitlines()
    except OSError:
        return []
    return [s for s in map(str.strip, lines) if s and not s.startswith("#")]


def _alternatives(pattern: str) -> list[str]:
    """{a,b} written out, innermost braces first."""
    m = re.search(r"\{([^{}]*,[^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [p for part in m[1].split(",") for p in _alternatives(pattern[: m.start()] + part + pattern[m.end() :])]


def regex(patterns: list[str] | tuple[str, ...]) -> str | None:
    """For Python and for rlike alike; None for no patterns."""
    each = [re.sub(r"\(\?s:(.*)\)\\[zZ]$", r"(?s:\1)", glob.translate(p, recursive=True, include_hidden=True, seps="/")) for q in patterns for p in _alternatives(q)]
    return "^(?:" + "|".join(each) + ")$" if each else None


def checker(root: str | Path):
    rx = re.compile(regex([*BUILTIN, *custom_patterns(root)]))
    return lambda path: bool(rx.match(path.replace("\\", "/")))

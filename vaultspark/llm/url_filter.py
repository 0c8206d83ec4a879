"""URL filter: all glob rules at once, by a bit-parallel Shift-And automaton over multiword masks.

A rule is a glob over the canonical form of a url: "." + host + path, with the host's A-Z in lower case. In it "*" stands for any
run of characters without "/", "**" for any run, "?" for one character other than "/", everything else for itself. A rule must
fit the whole form. Each character of each rule is one bit; the masks of all rules lie side by side in 64-bit words, and one pass over
a url's characters moves the states of all rules together, for a whole batch of urls at a time.

Defined results: a null url, and one without "://", has an empty host and an empty path; no rule fits an empty form, so the verdict is
the default. Repeated rows are judged alike, each on its own. An empty table gives an empty result. Columns other than the
two named are not read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns


@dataclass(frozen=True)
class SiteRule:
    """Fits a host and all its subdomains, where the path starts with `path`; the longest `host + path` that fits wins."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


#: The four rules that the query judges by.
SITE_RULES = (SiteRule("net", "/", "block"), SiteRule("example.net", "/en/", "allow"), SiteRule("example.com", "/de/", "block"), SiteRule("org", "/fr/", "allow"))
#: Where no site rule fits: globs that block, over the same canonical form.
BLOCK_GLOBS = ("**/wp-admin/**", "**/cgi-bin/**", "**.exe", "**.zip", "**/login**", "**/cart/**", "*.ads.**", "*.tracker.**")

_WORD = 64


def canonical(url: str | None) -> tuple[str, str]:
    """Host and path of a url, as the contract words them."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    cut = re.search(r"[/?#]", rest)
    host = rest[: cut.start()] if cut else rest
    rest = rest[len(host) :]
    end = re.search(r"[?#]", rest)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[: end.start()] if end else rest


def _steps(glob: str) -> list[tuple[str, str]]:
    """(what the state consumes, what it may loop over): loops are "", "/" (anything but it) or "all"."""
    out: list[tuple[str, str]] = [("start", "")]
    i = 0
    while i < len(glob):
        if glob.startswith("**", i):
            out[-1] = (out[-1][0], "all")
            i += 2
        elif glob[i] == "*":
            if out[-1][1] != "all":
                out[-1] = (out[-1][0], "/")
            i += 1
        else:
            out.append((glob[i], ""))
            i += 1
    return out


class Automaton:
    """State bit j of a rule: its first j characters are read. Bit 0 is set at the start only."""

    def __init__(self, globs: tuple[str, ...] | list[str]):
        steps = [_steps(g) for g in globs]
        n = max(1, sum(map(len, steps)))
        self.words = (n + _WORD - 1) // _WORD
        self.first = self._mask([])
        self.last: list[int] = []
        char: dict[str, list[int]] = {}
        any_one, loop_all, loop_in = [], [], []
        at, starts = 0, []
        for rule in steps:
            starts.append(at)
            for j, (what, loop) in enumerate(rule):
                if j and what == "?":
                    any_one.append(at + j)
                elif j:
                    char.setdefault(what, []).append(at + j)
                if loop == "all":
                    loop_all.append(at + j)
                elif loop == "/":
                    loop_in.append(at + j)
            at += len(rule)
            self.last.append(at - 1)
        self.first = self._mask(starts)
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted(char))}
        # rows: 0 for a character of no rule, then the alphabet, then "/" if no rule names it
        slash = self.alphabet.setdefault("/", len(self.alphabet) + 1)
        self.step = np.stack([self._mask(any_one)] * (len(self.alphabet) + 1))
        self.loop = np.stack([self._mask(loop_all) | self._mask(loop_in)] * (len(self.alphabet) + 1))
        for c, bits in char.items():
            self.step[self.alphabet[c]] |= self._mask(bits)
        self.step[slash] = self._mask(char.get("/", []))
        self.loop[slash] = self._mask(loop_all)

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // _WORD] |= np.uint64(1 << (b % _WORD))
        return out

    def match(self, texts: list[str]) -> np.ndarray:
        """Which rules fit which texts: booleans, texts by rules."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        state = np.tile(self.first, (len(texts), 1))
        codes = np.zeros((len(texts), 0), np.int32)
        width = 256  # characters that are turned into codes at a time: long urls don't widen the table of all
        for at in range(int(lengths[0]) if len(texts) else 0):
            live = int(np.searchsorted(-lengths, -at, side="left"))  # those longer than at
            if at % width == 0:
                codes = np.zeros((live, width), np.int32)
                for row in range(live):
                    piece = texts[order[row]][at : at + width]
                    codes[row, : len(piece)] = [self.alphabet.get(c, 0) for c in piece]
            s, c = state[:live], codes[:live, at % width]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(_WORD - 1)
            state[:live] = (moved & self.step[c]) | (s & self.loop[c])
        out = np.zeros((len(texts), len(self.last)), bool)
        for k, b in enumerate(self.last):
            out[order, k] = (state[:, b // _WORD] >> np.uint64(b % _WORD)) & np.uint64(1) == 1
        return out


SCHEMA = "id long, host string, path string, rule string, glob string, verdict string"


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules: tuple[SiteRule, ...] = SITE_RULES, block_globs: tuple[str, ...] = BLOCK_GLOBS, default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, the site rule that wins, the first glob that blocks where none fits, and the verdict. No shuffle."""

    def start():
        by_length = sorted(range(len(site_rules)), key=lambda k: -len(site_rules[k].name))
        auto = Automaton([r.glob for r in site_rules] + list(block_globs))

        def apply(cols):
            parts = [canonical(u) for u in cols["url"]]
            fits = auto.match([f".{h}{p}" if h else "" for h, p in parts])
            rule, glob, verdict = [], [], []
            for row in fits:
                site = next((site_rules[k] for k in by_length if row[k]), None)
                held = None if site else next((g for k, g in enumerate(block_globs) if row[len(site_rules) + k]), None)
                rule.append(site.name if site else None)
                glob.append(held)
                verdict.append(site.verdict if site else "block" if held else default)
            return {"id": cols["id"], "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": rule, "glob": glob, "verdict": verdict}

        return apply

    return map_columns(pages.selectExpr(f"cast(`{id_col}` as bigint) as id", f"cast(`{url_col}` as string) as url"), SCHEMA, start)

"""Search: BM25 over character trigrams with metadata filters, and the plain substring path for short Han queries.

Ranked search reads the stored index: the postings of the query's trigrams name the blocks of notes that may match; one partial aggregate over those counts the notes that
hold each phrase, and one scan filters, ranks and keeps the best `limit` rows. Only those rows reach Python, for their snippets.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, occurrences
from ..sources.index import Index
from . import ftsquery

#: The weights in force by column. They stand one column later than their order in the call suggests, as the id column counts too.
WEIGHTS = {"title": 8.0, "path": 1.0, "body": 4.0, "tags": 6.0, "aliases": 1.0}
K1, B = 1.2, 0.75
SNIPPET_TOKENS = 24


def normalize_query(query: str) -> str:
    return unicodedata.normalize("NFKC", query).strip()


def clamp_limit(limit: float | None) -> int:
    if limit is None or not math.isfinite(limit):
        return 10
    return max(1, min(50, math.trunc(limit)))


def _is_han(c: str) -> bool:
    return unicodedata.name(c, "").startswith(("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "CJK RADICAL", "KANGXI RADICAL", "IDEOGRAPHIC NUMBER ZERO", "IDEOGRAPHIC ITERATION", "HANGZHOU NUMERAL"))


def has_short_han_run(query: str) -> bool:
    """Whether some run of Han characters is shorter than a trigram."""
    run = 0
    for c in [*query, " "]:
        if _is_han(c):
            run += 1
        elif run:
            if run < 3:
                return True
            run = 0
    return False


def metadata_filter(notes: DataFrame, status: str | None = None, type: str | None = None, tag: str | None = None) -> DataFrame:  # noqa: A002
    """Exact matches; without a status, all but deleted notes."""
    out = notes.where(F.col("status") == status if status is not None else F.col("status") != "deleted")
    if type is not None:
        out = out.where(F.col("type") == type)
    return out.where(F.array_contains("tags", tag)) if tag is not None else out


def _low(c: str) -> Column:
    return F.col(f"_{c}")


def bm25(indexed: DataFrame, tree: ftsquery.Node, figures: tuple[int, float], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The notes that match, with `rank` (lower is better). indexed: live notes with their texts, all that hold some phrase at least; filters come after, as they don't
    change the figures. figures: how many notes there are in all, and their average number of trigrams."""
    phrases = [(p, cols) for p, cols in ftsquery.leaves(tree) if len(p.text) >= 3]
    has = [reduce(lambda a, b: a | b, [F.contains(_low(c), F.lit(p.text)) for c in cols]) if cols else F.lit(False) for p, cols in phrases]
    held = indexed.agg(F.count("*"), *[F.count_if(h) for h in has]).first()
    n, avgdl = figures
    rank = F.lit(0.0)
    for (p, cols), known in zip(phrases, held[1:], strict=True):
        idf = math.log((n - known + 0.5) / (known + 0.5))
        f = reduce(lambda a, b: a + b, [F.lit(weights[c]) * occurrences(_low(c), p.text) for c in cols], F.lit(0.0))
        rank = rank - F.lit(idf if idf > 0 else 1e-6) * f * F.lit(K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(avgdl)))
    return indexed.where(ftsquery.matches(tree, _low)).withColumn("rank", rank).drop(*[f"_{c}" for c in ftsquery.COLUMNS])


def search_fts(index: Index, query: str, limit: int = 10, **filters) -> DataFrame:
    """The best matches among live notes."""
    tree = ftsquery.parse(query)
    phrases = [p.text for p, _ in ftsquery.leaves(tree) if len(p.text) >= 3]
    found = bm25(index.holding(phrases).where("status <> 'deleted'"), tree, index.figures())
    hits = metadata_filter(found, **filters).orderBy("rank", "path").limit(limit)
    needles = [p.text for p, cols in ftsquery.leaves(tree) if len(p.text) >= 3 and "body" in cols]

    @F.pandas_udf("string")
    def cut(body: pd.Series) -> pd.Series:
        return body.map(lambda b: snippet(b, needles))

    return hits.withColumn("snippet", cut("body"))


def search_like(notes: DataFrame, query: str, limit: int = 10, **filters) -> DataFrame:
    """Every blank-separated token in the title, path or body, without ASCII case; titles and paths that hold the first token come first, then short bodies."""
    tokens = query.split()
    fold = {c: ascii_lower(F.col(c)) for c in ("title", "path", "body")}
    needle = lambda t: F.lit("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    hit = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.contains(fold[c], needle(t)) for c in fold]) for t in tokens], F.lit(True))
    first = needle(tokens[0]) if tokens else F.lit("")
    found = metadata_filter(notes, **filters).where(hit).withColumn("rank", F.lit(0.0))
    top = found.orderBy(F.contains(fold["title"], first).desc(), F.contains(fold["path"], first).desc(), F.length("body"), "title", "path").limit(limit)
    return top.withColumn("snippet", like_snippet(F.col("body"), tokens))


def like_snippet(body: Column, tokens: list[str]) -> Column:
    """20 characters before and 40 after the first token that the body holds; else its first 80."""
    low = F.lower(body)
    out = F.when(F.length(body) > 80, F.substr(body, F.lit(1), F.lit(80))).otherwise(body)
    for t in reversed(tokens):
        at = F.instr(low, t.lower())
        start, end = F.greatest(F.lit(1), at - 20), at + len(t) + 40
        text = F.concat(F.when(start > 1, F.lit("… ")).otherwise(""), F.substr(body, start, at - start), F.lit("["), F.substr(body, at, F.lit(len(t))), F.lit("]"), F.substr(body, at + len(t), F.lit(40)), F.when(end <= F.length(body), F.lit(" …")).otherwise(""))
        out = F.when(at > 0, text).otherwise(out)
    return out


def search(index: Index, query: str, limit: float | None = 10, **filters) -> DataFrame:
    """The notes' rows with rank and snippet, best first."""
    q, n = normalize_query(query), clamp_limit(limit)
    return search_like(index.notes(), q, n, **filters) if has_short_han_run(q) else search_fts(index, q, n, **filters)


_SENTENCE = re.compile(r"[.:]\s+")


def snippet(body: str | None, needles: list[str], tokens: int = SNIPPET_TOKENS) -> str:
    """The best window of `tokens` trigrams with the needles in brackets."""
    body = body or ""
    low, last = body.lower(), len(body) - 2
    spans = sorted((i, k, len(p)) for k, p in enumerate(needles) for i in _places(low, p))
    count = max(0, last)
    if not spans:
        start = 0
    else:
        starts = [0] + [m.end() for m in _SENTENCE.finditer(body)]
        best, start = -1, 0
        for io, _, _ in spans:
            score, first, end = _window(spans, io, tokens)
            at = max(0, min(first - math.trunc((tokens - (end - first)) / 2), count - tokens))
            if score > best:
                best, start = score, at
            if count > tokens:
                sentence = max(s for s in starts if s <= io)
                if sentence < io:
                    score = _window(spans, sentence, tokens)[0] + (120 if sentence == 0 else 100)
                    if score > best:
                        best, start = score, sentence
    stop = min(len(body), start + tokens + 2)
    marks: list[list[int]] = []
    for i, _, n in spans:
        a, b = i, i + n
        if a < start or a >= start + tokens:
            continue
        if marks and a <= marks[-1][1]:
            marks[-1][1] = max(marks[-1][1], min(b, stop))
        else:
            marks.append([a, min(b, stop)])
    out, at = [], start
    for a, b in marks:
        out += [body[at:a], "[", body[a:b], "]"]
        at = b
    out.append(body[at:stop])
    return (" … " if start > 0 else "") + "".join(out) + (" … " if start + tokens < count else "")


def _places(text: str, phrase: str) -> list[int]:
    out, at = [], text.find(phrase)
    while at >= 0:
        out.append(at)
        at = text.find(phrase, at + 1)
    return out


def _window(spans: list[tuple[int, int, int]], at: int, tokens: int) -> tuple[int, int, int]:
    """(score, first hit, end of the last) of the window that begins at a position: 1000 for a needle's first hit, 1 for each further one."""
    score, first, end, seen = 0, -1, 0, set()
    for i, k, n in spans:
        if at <= i < at + tokens:
            score += 1 if k in seen else 1000
            seen.add(k)
            first = i if first < 0 else first
            end = max(end, i + n - 2)
    return score, max(first, 0), end

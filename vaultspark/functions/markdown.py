"""Markdown structure as column expressions: links, headings, inline tags. No Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import JS_SPACE, js_trim, normalize_tag, utf16_length

# The patterns that define links, headings and inline tags.
WIKI_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
MARKDOWN_LINK = r"\[[^\]]+\]\(([^)#]+)(?:#[^)]+)?\)"
HEADING = rf"^(#{{1,6}})[ \t]+([^\n\r\x{{2028}}\x{{2029}}]+?)[{JS_SPACE}]*\z"
INLINE_TAG = rf"(?:^|[{JS_SPACE}(（\[【\"'，。；：、])#([\p{{L}}_][\p{{L}}\p{{N}}_\-/]{{0,63}})"
FENCED = r"(?s)```.*?```"
INLINE_CODE = r"`[^`\n]+`"

HEADING_TYPE = "array<struct<level:int,text:string,slug:string,line:int,position:int,path:array<string>>>"


def wiki_links(body: Column) -> Column:
    """Targets of [[target#heading|shown]], in order, repeats kept."""
    return F.transform(F.regexp_extract_all(body, F.lit(WIKI_LINK), F.lit(1)), js_trim)


def markdown_links(body: Column) -> Column:
    """Targets of [shown](target#heading) that end in .md."""
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(MARKDOWN_LINK), F.lit(1)), js_trim), lambda t: F.endswith(t, F.lit(".md")))


def links(body: Column) -> Column:
    """Both kinds, wiki links first, each target once."""
    return F.array_distinct(F.concat(wiki_links(body), markdown_links(body)))


def inline_tags(body: Column) -> Column:
    """Tags in running text, outside code."""
    plain = F.regexp_replace(F.regexp_replace(body, FENCED, " "), INLINE_CODE, " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(INLINE_TAG), F.lit(1)), normalize_tag))


def heading_text(line: Column) -> Column:
    """The text of a heading line without closing #s; empty for other lines."""
    return js_trim(F.regexp_replace(F.regexp_extract(line, HEADING, 2), r"[ \t]+#+[ \t]*\z", ""))


def slug_base(text: Column) -> Column:
    s = js_trim(F.lower(text))
    s = F.regexp_replace(F.regexp_replace(s, r"[`*_~]", ""), rf"[^\p{{L}}\p{{N}}{JS_SPACE}\-]", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, rf"[{JS_SPACE}]+", "-"), "-+", "-"), r"^-|-\z", "")
    return F.when(s == "", F.lit("heading")).otherwise(s)


LINES = 128


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once: a lambda's variable is not made again wherever it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def headings(body: Column) -> Column:
    """The outline, of HEADING_TYPE: level, text, unique slug, line from 1, position in UTF-16 units, and the path of texts down to it.

    One pass over the lines carries the position and the headings so far, those of each LINES lines in an array of their own, as an array is copied whenever it
    grows. A heading's ancestors are, going back, those of ever lower level: the stack keeps them. Slugs that repeat are numbered by sorting."""
    stack, entry = "array<struct<level:int,text:string>>", "struct<level:int,text:string,base:string,line:int,position:int,path:array<string>>"
    begin = lambda line, pos, stack, kind: F.struct(line.alias("line"), pos.alias("pos"), stack.alias("stack"), F.array().cast(kind).alias("out"))
    start = begin(F.lit(0), F.lit(0), F.array().cast(stack), f"array<array<{entry}>>")

    def found(acc: Column, head: Column) -> Column:
        above = F.filter(acc["stack"], lambda s: s["level"] < head["level"])
        one = F.struct(head["level"].alias("level"), head["text"].alias("text"), slug_base(head["text"]).alias("base"), (acc["line"] + 1).alias("line"), acc["pos"].alias("position"), F.concat(F.transform(above, lambda s: s["text"]), F.array(head["text"])).alias("path"))
        return F.struct(F.concat(above, F.array(head)).alias("stack"), F.concat(acc["out"], F.array(one)).alias("out"))

    def step(acc: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"\r\z", "")
        head = F.struct(F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), heading_text(line).alias("text"))
        same = F.struct(acc["stack"].alias("stack"), acc["out"].alias("out"))
        kept = F.when(F.startswith(raw, F.lit("#")), _let(head, lambda h: F.when((h["level"] > 0) & (h["text"] != ""), found(acc, h)).otherwise(same))).otherwise(same)
        return _let(kept, lambda k: F.struct((acc["line"] + 1).alias("line"), (acc["pos"] + utf16_length(raw) + 1).cast("int").alias("pos"), k["stack"].alias("stack"), k["out"].alias("out")))

    def group(acc: Column, lines: Column) -> Column:
        within = F.aggregate(lines, begin(acc["line"], acc["pos"], acc["stack"], f"array<{entry}>"), step)
        return _let(within, lambda w: F.struct(w["line"].alias("line"), w["pos"].alias("pos"), w["stack"].alias("stack"), F.concat(acc["out"], F.array(w["out"])).alias("out")))

    def numbered(out: Column) -> Column:
        """The number of each heading among those of its slug: slugs sorted, runs counted, and back to the order of headings."""
        ordered = F.array_sort(F.transform(out, lambda h, i: F.struct(h["base"].alias("base"), i.alias("i"))))
        firsts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (s[j]["base"] != s[j - 1]["base"]))
        run = lambda s, f: lambda a, k: F.transform(F.sequence(a, F.coalesce(F.get(f, k + 1), F.size(s)) - 1), lambda j: F.struct(s[j]["i"].alias("i"), (j - a + 1).alias("n")))
        return F.array_sort(F.flatten(_let(ordered, lambda s: _let(firsts(s), lambda f: F.transform(f, run(s, f))))))

    def named(h: Column, n: Column) -> Column:
        slug = F.when(n["n"] == 1, h["base"]).otherwise(F.concat_ws("-", h["base"], n["n"].cast("string")))
        return F.struct(h["level"].alias("level"), h["text"].alias("text"), slug.alias("slug"), h["line"].alias("line"), h["position"].alias("position"), h["path"].alias("path"))

    groups = _let(F.split(body, "\n", -1), lambda lines: F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES).cast("int")), lambda g: F.slice(lines, g * LINES + 1, F.lit(LINES))))
    outline = _let(F.flatten(F.aggregate(groups, start, group, lambda acc: acc["out"])), lambda out: F.when(F.size(out) > 0, F.zip_with(out, numbered(out), named)))
    none = F.array().cast(HEADING_TYPE)
    return F.when(body.isNotNull(), F.coalesce(outline.cast(HEADING_TYPE), none))

"""Column helpers for text: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that ECMAScript counts as white space, as the inside of a character class.
_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
JS_SPACE = "".join(rf"\x{{{c:X}}}" for c in _SPACES)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: code points above the first plane count twice."""
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", "")))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


def ascii_lower(c: Column) -> Column:
    """A-Z only, as LIKE compares."""
    return F.translate(c, UPPER, LOWER)


def stem(path: Column) -> Column:
    """The last segment without its extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?\z", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1))


def is_markdown(path: Column) -> Column:
    return extension(path).isin(".md", ".mdx")


def fallback_id(path: Column) -> Column:
    """The id of a note whose frontmatter has none."""
    cut = F.regexp_replace(path, r"(?i)\.md\z", "")
    return F.lower(F.regexp_replace(F.regexp_replace(cut, r"[^a-zA-Z0-9_-]+", "_"), r"^_+|_+\z", ""))


def posix_normalize(path: Column) -> Column:
    """Resolves "." and ".." and doubled slashes of a relative path; ".." that leads out of the root stays."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("..")) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(p))),
    )
    joined = F.array_join(kept, "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)


def normalize_tag(c: Column) -> Column:
    return F.lower(F.regexp_replace(js_trim(c), "^#+", ""))


def normalize_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, normalize_tag), lambda t: t != ""))


def has_han(c: Column) -> Column:
    return c.rlike(r"\p{IsHan}")


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def contains_text(c: Column, part: str) -> Column:
    return F.contains(c, F.lit(part))


def occurrences(c: Column, phrase: str) -> Column:
    """How often a phrase occurs, overlapping occurrences each. A phrase that can't overlap itself is counted by what its removal takes away."""
    if any(phrase.startswith(phrase[k:]) for k in range(1, len(phrase))):
        quoted = "\\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return F.regexp_count(c, F.lit(f"(?={quoted})"))
    gone = F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))
    return (gone / F.lit(len(phrase))).cast("int")

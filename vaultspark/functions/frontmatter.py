"""Frontmatter: the split is native; only the YAML itself is read in Python, by Arrow batches."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

FIELDS = ("id", "title", "type", "status", "tags", "aliases", "created", "updated", "frontmatter", "error")


class _Loader(yaml.SafeLoader):
    """YAML whose only booleans are true and false: yes, no, on and off stay text."""


_Loader.yaml_implicit_resolvers = {c: [(tag, rx) for tag, rx in rules if tag != "tag:yaml.org,2002:bool"] for c, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", __import__("re").compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def block(raw: Column) -> Column:
    """The text between the fences; null where there is no frontmatter. It must start at the first character (a byte order mark aside)."""
    rest = F.substr(_bare(raw), F.lit(4))
    close = F.instr(rest, "\n---")
    return F.when(_opens(raw), F.when(close == 0, rest).otherwise(F.substr(rest, F.lit(1), close - 1)))


def body(raw: Column) -> Column:
    """What follows the closing fence, less one line end; the whole text where there is no frontmatter."""
    rest = F.substr(_bare(raw), F.lit(4))
    close = F.instr(rest, "\n---")
    after = F.regexp_replace(F.substr(rest, close + 4), r"^\r?\n?", "")
    return F.when(_opens(raw), F.when(close == 0, F.lit("")).otherwise(after)).otherwise(_bare(raw))


def _bare(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^\x{FEFF}", "")


def _opens(raw: Column) -> Column:
    return F.startswith(_bare(raw), F.lit("---")) & (F.substr(_bare(raw), F.lit(4), F.lit(1)) != "-")


def as_text(value: object) -> str | None:
    """Text that isn't blank, trimmed; a date as YYYY-MM-DD; anything else counts as absent."""
    if isinstance(value, str) and value.strip():
        return value.strip()
    if isinstance(value, dt.datetime):
        return (value.astimezone(dt.UTC) if value.tzinfo else value).strftime("%Y-%m-%d")
    return value.isoformat() if isinstance(value, dt.date) else None


def as_texts(value: object) -> list[str]:
    if isinstance(value, list):
        said = [_said(v) for v in value]
    elif isinstance(value, str):
        said = value.split(",")
    else:
        return []
    return [s.strip() for s in said if s.strip()]


def _said(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def _plain(v: object) -> object:
    if isinstance(v, (dt.datetime, dt.date)):
        return as_text(v)
    raise TypeError(type(v).__name__)


def read_yaml(text: str | None) -> dict:
    """The fields of FIELDS. What isn't a mapping has no fields; ill-formed YAML gives an error."""
    try:
        data = yaml.load(text, _Loader) if text and text.strip() else {}  # noqa: S506
    except yaml.YAMLError as e:
        return dict.fromkeys(FIELDS) | {"error": str(e).replace("\n", " ")}
    data = data if isinstance(data, dict) else {}
    out = {k: as_text(data.get(k)) for k in ("id", "title", "type", "status", "created", "updated")}
    return out | {"tags": as_texts(data.get("tags")), "aliases": as_texts(data.get("aliases")), "frontmatter": json.dumps(data, ensure_ascii=False, default=_plain), "error": None}


_TYPE = StructType([StructField(n, ArrayType(StringType()) if n in ("tags", "aliases") else StringType()) for n in FIELDS])


@F.pandas_udf(_TYPE)
def fields(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_yaml(t) for t in text], columns=list(FIELDS))

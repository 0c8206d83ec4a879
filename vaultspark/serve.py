"""The vault's tools over the Model Context Protocol: JSON-RPC 2.0, a message a line, on standard input and output. No package is needed for that."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import TextIO

from . import session

#: The latest revision of the protocol that is spoken here.
PROTOCOL = "2025-06-18"
PARSE_ERROR, BAD_REQUEST, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602

_KINDS = {"string": str, "integer": int, "array": list}


class BadArguments(ValueError):
    """A tool's arguments don't fit its schema."""


@dataclass(frozen=True)
class Tool:
    """fields: by name a JSON schema, which may hold a default; required: those that must be given. call(vault, arguments)"""

    about: str
    fields: dict[str, dict]
    required: tuple[str, ...]
    call: Callable[[session.Vault, dict], object]

    def schema(self) -> dict:
        return {"type": "object", "properties": self.fields, "required": list(self.required), "additionalProperties": False}

    def arguments(self, given: dict) -> dict:
        """What was given, checked, with defaults for the rest."""
        for name in given.keys() - self.fields.keys():
            raise BadArguments(f"unknown argument: {name}")
        out = {}
        for name, rule in self.fields.items():
            if given.get(name) is None:
                if name in self.required:
                    raise BadArguments(f"missing argument: {name}")
                if "default" in rule:
                    out[name] = rule["default"]
                continue
            value = given[name]
            ok = isinstance(value, _KINDS[rule["type"]]) and not isinstance(value, bool)
            ok = ok and (rule["type"] != "integer" or rule.get("minimum", value) <= value <= rule.get("maximum", value))
            ok = ok and (rule["type"] != "string" or len(value) >= rule.get("minLength", 0) and value in rule.get("enum", [value]))
            ok = ok and (rule["type"] != "array" or all(isinstance(v, str) for v in value))
            if not ok:
                raise BadArguments(f"bad value of {name}: {value!r}")
            out[name] = value
        return out


def _text(least: int = 0, **more) -> dict:
    return {"type": "string", **({"minLength": least} if least else {}), **more}


def _number(low: int, high: int, **more) -> dict:
    return {"type": "integer", "minimum": low, "maximum": high, **more}


_TEXTS = {"type": "array", "items": {"type": "string"}}

TOOLS = {
    "status": Tool("How many notes the index has, by type and tag, and how the last sync went.", {}, (), lambda v, a: {"vault": str(v.root), "watch_enabled": True, "last_sync": v.last_sync, **v.status()}),
    "search": Tool(
        "Ranked search of titles, paths, bodies, tags and aliases, each hit with a summary of its links.",
        {"query": _text(1), "limit": _number(1, 50, default=10), "status": _text(), "type": _text(), "tag": _text()},
        ("query",),
        lambda v, a: v.search(**a),
    ),
    "get_note": Tool("A note in full, read anew if its file has changed, with its links to a distance of one.", {"id": _text(1), "graphLimit": _number(1, 100, default=20)}, ("id",), lambda v, a: v.get_note_fresh(a["id"], a["graphLimit"])),
    "get_graph": Tool(
        "The notes and links around a note.",
        {"id": _text(1), "depth": _number(1, 10, default=1), "direction": _text(enum=["out", "back", "both"], default="both"), "maxNodes": _number(1, 500, default=100)},
        ("id",),
        lambda v, a: v.get_graph(a["id"], a["depth"], a["direction"], a["maxNodes"]) or {"error": f"Note not found: {a['id']}"},
    ),
    "sync": Tool("Compares all files with the index and takes over what has changed.", {}, (), lambda v, a: v.sync()),
    "explore_notes": Tool("An answer to an open question: the best notes in full, further ones as pointers.", {"query": _text(1), "maxNotes": _number(2, 5)}, ("query",), lambda v, a: v.explore(a["query"], a.get("maxNotes"))),
    "suggest_tags": Tool("Tags for a text: those in it, its folder's, and known tags that occur in it.", {"path": _text(1), "title": _text(default=""), "content": _text(default="")}, ("path",), lambda v, a: {"suggested_tags": v.suggest_tags(**a)}),
    "create_note": Tool(
        "Writes a new note and indexes it; without tags, they are derived.",
        {"path": _text(1), "title": _text(1), "content": _text(default=""), "type": _text(default="note"), "status": _text(default="active"), "tags": {**_TEXTS, "default": []}},
        ("path", "title"),
        lambda v, a: v.create_note(**a),
    ),
    "update_note": Tool(
        "Changes the given parts of a note and indexes it anew.",
        {"id": _text(1), "title": _text(1), "content": _text(), "type": _text(1), "status": _text(1), "tags": _TEXTS, "aliases": _TEXTS},
        ("id",),
        lambda v, a: v.update_note(a.pop("id"), **a),
    ),
}


class Server:
    def __init__(self, vault: session.Vault):
        self.vault = vault

    def answer(self, line: str) -> dict | None:
        """The reply to a message; None to a notification."""
        try:
            message = json.loads(line)
        except ValueError:
            return _error(None, PARSE_ERROR, "not JSON")
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return _error(message.get("id") if isinstance(message, dict) else None, BAD_REQUEST, "not a request")
        if "id" not in message:
            return None
        params = message.get("params") or {}
        match message["method"]:
            case "initialize":
                result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "vaultspark", "version": "2"}, "instructions": session.INSTRUCTIONS}
            case "ping":
                result = {}
            case "tools/list":
                result = {"tools": [{"name": n, "description": t.about, "inputSchema": t.schema()} for n, t in TOOLS.items()]}
            case "tools/call":
                tool = TOOLS.get(params.get("name"))
                if tool is None:
                    return _error(message["id"], BAD_PARAMS, f"unknown tool: {params.get('name')}")
                try:
                    result = _content(tool.call(self.vault, tool.arguments(params.get("arguments") or {})), False)
                except BadArguments as e:
                    return _error(message["id"], BAD_PARAMS, str(e))
                except Exception as e:  # the tool's own failure is its result
                    result = _content({"error": str(e)}, True)
            case other:
                return _error(message["id"], NO_METHOD, f"unknown method: {other}")
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}

    def run(self, lines: TextIO, out: TextIO) -> None:
        for line in lines:
            if line.strip():
                reply = self.answer(line)
                if reply is not None:
                    out.write(json.dumps(reply, ensure_ascii=False, default=str) + "\n")
                    out.flush()


def _error(number: object, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": text}}


def _content(value: object, failed: bool) -> dict:
    return {"content": [{"type": "text", "text": json.dumps(value, indent=2, ensure_ascii=False, default=str)}], "isError": failed}


def serve(spark, vault: session.Vault) -> None:
    """Syncs, follows the files, and answers until the input ends."""
    from .streaming.watch import watch

    query = watch(spark, vault, str(vault.store.dir / "watch"))
    try:
        Server(vault).run(sys.stdin, sys.stdout)
    finally:
        query.stop()

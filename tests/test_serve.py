"""The tools as a client calls them."""

import io
import json

from vaultspark import cli
from vaultspark.serve import TOOLS, Server
from vaultspark.session import Vault


def ask(server, number, method, **params):
    out = io.StringIO()
    server.run(io.StringIO(json.dumps({"jsonrpc": "2.0", "id": number, "method": method, "params": params}) + "\n\n"), out)
    reply = json.loads(out.getvalue())
    assert reply["jsonrpc"] == "2.0" and reply["id"] == number
    return reply


def call(server, name, **arguments):
    reply = ask(server, 7, "tools/call", name=name, arguments=arguments)
    return json.loads(reply["result"]["content"][0]["text"]), reply["result"]["isError"]


def test_every_tool(spark, tmp_path):
    server = Server(Vault(spark, str(tmp_path)))
    assert ask(server, 1, "initialize")["result"]["capabilities"] == {"tools": {}}
    assert {t["name"] for t in ask(server, "x", "tools/list")["result"]["tools"]} == set(TOOLS) and ask(server, 2, "ping")["result"] == {}
    made, failed = call(server, "create_note", path="a/one", title="One", content="needle [[two]] #tag\n")
    assert not failed and made["id"] == "a_one" and made["tags"] == ["tag"]
    call(server, "create_note", path="two", title="Two", content="hay\n", tags=["T"])
    assert [r["id"] for r in call(server, "search", query="needle", limit=5)[0]] == ["a_one"]
    assert call(server, "get_note", id="a_one")[0]["graph"]["outlinks"][0]["id"] == "two"
    assert {n["id"] for n in call(server, "get_graph", id="two", direction="back")[0]["nodes"]} == {"a_one", "two"}
    assert "error" in call(server, "get_graph", id="nobody")[0] and "error" in call(server, "get_note", id="nobody")[0]
    assert call(server, "explore_notes", query="needle", maxNotes=2)[0]["answerNotes"][0]["id"] == "a_one"
    assert call(server, "suggest_tags", path="x/tagged.md", content="a tag")[0]["suggested_tags"] == ["tag"]
    assert call(server, "update_note", id="two", status="archived")[0]["success"] and call(server, "sync")[0]["errors"] == []
    assert call(server, "status")[0]["total"] == 2
    assert call(server, "update_note", id="nobody", title="x")[1]
    # what doesn't fit is refused, and a notification has no answer
    for name, arguments in (("search", {}), ("search", {"query": ""}), ("search", {"query": "a", "limit": 51}), ("get_graph", {"id": "a", "direction": "up"}), ("explore_notes", {"query": "q", "maxNotes": 6}), ("search", {"query": 3}), ("status", {"x": 1}), ("none", {})):
        assert ask(server, 3, "tools/call", name=name, arguments=arguments)["error"]["code"] == -32602
    assert ask(server, 4, "nothing")["error"]["code"] == -32601
    assert server.answer("{") ["error"]["code"] == -32700 and server.answer("[]")["error"]["code"] == -32600
    assert server.answer('{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None
    assert cli.parser().parse_args(["mcp", "-v", "x"]).command == "mcp"

"""Command line: init, sync, status, search, get, watch, mcp. Results are JSON on standard output."""

from __future__ import annotations

import argparse
import json
import sys


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be a positive integer")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vaultspark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "sync", "status", "search", "get", "watch", "mcp"):
        c = sub.add_parser(name)
        c.add_argument("-v", "--vault")
        if name == "search":
            c.add_argument("query")
            c.add_argument("-l", "--limit", type=positive, default=10)
            for more in ("status", "type", "tag"):
                c.add_argument(f"--{more}")
        if name == "get":
            c.add_argument("id")
    return p


def said(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)


def run(args: argparse.Namespace, vault) -> object:
    if args.command in ("init", "sync"):
        return vault.sync()
    if args.command == "status":
        return {"vault": str(vault.root), "last_sync": vault.last_sync, "status": vault.status()}
    if args.command == "search":
        return vault.search(args.query, args.limit, args.status, args.type, args.tag)
    return vault.get_note(args.id)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .session import Vault

    spark = SparkSession.builder.appName("vaultspark").getOrCreate()
    vault = Vault(spark, args.vault)
    if args.command == "watch":
        from .streaming.watch import watch

        watch(spark, vault, str(vault.store.dir / "watch")).awaitTermination()
        return 0
    if args.command == "mcp":
        from .serve import serve

        serve(spark, vault)
        return 0
    print(said(run(args, vault)))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: python -m corposcope [--root DIR] [--index URI] [--json] COMMAND ..."""
from __future__ import annotations

import argparse
import hashlib
import os
import sys

from corposcope import formatting
from corposcope.errors import EngineError


def default_index(root: str, shared: str | None = None) -> str:
    """Index location of a workspace: a hash of the root below the folder that the cluster shares, else below the user's cache."""
    base = os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache")
    return f"{shared.rstrip('/') if shared else f'file://{base}'}/corposcope/{hashlib.sha256(os.path.realpath(root).encode()).hexdigest()[:16]}"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corposcope")
    p.add_argument("--root", default=".")
    p.add_argument("--index")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("-l", "--limit", type=int, default=20)
    c.add_argument("-m", "--mode", choices=("combined", "fts", "grep"), default="combined")
    c = sub.add_parser("refs")
    c.add_argument("symbol")
    c.add_argument("-l", "--limit", type=int, default=50)
    c = sub.add_parser("outline")
    c.add_argument("path")
    c = sub.add_parser("get")
    c.add_argument("path")
    c.add_argument("--start", type=int, default=1)
    c.add_argument("--end", type=int, default=0)
    c.add_argument("--bounded", action="store_true")
    c = sub.add_parser("context")
    c.add_argument("path")
    c.add_argument("line", type=int)
    c.add_argument("-C", "--around", type=int, default=10)
    c = sub.add_parser("toc")
    c.add_argument("path", nargs="?", default="")
    c.add_argument("-d", "--depth", type=int, default=3)
    c = sub.add_parser("diff")
    c.add_argument("a")
    c.add_argument("b")
    c.add_argument("-C", "--around", type=int, default=3)
    c = sub.add_parser("stats")
    c.add_argument("--detailed", action="store_true")
    c = sub.add_parser("workspace")
    c.add_argument("path")
    c = sub.add_parser("index")
    c.add_argument("--force", action="store_true")
    return p


def run(engine, a: argparse.Namespace) -> tuple[str, int]:
    """(text, exit code) of one command; searches and references without a hit exit with 1."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    shown = lambda found, text: formatting.pretty(found) if a.json else text(found)
    if a.command == "search":
        found = rows(engine.search(a.query, a.limit, a.mode))
        more = bool(found and found[0]["has_more"])
        return shown(found, lambda f: formatting.search(f, more) if f else formatting.no_results(a.mode)), int(not found)
    if a.command == "refs":
        found = rows(engine.refs(a.symbol, a.limit))
        return shown(found, formatting.references), int(not found)
    if a.command == "outline":
        return shown(rows(engine.outline(a.path)), lambda f: formatting.outline(a.path, a.path.rsplit(".", 1)[-1].lower(), f)), 0
    if a.command == "get":
        return shown(rows(engine.get(a.path, a.start, a.end)), lambda f: (formatting.bounded(a.path, f[0]["content"]) if a.bounded else f[0]["content"]) if f else ""), 0
    if a.command == "context":
        return shown(rows(engine.context(a.path, a.line, a.around)), lambda f: formatting.context(a.path, a.line, f[0]["content"] if f else "")), 0
    if a.command == "toc":
        found = rows(engine.toc(a.path, a.depth))
        dirs = sum(r["is_dir"] for r in found)
        return shown(found, lambda f: formatting.tree(f, dirs, len(f) - dirs)), 0
    if a.command == "diff":
        return shown(rows(engine.diff(a.a, a.b, a.around)), lambda f: formatting.diff(f[0])), 0
    if a.command == "stats":
        types = rows(engine.by_type()) if a.detailed else []
        return shown(rows(engine.stats()), lambda f: formatting.stats(f[0], types)), 0
    if a.command == "workspace":  # another root with an index of its own; one that exists is brought up to date
        spark = engine.spark
        other = type(engine).open(spark, a.path, a.index or default_index(a.path, spark.conf.get("spark.checkpoint.dir", None)))
        n = other.store.metadata().get("files", 0)
        return shown([{"root": other.root, "files": n, "index": other.store.path}], lambda f: f"{other.root}: {n} files in {other.store.path}" + ("" if n else "; run index next")), 0
    counters = engine.index(force=a.force)
    return formatting.pretty([counters]) if a.json else formatting.indexed(counters), 0


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from corposcope.engine import Engine
    from corposcope.profiling import measured

    a = parser().parse_args(args)
    root = os.path.realpath(a.root)
    spark = SparkSession.builder.appName("corposcope").getOrCreate()
    try:
        with measured(a.command) as notes:
            text, code = run(Engine(spark, a.index or default_index(root, spark.conf.get("spark.checkpoint.dir", None)), root), a)
            notes["bytes"] = len(text.encode())
    except EngineError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 2
    print(formatting.truncated(text))
    return code


if __name__ == "__main__":
    sys.exit(main())

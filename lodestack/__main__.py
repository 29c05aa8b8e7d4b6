"""Command line: python -m lodestack --index FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys

from .engine import Engine
from .session import build_session
from .sources import folder


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestack", description="Search folders of documents; every hit names its file and page.")
    out.add_argument("--index", default=os.path.join("~", ".lodestack"), help="the folder of the index")
    out.add_argument("--master", default="local[*]", help="Spark's master")
    commands = out.add_subparsers(dest="command", required=True)
    for name, text in (("init", "write a folder's settings and index it"), ("add", "index a folder or file, or bring it up to date"), ("remove", "take a source out of the index")):
        c = commands.add_parser(name, help=text)
        c.add_argument("path")
        if name != "remove":
            c.add_argument("--tag")
            c.add_argument("--exclude", action="append")
    for name, text in (("search", "passages for a query"), ("ask", "the passages that an answer would rest on")):
        c = commands.add_parser(name, help=text)
        c.add_argument("query")
        c.add_argument("--tag", default="")
        c.add_argument("--limit", type=int)
    commands.add_parser("list", help="the indexed sources")
    commands.add_parser("status", help="totals of the index")
    return out


def initialise(path: str, tag: str | None, exclude: list[str] | None) -> folder.Config:
    """Settings of a folder: what is given, else what its settings say, else its name as the tag. Written back."""
    root = folder.canonical(path)
    old = folder.load_config(root)
    config = folder.Config(tag or old.tag or os.path.basename(root), old.exclude if exclude is None else exclude)
    folder.save_config(root, config)
    return config


def run(engine: Engine, args: argparse.Namespace) -> str:
    """A command's output."""
    if args.command in ("init", "add"):
        if args.command == "init":
            config = initialise(args.path, args.tag, args.exclude)
            stats = engine.add(args.path, config.tag)
        else:
            stats = engine.add(args.path, args.tag, args.exclude)
        return f"{stats.indexed} indexed, {stats.skipped} unchanged, {stats.failed} failed, {stats.chunks} chunks"
    if args.command == "remove":
        engine.remove(args.path)
        return f"removed {folder.canonical(args.path)}"
    if args.command == "search":
        return engine.render_hits(args.query, args.tag, args.limit)
    if args.command == "ask":
        return engine.ask(args.query, args.tag, args.limit)
    if args.command == "list":
        return engine.render_sources()
    return ", ".join(f"{v} {k}" for k, v in engine.status().first().asDict().items())


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session("lodestack", args.master)
    spark.sparkContext.setLogLevel("ERROR")
    try:
        print(run(Engine(spark, folder.canonical(args.index) if "://" not in args.index else args.index), args))
    except (ValueError, LookupError) as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: ``python -m treelode (index | snapshot | status | deps PATH) [--root DIR]``."""

from __future__ import annotations

import argparse
import os
import sys

from treelode.functions.paths import is_indexable_root
from treelode.plans import tools
from treelode.plans.workspace import Workspace
from treelode.session import build_session


def run(ws: Workspace, command: str, path: str | None = None) -> str:
    indexed = ws.index()
    if command == "index":
        return tools.dump({"started": True, "indexed_files": indexed["indexed_files"]})
    if command == "snapshot":
        return tools.call_tool(ws, "snapshot", {"write": True})
    if command == "status":
        return tools.call_tool(ws, "status")
    return tools.call_tool(ws, "deps", {"path": path})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="treelode")
    parser.add_argument("command", choices=("index", "snapshot", "status", "deps"))
    parser.add_argument("path", nargs="?")
    parser.add_argument("--root", default=os.getcwd())
    parser.add_argument("--state")
    args = parser.parse_args(argv)
    if args.command == "deps" and not args.path:
        parser.error("deps needs a path")
    root = os.path.realpath(args.root)
    if not is_indexable_root(root) or root == os.path.expanduser("~"):
        parser.error(f"refusing to index {root}")
    spark = build_session()
    try:
        print(run(Workspace(spark, root, args.state), args.command, args.path))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())

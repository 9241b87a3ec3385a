"""The eight tools and their JSON payloads, with argument checks and error codes.

Payloads are produced as text fragments: a long list is streamed from the executors one
partition at a time and never held on the driver.  ``handle_message`` answers a single
JSON-RPC line; reading lines from somewhere is left to the caller.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelode.functions import paths
from treelode.operators import tree
from treelode.plans.workspace import Workspace
from treelode.schema import TREE_SORTS

TOOLS = ("tree", "outline", "search", "deps", "index", "status", "snapshot", "changes")
PROTOCOL = "2025-06-18"
MAX_RESULTS = 10000  # what one answer of the search tool may hold


class ToolError(Exception):
    def __init__(self, code: str, message: str, hint: str | None = None):
        super().__init__(message)
        self.payload = {"error": {"code": code, "message": message, **({"hint": hint} if hint else {})}}


def dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def json_rows(df: DataFrame, *columns: str) -> Iterator[str]:
    """Rows as JSON objects, rendered by Spark, comma-separated; null fields are left out."""
    first = True
    for row in df.select(F.to_json(F.struct(*columns)).alias("j")).toLocalIterator():
        yield row["j"] if first else "," + row["j"]
        first = False


def json_values(df: DataFrame, column: str) -> Iterator[str]:
    first = True
    for row in df.select(column).toLocalIterator():
        yield dump(row[0]) if first else "," + dump(row[0])
        first = False


# ── arguments: strictly typed ────────────────────────────────────────────────


def _text(args: dict, name: str) -> str | None:
    value = args.get(name)
    return value if isinstance(value, str) else None


def _int(args: dict, name: str) -> int | None:
    value = args.get(name)
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _bool(args: dict, name: str, default: bool = False) -> bool:
    value = args.get(name)
    return value if isinstance(value, bool) else default


def _checked_path(path: str) -> str:
    if not paths.is_safe_request_path(path):
        raise ToolError("OUT_OF_SCOPE", "path traversal not allowed")
    if paths.is_sensitive_literal(path):
        raise ToolError("OUT_OF_SCOPE", "sensitive file access blocked")
    return path


def _required(args: dict, name: str) -> str:
    value = _text(args, name)
    if value is None:
        raise ToolError("INVALID_ARGUMENT", f"missing {name}", f"Provide '{name}' as string")
    return value


# ── tools ────────────────────────────────────────────────────────────────────


def _tree(ws: Workspace, args: dict) -> Iterator[str]:
    include = args.get("include", [])
    if isinstance(include, str):
        include = [include]
    if not isinstance(include, list):
        raise ToolError("INVALID_ARGUMENT", "include must be a string or string array")
    if not all(isinstance(item, str) for item in include):
        raise ToolError("INVALID_ARGUMENT", "include array must contain only strings")
    path = _text(args, "path")
    if path is not None:
        if not paths.is_safe_request_path(path):
            raise ToolError("OUT_OF_SCOPE", "path traversal not allowed")
        path = path.strip(" /") or None
        if path is not None:
            _checked_path(path)
    depth, max_nodes = _int(args, "depth"), _int(args, "max_nodes")
    for name, value in (("depth", depth), ("max_nodes", max_nodes)):
        if value is not None and value < 0:
            raise ToolError("INVALID_ARGUMENT", f"{name} must be >= 0")
    sort = _text(args, "sort") or "name"
    if sort not in TREE_SORTS:
        raise ToolError("INVALID_ARGUMENT", "sort must be one of: name, modified, size")
    rows = ws.tree(path, depth, max_nodes, include, sort, _bool(args, "dirs_first", True))
    yield '{"tree":'
    yield from tree.render_json(rows)
    yield "}"


def _outline(ws: Workspace, args: dict) -> Iterator[str]:
    path = _checked_path(_required(args, "path"))
    row = ws.outline(path).select(
        F.to_json(F.struct("path", "language", "line_count", "byte_size", "symbols")).alias("j")
    ).first()
    if row is None:
        raise ToolError("OUT_OF_SCOPE", "path not indexed")
    yield row["j"]


def _search(ws: Workspace, args: dict) -> Iterator[str]:
    query = _required(args, "query")
    path = _text(args, "path")
    if path is not None:
        _checked_path(path)
    try:
        most = _int(args, "max_results")
        hits = ws.search(query, None if most is None else min(most, MAX_RESULTS), _bool(args, "regex"), path)
    except ValueError as exc:
        raise ToolError("REGEX_INVALID", "regex search failed") from exc
    yield '{"matches":['
    yield from json_rows(hits, "path", "line", "text")
    yield "]}"


def _deps(ws: Workspace, args: dict) -> Iterator[str]:
    path = _checked_path(_required(args, "path"))
    yield '{"path":' + dump(path) + ',"imported_by":['
    yield from json_values(ws.imported_by(path).orderBy("path"), "path")
    yield '],"imports":['
    yield from json_values(ws.imports(path), "dep")
    yield "]}"


def _changes(ws: Workspace, args: dict) -> Iterator[str]:
    since = max(0, _int(args, "since") or 0)
    yield '{"current_seq":%d,"changes":[' % ws.current_seq()
    yield from json_rows(ws.changes(since).orderBy("seq"), "path", "op", "seq", "timestamp_ms")
    yield "]}"


_HANDLERS = {
    "tree": _tree,
    "outline": _outline,
    "search": _search,
    "deps": _deps,
    "changes": _changes,
    "index": lambda ws, args: iter([dump(ws.index())]),
    "status": lambda ws, args: iter([dump(ws.status())]),
    "snapshot": lambda ws, args: iter([dump(ws.snapshot(_bool(args, "write")))]),
}


def stream_tool(ws: Workspace, tool: str, args: dict) -> Iterator[str]:
    """Fragments of the payload; argument errors surface before the first one."""
    try:
        yield from _HANDLERS[tool](ws, args)
    except ToolError as exc:
        yield dump(exc.payload)


def call_tool(ws: Workspace, tool: str, args: dict | None = None) -> str:
    return "".join(stream_tool(ws, tool, args or {}))


_STR, _INT, _BOOL = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}


def _schema(properties: dict, required: tuple = ()) -> dict:
    return {"type": "object", "properties": properties, "required": list(required)}


def tool_list() -> dict:
    one_or_many = {"oneOf": [_STR, {"type": "array", "items": _STR}]}
    schemas = {
        "tree": _schema({
            "path": _STR, "depth": _INT, "max_nodes": _INT, "include": one_or_many,
            "sort": {"type": "string", "enum": list(TREE_SORTS)}, "dirs_first": _BOOL,
        }),
        "outline": _schema({"path": _STR}, ("path",)),
        "search": _schema({"query": _STR, "max_results": _INT, "regex": _BOOL, "path": _STR}, ("query",)),
        "deps": _schema({"path": _STR}, ("path",)),
        "index": _schema({}),
        "status": _schema({}),
        "snapshot": _schema({"write": _BOOL}),
        "changes": _schema({"since": _INT}),
    }
    return {"tools": [{"name": name, "inputSchema": schemas[name]} for name in TOOLS]}


def handle_message(ws: Workspace, line: str) -> str | None:
    """Answer to one JSON-RPC message as a single line; None for notifications."""
    try:
        message = json.loads(line)
    except ValueError:
        return _error(None, -32700, "Parse error")
    if not isinstance(message, dict):
        return _error(None, -32600, "Invalid Request")
    known, ident = "id" in message, message.get("id")
    method = message.get("method")
    if not isinstance(method, str):
        return _error(ident, -32600, "Invalid Request") if known else None
    if not known or method == "notifications/initialized":
        return None
    if method == "initialize":
        info = {"name": "treelode", "version": "0.1.0"}
        caps = {"tools": {"listChanged": False}}
        return _result(ident, {"protocolVersion": PROTOCOL, "capabilities": caps, "serverInfo": info})
    if method == "tools/list":
        return _result(ident, tool_list())
    if method == "ping":
        return _result(ident, {})
    if method != "tools/call":
        return _error(ident, -32601, "Method not found")
    params = message.get("params")
    if "params" not in message:
        return _error(ident, -32602, "Missing params")
    if not isinstance(params, dict):
        return _error(ident, -32602, "params must be object")
    if not isinstance(params.get("name"), str):
        return _error(ident, -32602, "Missing tool name")
    if params["name"] not in TOOLS:
        return _error(ident, -32602, "Unknown tool")
    args = params.get("arguments", params)
    if not isinstance(args, dict):
        return _error(ident, -32602, "arguments must be object")
    try:
        text = call_tool(ws, params["name"], args)
    except Exception:  # noqa: BLE001
        return _error(ident, -32603, "Internal error")
    is_error = "error" in json.loads(text)
    return _result(ident, {"content": [{"type": "text", "text": text}], "isError": is_error})


def _result(ident, result) -> str:
    return dump({"jsonrpc": "2.0", "id": ident, "result": result})


def _error(ident, code: int, message: str) -> str:
    return dump({"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}})

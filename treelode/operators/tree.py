"""Hierarchical listing: directory nodes, filters, sibling order, limits."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelode.functions import paths
from treelode.schema import TREE_SORTS

_FAR = 9223372036854775807


def nodes(
    stats: DataFrame,
    base: str | None = None,
    depth: int | None = None,
    include=(),
    sort: str = "name",
    dirs_first: bool = True,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Files that pass the filters plus the directories above them.

    ``stats`` has path, line_count, symbol_count, byte_size and optionally mtime_ns and
    ``dir_mtimes`` (one entry per ancestor directory, outermost first).
    Directories take a second pass over the same files; ``listed`` may give their paths (and
    ``dir_mtimes``) from where they cost less than in ``stats``.
    Result: full_path, depth (relative to the base), level (nesting), is_dir,
    line_count, symbol_count, byte_size, modified_ns, sort_key.
    """
    if sort not in TREE_SORTS:
        raise ValueError("sort must be one of: " + ", ".join(TREE_SORTS))
    base = (base or "").strip(" /")
    path = F.col("path")

    def shown(rows):
        for name, default in (("mtime_ns", "cast(0 as bigint)"), ("dir_mtimes", "cast(array() as array<bigint>)")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.expr(default))
        return passing(rows, base, depth, include)

    files, above = shown(stats), shown(stats if listed is None else listed)

    # A file yields its own node, which nothing else yields, and one per directory above it.
    # Directories repeat for every file below them and are folded map-side, so a huge directory
    # shuffles one row per task; files are not grouped at all.
    parts = F.split("path", "/")
    n_dirs = F.size(parts) - 1
    by_time = sort == "modified"

    def node(full_path, is_dir, line_count, symbol_count, byte_size, modified, mtimes):
        fields = [
            full_path.alias("full_path"), F.lit(is_dir).alias("is_dir"), line_count.cast("int").alias("line_count"),
            symbol_count.cast("bigint").alias("symbol_count"), byte_size.cast("bigint").alias("byte_size"),
            F.coalesce(modified, F.lit(0)).cast("bigint").alias("modified_ns"),
        ]
        return F.struct(*fields, *([mtimes.alias("mtimes")] if by_time else []))

    zero = F.lit(0)
    leaf = node(
        path, False, F.col("line_count"), F.col("symbol_count"), F.col("byte_size"), F.col("mtime_ns"),
        F.slice("dir_mtimes", F.lit(1), n_dirs),
    )
    folders = F.transform(
        F.when(n_dirs > 0, F.sequence(F.lit(1), n_dirs)).otherwise(F.array().cast("array<int>")),
        lambda n: node(
            F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")), True, zero, zero, zero,
            F.get("dir_mtimes", n - 1), F.slice("dir_mtimes", F.lit(1), n),
        ),
    )
    measures = ["line_count", "symbol_count", "byte_size", "modified_ns"] + (["mtimes"] if by_time else [])
    above_files = (
        above.select(F.explode(folders).alias("n")).select("n.*")
        .groupBy("full_path", "is_dir").agg(*[F.max(m).alias(m) for m in measures])
    )
    found = (
        files.select(leaf.alias("n")).select("n.full_path", "n.is_dir", *(f"n.{m}" for m in measures)).unionByName(above_files)
        .withColumn("bare", F.rtrim("full_path", F.lit("/")))
        .filter(paths.matches_base(F.col("bare"), base))
    )
    names = F.split("bare", "/")
    last = F.size(names) - 1
    time_at = (lambda i: F.coalesce(F.get("mtimes", i), F.lit(0))) if by_time else (lambda i: zero)

    def component(name, i):
        folder = _component(name, True, zero, time_at(i), sort, dirs_first)
        own = _component(name, False, F.col("byte_size"), F.col("modified_ns"), sort, dirs_first)
        return F.when((i < last) | F.col("is_dir"), folder).otherwise(own)

    outside = base.count("/") if base else 0
    return found.select(
        "full_path",
        _slashes(paths.relative_to(F.col("bare"), base)).alias("depth"),
        (last - F.lit(outside)).alias("level"),
        "is_dir", "line_count", "symbol_count", "byte_size", "modified_ns",
        F.transform(names, component).alias("sort_key"),
    )


def passing(files: DataFrame, base: str | None = None, depth: int | None = None, include=()) -> DataFrame:
    """The files a tree with these filters shows; asked of texts, others need not be parsed."""
    base = (base or "").strip(" /")
    path = F.col("path")
    rel = paths.relative_to(path, base)
    return (
        files.filter(paths.matches_base(path, base))
        .filter(F.lit(True) if depth is None else _slashes(rel) <= depth)
        .filter(paths.matches_any_include(path, rel, list(include or ())))
    )


def _slashes(rel: Column) -> Column:
    return F.length(rel) - F.length(F.replace(rel, F.lit("/"), F.lit("")))


def _component(name: Column, is_dir: bool, size: Column, mtime: Column, sort: str, dirs_first: bool) -> Column:
    """Sortable text of one path component among its siblings."""
    group = F.lit(("0" if is_dir else "1") if dirs_first else "0")
    if sort == "name":
        return F.concat(group, name, F.lit("/" if is_dir and not dirs_first else ""))
    value = mtime if sort == "modified" else size
    newest_first = F.lpad((F.lit(_FAR) - value).cast("string"), 19, "0")
    return F.concat(group, newest_first, name)


def ordered(tree: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Depth-first listing order; with a limit this is a top-k, not a global sort."""
    out = tree.orderBy("sort_key")
    return out if max_nodes is None else out.limit(max_nodes)


def label(is_dir: Column, full_path: Column, line_count: Column, symbol_count: Column) -> Column:
    name = F.element_at(F.split(F.rtrim(full_path, F.lit("/")), "/"), -1)
    return F.when(is_dir, F.concat(name, F.lit("/"))).otherwise(
        F.format_string("%s  %dL  %d sym", name, line_count, symbol_count)
    )


def labelled(tree: DataFrame) -> DataFrame:
    return tree.select(
        "*", label(F.col("is_dir"), F.col("full_path"), F.col("line_count"), F.col("symbol_count")).alias("text")
    )


def render_json(rows: DataFrame) -> Iterator[str]:
    """Nested arrays, streamed partition by partition in listing order.

    ``["src/",["main.py  3L  1 sym"]]``: a directory is followed by its children.
    """
    level, first = 0, True
    yield "["
    for row in labelled(rows).select("level", "is_dir", "text").toLocalIterator():
        while level > row["level"]:
            yield "]"
            level -= 1
            first = False
        yield ("" if first else ",") + json.dumps(row["text"], ensure_ascii=False)
        first = False
        if row["is_dir"]:
            yield ",["
            level, first = row["level"] + 1, True
    yield "]" * (level + 1)

"""Byte-faithful text expressions used by every operator."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENT = "[A-Za-z0-9_]+"


def fold(col: Column) -> Column:
    """Lower-case ASCII letters only; every other byte is left alone."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def fold_literal(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def contains_fold(col: Column, query: str) -> Column:
    """ASCII-case-insensitive substring test.

    Java's ``(?i)`` without ``UNICODE_CASE`` folds exactly A-Z, and the pattern is
    matched in one pass without building a folded copy of the text.
    """
    if not query:
        return F.lit(True)
    if not re.search("[A-Za-z]", query):
        return F.contains(col, F.lit(query))
    return col.rlike("(?i)" + quote_java(query))


def quote_java(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def sql_text(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_map(values: dict[str, str]) -> str:
    """SQL map literal; a large constant crosses to the JVM as one piece of text."""
    return "map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in values.items()) + ")"


def trim_blank(col: Column) -> Column:
    """Trim spaces and tabs only (carriage returns stay)."""
    return F.trim(col, F.lit(" \t"))


def ltrim_blank(col: Column) -> Column:
    return F.ltrim(col, F.lit(" \t"))


def rtrim_blank(col: Column) -> Column:
    return F.rtrim(col, F.lit(" \t"))


def starts_any(col: Column, prefixes) -> Column:
    cond = F.lit(False)
    for prefix in prefixes:
        cond = cond | F.startswith(col, F.lit(prefix))
    return cond


def ends_any(col: Column, suffixes) -> Column:
    cond = F.lit(False)
    for suffix in suffixes:
        cond = cond | F.endswith(col, F.lit(suffix))
    return cond


def contains_any(col: Column, needles) -> Column:
    cond = F.lit(False)
    for needle in needles:
        cond = cond | F.contains(col, F.lit(needle))
    return cond


def null_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


def ident_after_token(col: Column, token: str) -> Column:
    """Identifier right after the *first* occurrence of ``token``, else null."""
    pattern = "(?s)\\A(?>.*?%s)(%s)" % (quote_java(token), IDENT)
    return null_if_empty(F.regexp_extract(col, pattern, 1))


def after_first(col: Column, token: str) -> Column:
    """Text after the first occurrence of ``token`` (callers check it occurs)."""
    return F.substring(col, F.locate(token, col) + F.lit(len(token)), F.length(col))


def string_literal(col: Column) -> Column:
    """First double-quoted literal anywhere, else the first single-quoted one."""
    double = F.regexp_extract(col, '"([^"]*)"', 1)
    single = F.regexp_extract(col, "'([^']*)'", 1)
    return F.when(col.rlike('"[^"]*"'), double).when(col.rlike("'[^']*'"), single)


def python_module(line: Column) -> Column:
    """Dotted module of an absolute Python import; null when relative."""
    rest_from = ltrim_blank(F.substring(line, F.lit(6), F.length(line)))
    head = rtrim_blank(F.substring_index(rest_from, " import", 1))
    from_mod = F.when(
        ~F.startswith(rest_from, F.lit(".")) & F.contains(rest_from, F.lit(" import")),
        null_if_empty(head),
    )
    rest_import = ltrim_blank(F.substring(line, F.lit(8), F.length(line)))
    import_mod = null_if_empty(F.regexp_extract(rest_import, "\\A([^ ,\t]+)", 1))
    return F.when(F.startswith(line, F.lit("from ")), from_mod).when(
        F.startswith(line, F.lit("import ")), import_mod
    )


def python_module_path(module: Column) -> Column:
    """``a.b`` to ``a/b.py``."""
    return F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))


def php_strip_alias(col: Column) -> Column:
    return F.regexp_replace(col, "(?s) [aA][sS] .*\\z", "")


def php_namespace_path(ns: Column) -> Column:
    """``App\\Models\\User`` to ``app/Models/User.php``."""
    first = F.substring_index(ns, "\\", 1)
    rest = F.substring(ns, F.length(first) + F.lit(1), F.length(ns))
    joined = F.concat(fold(first), F.replace(rest, F.lit("\\"), F.lit("/")))
    return F.concat(F.ltrim(joined, F.lit("/")), F.lit(".php"))


def line_count(col: Column) -> Column:
    """Number of newlines plus one (a trailing newline opens an empty line)."""
    return (F.octet_length(col) - F.octet_length(F.replace(col, F.lit("\n"), F.lit(""))) + 1).cast("int")

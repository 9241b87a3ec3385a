"""Path predicates: globs, base paths, language, skip lists, sensitive files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from treelode.functions.text import contains_any, ends_any, sql_map, starts_any

# File suffixes per language, tested in this order.
LANGUAGE_SUFFIXES = (
    ("zig", (".zig",)),
    ("c", (".c", ".h")),
    ("cpp", (".cpp", ".hpp")),
    ("python", (".py",)),
    ("javascript", (".js", ".jsx")),
    ("typescript", (".ts", ".tsx")),
    ("rust", (".rs",)),
    ("go_lang", (".go",)),
    ("php", (".php",)),
    ("ruby", (".rb", ".rake")),
    ("markdown", (".md",)),
    ("json", (".json",)),
    ("yaml", (".yaml", ".yml")),
)

# Directory names that are never entered.
SKIP_DIRS = (
    ".git", ".claude", "node_modules", ".zig-cache", "zig-out", ".next", ".nuxt",
    ".svelte-kit", "dist", "build", ".build", ".output", "out", "__pycache__", ".venv",
    "venv", ".env", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target",
    ".gradle", ".idea", ".vs", "vendor", "Pods", ".dart_tool", ".pub-cache", "coverage",
    ".nyc_output", ".turbo", ".parcel-cache", ".cache", ".tmp", ".temp", ".DS_Store",
    "bundle", ".bundle", ".swc", ".terraform", ".serverless", "elm-stuff", ".stack-work",
    ".cabal-sandbox", ".cargo", "bower_components",
)
# The engine's own state directory is skipped too.
STATE_DIR = ".treelode"
SKIP_DIRS = SKIP_DIRS + (STATE_DIR,)

# File suffixes that are never indexed.
SKIP_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".icns", ".webp", ".svg", ".ttf",
    ".otf", ".woff", ".woff2", ".eot", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".pptx", ".mp3", ".mp4", ".wav", ".avi",
    ".mov", ".flv", ".ogg", ".webm", ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".lib",
    ".wasm", ".pyc", ".pyo", ".class", ".db", ".sqlite", ".sqlite3", ".lock", ".sum",
    ".min.js", ".min.css", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "composer.lock", ".DS_Store",
)

# Base names, suffixes and directories that may hold secrets.
SENSITIVE_NAMES = (
    ".dev.vars", ".npmrc", ".pypirc", ".netrc", "credentials.json", "service-account.json",
    "secrets.json", "secrets.yaml", "secrets.yml", "id_rsa", "id_ed25519",
)
SENSITIVE_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".jks")
SENSITIVE_DIRS = (".ssh/", ".gnupg/", ".aws/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def glob_body(pattern: str, star: str = ".*") -> str:
    """Regex body of a glob: runs of ``*`` match anything, all else is literal."""
    return "".join(star if part.startswith("*") else _quote(part) for part in re.findall(r"\*+|[^*]+", pattern))


def _quote(text: str) -> str:
    # Escapes valid both in java.util.regex and in Python's re.
    return "".join(ch if ch.isalnum() or ch in "_/" or ord(ch) > 127 else "\\" + ch for ch in text)


def glob_match(col: Column, pattern: str) -> Column:
    return col.rlike("(?s)\\A(?:%s)\\z" % glob_body(pattern))


def matches_base(path: Column, base: str) -> Column:
    if not base:
        return F.lit(True)
    return (path == base) | F.startswith(path, F.lit(base + "/"))


def relative_to(path: Column, base: str) -> Column:
    if not base:
        return path
    return F.when(path == base, F.lit("")).otherwise(F.substring(path, F.lit(len(base) + 2), F.length(path)))


def matches_any_include(path: Column, rel: Column, patterns) -> Column:
    """Globs with a slash test the path (relative or full); others the base name."""
    if not patterns:
        return F.lit(True)
    cond = F.lit(False)
    for pattern in patterns:
        if not pattern:
            continue
        if "/" in pattern:
            cond = cond | glob_match(rel, pattern) | glob_match(path, pattern)
        else:
            cond = cond | glob_match(basename(rel), pattern) | glob_match(basename(path), pattern)
    return cond


def language(path: Column) -> Column:
    """Language by suffix.  Every suffix is one dot and a name, so the text from the last
    dot on decides."""
    by_suffix = {suffix: name for name, suffixes in LANGUAGE_SUFFIXES for suffix in suffixes}
    found = F.try_element_at(F.expr(sql_map(by_suffix)), F.regexp_extract(path, r"\.[^.]*\z", 0))
    return F.coalesce(found, F.lit("unknown"))


def has_skip_dir(path: Column) -> Column:
    """True when any component of the path is on the directory skip list."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in SKIP_DIRS]))


def is_sensitive(path: Column) -> Column:
    name = basename(path)
    return (
        starts_any(name, [".env"])
        | name.isin(*SENSITIVE_NAMES)
        | ends_any(name, SENSITIVE_SUFFIXES)
        | contains_any(path, SENSITIVE_DIRS)
    )


def is_sensitive_literal(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    return (
        name.startswith(".env")
        or name in SENSITIVE_NAMES
        or name.endswith(SENSITIVE_SUFFIXES)
        or any(part in path for part in SENSITIVE_DIRS)
    )


def is_skipped_file(path: Column) -> Column:
    return ends_any(path, SKIP_SUFFIXES) | is_sensitive(path)


def is_safe_request_path(path: str) -> bool:
    """Relative, no parent traversal, no backslash."""
    return not (
        path == ""
        or path.startswith("/")
        or "../" in path
        or path == ".."
        or path.endswith("/..")
        or "\\" in path
    )


def is_safe_request(path: Column) -> Column:
    """The same rule as a Column."""
    return ~path.rlike(r"\A\z|\A/|\.\./|\A\.\.\z|/\.\.\z|\\")


def is_indexable_root(path: str) -> bool:
    """Refuse file-system roots, temporary trees and bare home directories."""
    if path in ("", "/", "/root"):
        return False
    for banned in ("/private/tmp", "/tmp", "/var/tmp"):
        if path == banned or path.startswith(banned + "/"):
            return False
    for homes in ("/home/", "/Users/"):
        if path.startswith(homes):
            rest = path[len(homes):]
            if rest and "/" not in rest:
                return False
    return True


def dir_prefixes(path: Column) -> Column:
    """Every ancestor directory of a file path, outermost first, no trailing slash."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))

"""Fuzzy path score: local alignment with affine gaps and position bonuses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the score.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 16.0, -8.0, -3.0, -1.0
DELIMITER, FILENAME, CONSECUTIVE, CASE, PREFIX = 8.0, 6.0, 4.0, 2.0, 6.0
THRESHOLD, ENTRY_BONUS = 0.3, 0.05
#: Cells of the alignment that one step holds: paths are taken in groups of similar length.
CELLS = 1 << 22

# File names that mark an entry point.
ENTRY_POINTS = (
    "main.zig", "lib.zig", "root.zig", "main.rs", "lib.rs", "mod.rs", "main.go", "main.c",
    "main.cpp", "index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs", "index.cjs",
    "index.vue", "index.php", "main.rb", "index.rb", "__init__.py", "__main__.py",
    "Makefile", "build.zig", "Cargo.toml", "package.json",
)

f32 = np.float32


def score_batch(query: str, values: list[str]) -> np.ndarray:
    """Scores of many paths at once; NaN where a path does not match."""
    q = query.encode("utf-8", "surrogateescape")
    raw = [v.encode("utf-8", "surrogateescape") for v in values]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    out = np.full(len(raw), np.nan, dtype=f32)
    if not q:
        return out
    rows = np.argsort(size, kind="stable")
    rows = rows[size[rows] > 0]
    while len(rows):
        # The longest path of a group sets its width.
        fits = int(np.searchsorted(size[rows] * np.arange(1, len(rows) + 1), CELLS, side="right"))
        group, rows = rows[: max(1, fits)], rows[max(1, fits) :]
        out[group] = _aligned(q, [raw[i] for i in group])
    return out


def _aligned(q: bytes, raw: list[bytes]) -> np.ndarray:
    """The alignment walks query and path positions one by one, and every step is a vector
    operation over all paths of the group."""
    size = np.array([len(r) for r in raw], dtype=np.int64)
    rows = np.arange(len(raw))
    width = int(size.max())
    joined = b"".join(r.ljust(width, b"\0") for r in raw)
    chars = np.frombuffer(joined, np.uint8).reshape(len(rows), width).T  # one row per position
    lower = np.where((chars >= 65) & (chars <= 90), chars + 32, chars)
    fname = np.array([raw[i].rfind(b"/") + 1 for i in rows])

    position = np.arange(width)[:, None]
    inside = position < size
    before = np.vstack([np.zeros((1, len(rows)), np.uint8), chars[:-1]])
    boundary = (position == 0) | np.isin(before, np.frombuffer(b"/_-.\\", np.uint8))
    place = (
        f32(MATCH) + boundary * f32(DELIMITER) + (position >= fname) * f32(FILENAME)
        + ((position == 0) | (position == fname)) * f32(PREFIX)
    ).astype(f32)

    prev = np.zeros((width + 1, len(rows)), f32)
    gap_up = np.full((width + 1, len(rows)), GAP_OPEN, f32)
    matched = np.zeros(len(rows), np.int64)
    best = np.zeros(len(rows), f32)
    for i, ch in enumerate(q):
        low = ch + 32 if 65 <= ch <= 90 else ch
        same = lower == low
        bonus = place + (chars == ch) * f32(CASE)
        if i > 0:
            run = prev[:-1] > prev[1:] * f32(0.5)
            run[0] = False
            bonus = bonus + run * f32(CONSECUTIVE)
        diag = prev[:-1] + np.where(same, bonus, f32(MISMATCH))
        gap_up[1:] = np.maximum(prev[1:] + f32(GAP_OPEN), gap_up[1:] + f32(GAP_EXTEND))
        floor = np.maximum(np.maximum(diag, gap_up[1:]), f32(0))
        cur = np.zeros_like(prev)
        gap_left = np.full(len(rows), GAP_OPEN, f32)
        for j in range(width):
            gap_left = np.maximum(cur[j] + f32(GAP_OPEN), gap_left + f32(GAP_EXTEND))
            cur[j + 1] = np.maximum(floor[j], gap_left)
        alive = np.where(inside, cur[1:], f32(0))
        matched[(alive > 0).any(axis=0)] = i + 1
        if i == len(q) - 1:
            best = alive.max(axis=0)
        prev = cur
    good = (best > 0) & (matched >= (len(q) + 1) // 2) & (best >= f32(len(q)) * f32(MATCH) * f32(THRESHOLD))
    entry = np.array([raw[i][raw[i].rfind(b"/") + 1:].decode("utf-8", "replace") in ENTRY_POINTS for i in rows])
    best = np.where(entry, best + best * f32(ENTRY_BONUS), best).astype(f32)
    return np.where(good, best / np.sqrt(size.astype(f32)), f32(np.nan))


def score(path: Column, query: str) -> Column:
    """FLOAT score of ``path`` for one query part; null when it does not match."""

    @F.pandas_udf("float")
    def udf(values: pd.Series) -> pd.Series:
        found = score_batch(query, values.fillna("").tolist())
        return pd.Series(found, index=values.index).astype(object).where(~np.isnan(found), None)

    return udf(path)


def parse_query(query: str) -> tuple[list[str], str | None]:
    """Space-separated parts and the extension of the last ``*.ext`` token."""
    parts, ext = [], None
    for token in query.split(" "):
        if token.startswith("*.") and len(token) >= 2:
            ext = token[1:]
        elif token:
            parts.append(token)
    return parts, ext

"""Line search: substring, dialect regex, index-pruned, and result limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelode.functions import fuzzy, paths, regex
from treelode.functions.text import contains_fold
from treelode.operators import trigrams
from treelode.operators.lines import lines

DEFAULT_RESULTS = 50


def clamp_results(n: int | None) -> int:
    return DEFAULT_RESULTS if n is None else max(1, n)


def search_substring(files: DataFrame, query: str, path: str | None = None) -> DataFrame:
    """Lines that contain ``query``, ASCII case ignored; the empty query matches all.

    Whole texts are tested first, so files without a hit are never split into lines.
    """
    files = _scoped(files, path)
    if "\n" in query:
        return _result(lines(files.filter(F.lit(False))))
    if query:
        files = files.filter(contains_fold(F.col("text"), query))
    return _result(lines(files).filter(contains_fold(F.col("line"), query)))


def search_regex(files: DataFrame, pattern: str, path: str | None = None) -> DataFrame:
    """Lines in which the pattern occurs, case-sensitively; whole texts are tested first."""
    files = _scoped(files, path).filter(regex.rlike(F.col("text"), pattern, whole=True))
    return _result(lines(files).filter(regex.rlike(F.col("line"), pattern)))


def search_indexed(
    files: DataFrame, postings: DataFrame, query: str, is_regex: bool = False, path: str | None = None
) -> DataFrame:
    """Same rows as a full scan, read only from the files the trigram index allows.

    ``files`` and ``postings`` share the column ``doc_id``.  The files meet the candidates in
    a semi-join, which Spark broadcasts while the answer is small; a query without trigrams
    scans every file.
    """
    grams = regex.decompose(query) if is_regex else regex.TrigramQuery(tuple(regex.literal_trigrams(query)))
    if grams.prunes:
        files = files.join(trigrams.candidates_query(postings, grams), "doc_id", "left_semi")
    return search_regex(files, query, path) if is_regex else search_substring(files, query, path)


def top_results(hits: DataFrame, max_results: int | None = None) -> DataFrame:
    """First results in (path, line) order; a per-partition top-k, not a global sort."""
    return hits.orderBy("path", "line").limit(clamp_results(max_results))


def _scoped(files: DataFrame, path: str | None) -> DataFrame:
    if not path:
        return files
    return files.filter(paths.matches_base(F.col("path"), path.strip(" /")))


def _result(hits: DataFrame) -> DataFrame:
    return hits.select("path", F.col("line_num").alias("line"), F.col("line").alias("text"))


def fuzzy_paths(files: DataFrame, query: str) -> DataFrame:
    """Paths every part of the query matches, with the summed score.

    The extension is tested before any path is handed to the score.
    """
    parts, ext = fuzzy.parse_query(query)
    named = files.select("path").filter(F.octet_length("path") > 0)
    if ext is not None:
        named = named.filter(F.endswith("path", F.lit(ext)))
    if not parts:
        return named.select("path", F.lit(0).cast("float").alias("score")).filter(F.lit(False))
    scored = named.select("path", *[fuzzy.score(F.col("path"), p).alias(f"s{i}") for i, p in enumerate(parts)])
    total = F.col("s0")
    for i in range(1, len(parts)):
        total = (total + F.col(f"s{i}")).cast("float")
    return scored.select("path", total.alias("score")).filter("score > 0")


def fuzzy_top(files: DataFrame, query: str, max_results: int) -> DataFrame:
    return fuzzy_paths(files, query).orderBy(F.col("score").desc(), "path").limit(max_results)

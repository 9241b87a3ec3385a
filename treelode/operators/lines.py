"""Lines of a corpus: explode, ranges, comment filtering, per-file statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelode.functions import paths
from treelode.functions.text import line_count, starts_any, trim_blank


def lines(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per line, numbered from 1; a trailing newline yields a last empty line."""
    return files.select(*keep, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select(
        *keep, (F.col("pos") + 1).alias("line_num"), "line"
    )


def file_stats(files: DataFrame) -> DataFrame:
    return files.select(
        "path",
        paths.language(F.col("path")).alias("language"),
        line_count(F.col("text")).alias("line_count"),
        F.octet_length("text").cast("bigint").alias("byte_size"),
    )


def is_comment_or_blank(line: Column, lang: Column) -> Column:
    body = trim_blank(line)
    return (
        (body == "")
        | (lang.isin("zig", "rust", "go_lang") & F.startswith(body, F.lit("//")))
        | (lang.isin("python", "ruby") & F.startswith(body, F.lit("#")))
        | (lang.isin("javascript", "typescript", "c", "cpp") & starts_any(body, ["//", "/*", "*"]))
    )


def extract_lines(
    files: DataFrame, start: int, end: int, line_numbers: bool = True, compact: bool = False
) -> DataFrame:
    """Lines ``start..end`` (1-based, inclusive) of every file in ``files``."""
    out = lines(files).filter(F.col("line_num").between(start, end))
    if compact:
        out = out.filter(~is_comment_or_blank(F.col("line"), paths.language(F.col("path"))))
    if line_numbers:
        number = F.col("line_num").cast("string")
        padded = F.when(F.length(number) < 5, F.lpad(number, 5, " ")).otherwise(number)
        out = out.withColumn("line", F.concat(padded, F.lit(" | "), F.col("line")))
    return out


def symbol_bodies(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Numbered source of ``ranges(path, line_start, line_end)``.

    The ranges of a file are gathered first, so its text meets them in one row and is split
    once, however many symbols it has.  They are as many rows as there are files, whatever size
    Spark expects of them (rows that a plan makes are not in its estimate), so neither side is
    ever sent to the driver.
    """
    wanted = ranges.groupBy("path").agg(F.collect_list(F.struct("line_start", "line_end")).alias("ranges"))

    def body(span: Column) -> Column:
        first = F.greatest(span["line_start"], F.lit(1))
        count = F.greatest(span["line_end"] - first + 1, F.lit(0))
        numbered = F.transform(
            F.slice("parts", first, count),
            lambda line, i: F.concat(F.format_string("%5d | ", i + first), line, F.lit("\n")),
        )
        return F.struct(span["line_start"].alias("line_start"), span["line_end"].alias("line_end"), F.array_join(numbered, "").alias("body"))

    cut = files.join(wanted.hint("merge"), "path").select("path", "ranges", F.split("text", "\n", -1).alias("parts"))
    return cut.select("path", F.explode(F.transform("ranges", body)).alias("b")).select("path", "b.*")

"""Import graph: one-hop forward and reverse lookups over raw import strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelode.functions.paths import basename
from treelode.session import cut_lineage


def edges(decls: DataFrame) -> DataFrame:
    """(path, dep, pos): raw imports in file order, without parent traversal."""
    raw = decls.filter(F.size("imports") > 0).select(
        "path", "line_num", "ord", F.posexplode("imports").alias("item", "dep")
    )
    kept = raw.filter(~F.contains("dep", F.lit("..")))
    in_file = Window.partitionBy("path").orderBy("line_num", "ord", "item")
    return kept.select("path", "dep", (F.row_number().over(in_file) - 1).alias("pos"))


def imports_of(deps: DataFrame, path: str) -> DataFrame:
    """What one file imports, in order, duplicates kept."""
    return deps.filter(F.col("path") == path).orderBy("pos").select("dep")


def imported_by(deps: DataFrame, path: str) -> DataFrame:
    """Files that import a path, named in full or by its base name."""
    return deps.filter(F.col("dep").isin(path, path.rsplit("/", 1)[-1])).select("path").distinct()


def imported_by_all(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(path, importer) for every file at once.

    Each path offers two keys, itself and its base name, and meets the distinct edges
    in one equi-join; a popular import is split by the adaptive skew join.  A pair that
    matches under both keys is reported once.
    """
    offered = files.select("path", F.explode(F.array_distinct(F.array("path", basename(F.col("path"))))).alias("dep"))
    distinct_edges = deps.select(F.col("path").alias("importer"), "dep").distinct()
    # Only a file that imports both spellings can match twice.
    return offered.join(distinct_edges, "dep").select("path", "importer").distinct()


def factored(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(dep, side, path): under each import string its importers and the files it may name.

    It says the same as ``imported_by_all`` in as many rows as there are edges and files, however
    popular an import is; ``expand`` makes pairs of it for the paths that are asked for.
    """
    keys = F.array_distinct(F.array("path", basename(F.col("path"))))
    named = files.select(F.explode(keys).alias("dep"), F.lit("file").alias("side"), "path")
    # Strings that only one side knows lead nowhere.  What is left is kept, so that files are parsed once.
    importers = deps.select("dep", F.lit("importer").alias("side"), "path").join(named.select("dep").distinct(), "dep", "left_semi")
    both = cut_lineage(importers.distinct())
    return both.unionByName(named.join(both.select("dep").distinct(), "dep", "left_semi"))


def expand(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, importer) of the asked paths, out of the factored form."""
    wanted = pairs.where("side = 'file'").join(asked.select("path").distinct(), "path", "left_semi").select("dep", "path")
    importers = pairs.where("side = 'importer'").select("dep", F.col("path").alias("importer"))
    return wanted.join(importers, "dep").select("path", "importer").distinct()


def importer_counts(deps: DataFrame) -> DataFrame:
    """Distinct importing files per raw import string."""
    return deps.select("path", "dep").distinct().groupBy("dep").agg(F.count(F.lit(1)).alias("importers"))

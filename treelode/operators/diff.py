"""Change detection between a known state and a fresh listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(known: DataFrame, listing: DataFrame) -> DataFrame:
    """Full outer join on path, classified as created / modified / deleted / unchanged.

    ``known`` and ``listing`` have path, mtime_ms, size and hash (null where not yet
    computed).  Equal mtime means unchanged; another size means modified; the same size
    with another mtime is decided by the content hash, and only two known, equal, non-zero
    hashes count as unchanged.
    """
    old, new = known.alias("old"), listing.alias("new")
    same_bytes = (
        (F.col("old.size") == F.col("new.size"))
        & (F.coalesce("old.hash", F.lit(0)) != 0)
        & (F.coalesce("new.hash", F.lit(0)) != 0)
        & (F.col("old.hash") == F.col("new.hash"))
    )
    change = (
        F.when(F.col("old.path").isNull(), "created")
        .when(F.col("new.path").isNull(), "deleted")
        .when(F.col("old.mtime_ms") == F.col("new.mtime_ms"), "unchanged")
        .when(same_bytes, "unchanged")
        .otherwise("modified")
    )
    return old.join(new, F.col("old.path") == F.col("new.path"), "full_outer").select(
        F.coalesce("old.path", "new.path").alias("path"),
        change.alias("change"),
        F.col("new.mtime_ms").alias("mtime_ms"),
        F.col("new.size").alias("size"),
        F.coalesce("new.hash", F.when(change == "unchanged", F.col("old.hash"))).alias("hash"),
    )


def needs_hash(known: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths whose content must be read: mtime moved, size did not, old hash known."""
    return listing.join(
        known.select("path", F.col("mtime_ms").alias("_m"), F.col("size").alias("_s"), F.col("hash").alias("_h")), "path"
    ).filter((F.col("mtime_ms") != F.col("_m")) & (F.col("size") == F.col("_s")) & (F.coalesce("_h", F.lit(0)) != 0)).select("path")


def to_versions(changes: DataFrame) -> DataFrame:
    """Version entries (not yet numbered) of the rows that changed."""
    gone = F.col("change") == "deleted"
    return changes.filter(F.col("change") != "unchanged").select(
        "path",
        F.lit(0).cast("bigint").alias("agent"),
        F.unix_millis(F.current_timestamp()).alias("timestamp_ms"),
        F.when(gone, "tombstone").otherwise("snapshot").alias("op"),
        F.when(gone, 0).otherwise(F.coalesce("hash", F.lit(0))).cast("bigint").alias("hash"),
        F.when(gone, 0).otherwise(F.coalesce("size", F.lit(0))).cast("bigint").alias("size"),
        F.lit(None).cast("binary").alias("data"),
    )

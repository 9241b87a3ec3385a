"""Append-only version log: sequence numbers, as-of reads, latest changes, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelode.session import cut_lineage

MAX_VERSIONS = 100


def number_rows(df: DataFrame, order_by: list[str], start: int = 0, name: str = "seq") -> DataFrame:
    """Gap-free global sequence ``start+1, start+2, ...`` in ``order_by`` order.

    Rows are range-partitioned and sorted in parallel; each partition numbers itself
    and is shifted by the row counts of the partitions before it.  Those counts are
    one row per partition, so nothing but that small table is ever gathered.
    ``order_by`` must be a total order, which makes a recomputed task reproducible.
    """
    low_bits = (1 << 33) - 1
    placed = cut_lineage(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_id", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    seq = F.lit(start) + F.col("_offset") + F.col("_id").bitwiseAND(F.lit(low_bits)) + 1
    return numbered.select(*df.columns, seq.cast("bigint").alias(name))


def latest(versions: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """Newest version of each path.

    A first aggregation by (path, op) holds only fixed-width state, so it runs as a hash
    aggregate and folds a hot path inside every map task; the second one then picks the
    winner from at most one row per operation.
    """
    payload = [c for c in (payload or versions.columns) if c not in ("path", "seq", "op")]
    wide = [c for c in payload if dict(versions.dtypes)[c] in ("string", "binary")]
    if wide:
        winner = F.max_by(F.struct("op", *payload), "seq").alias("v")
        return (
            versions.groupBy("path").agg(F.max("seq").alias("seq"), winner)
            .select("path", "seq", "v.op", *[f"v.{c}" for c in payload])
        )
    by_op = versions.groupBy("path", "op").agg(
        F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in payload]
    )
    return (
        by_op.groupBy("path").agg(F.max(F.struct("seq", "op", *payload)).alias("v")).select("path", "v.*")
    )


def changes_since(versions: DataFrame, since: int = 0) -> DataFrame:
    """One row per path changed after ``since``: its latest change."""
    payload = [c for c in ("timestamp_ms", "size") if c in versions.columns]
    recent = versions.filter(F.col("seq") > max(0, since))
    return latest(recent.select("path", "seq", "op", *payload)).select("path", "op", "seq", *payload)


def changes_count(versions: DataFrame, since: int) -> DataFrame:
    return versions.filter(F.col("seq") > since).agg(F.count(F.lit(1)).alias("changes"))


def at_cursor(versions: DataFrame, cursor: int) -> DataFrame:
    """State of each path as of sequence ``cursor``."""
    return latest(versions.filter(F.col("seq") <= cursor))


def current_seq(versions: DataFrame) -> DataFrame:
    return versions.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("bigint").alias("current_seq"))


def list_files(versions: DataFrame) -> DataFrame:
    return versions.select("path").distinct()


def stored_payloads(edits: DataFrame, folder: str) -> DataFrame:
    """Write ``data`` of the edits below ``folder`` in the tasks that hold it, with its place; returns
    the other columns and ``place``, so that no payload is ever shuffled."""
    spark = edits.sparkSession
    marked = edits.withColumn("place", F.monotonically_increasing_id())
    marked.write.parquet(folder)
    return spark.read.schema(marked.schema).parquet(folder).drop("data")


def retained(versions: DataFrame, keep: int | None = MAX_VERSIONS) -> DataFrame:
    """The newest ``keep`` versions of each path; all of them without ``keep``.

    Spark pushes the rank limit below the shuffle, so a path with very many versions
    sends at most ``keep`` rows per map task.
    """
    if keep is None:
        return versions
    newest = Window.partitionBy("path").orderBy(F.col("seq").desc())
    return versions.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= keep).drop("_rank")


def hot_files(tracked: DataFrame, versions: DataFrame, limit: int) -> DataFrame:
    """Tracked paths by latest sequence, newest first; unversioned paths count as 0.

    Tracked paths enter as rows with sequence 0, so one map-side-combined aggregation
    replaces an aggregation and an outer join.
    """
    marks = tracked.select("path", F.lit(True).alias("tracked"), F.lit(0).cast("bigint").alias("seq"))
    log = versions.select("path", F.lit(False).alias("tracked"), "seq")
    return (
        marks.unionByName(log).groupBy("path")
        .agg(F.max("seq").alias("seq"), F.bool_or("tracked").alias("tracked"))
        .filter("tracked").select("path", "seq")
        .orderBy(F.col("seq").desc(), "path").limit(limit)
    )


def append(log_dir: str, entries: DataFrame, start: int, order_by: list[str]) -> DataFrame:
    """Number new entries after ``start`` and append them to the Parquet log."""
    numbered = number_rows(entries, order_by, start)
    numbered.write.mode("append").parquet(log_dir)
    return numbered

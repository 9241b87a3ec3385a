"""Snapshots: the indexed state of a corpus as Parquet sections under one manifest.

Sections are ``tree``, ``outline``, ``content`` and ``freq``; files that may hold secrets are left out of
all of them.  Each lies in a folder of its own that is never written again.  A manifest row names
the folders that belong together, with row counts and digests; the newest finished one counts.  So
a job that dies between two sections leaves the snapshot before it valid.  A section that did not
change keeps its folder, and a second copy moves only sections whose digest differs.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.functions import paths
from treelode.operators import pairs, symbols
from treelode.sources import listing, storage

FORMAT_VERSION = 2
SECTIONS = ("tree", "outline", "content", "freq")
MANIFEST = (
    "format_version INT, root_hash BIGINT, git_head STRING, file_count BIGINT, total_bytes BIGINT, indexed_at BIGINT, "
    "sections ARRAY<STRUCT<name: STRING, folder: STRING, row_count: BIGINT, digest: STRING>>"
)


class SnapshotInvalid(Exception):
    """A snapshot that is absent, truncated, or made for another root."""


def root_hash(spark: SparkSession, root: str) -> int:
    return spark.range(1).select(F.xxhash64(F.lit(root))).first()[0]


def digest_of(df: DataFrame) -> tuple[int, str]:
    """Row count and a digest that depends on the rows, nulls included, and not on their order."""
    row = F.xxhash64(*(F.col(c).isNull() for c in df.columns), *df.columns)
    found = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()
    return found[0], f"{found[1] or 0:x}/{found[2] or 0}"


# ── manifests ────────────────────────────────────────────────────────────────


def _manifest_names(spark: SparkSession, target: str) -> list[str]:
    return [n for n in storage.children(spark, f"{target}/manifest") if n.startswith("m=")]


def read_meta(spark: SparkSession, target: str) -> dict | None:
    """The newest finished manifest."""
    for name in reversed(_manifest_names(spark, target)):
        folder = f"{target}/manifest/{name}"
        if "_SUCCESS" in storage.children(spark, folder):
            return spark.read.schema(MANIFEST).parquet(folder).first().asDict()
    return None


def _publish(spark: SparkSession, target: str, manifest: dict) -> None:
    """Make ``manifest`` the newest; what neither it nor the one before it names is deleted."""
    before = read_meta(spark, target)
    names = _manifest_names(spark, target)
    number = int(names[-1].split("=")[1]) + 1 if names else 0
    row = tuple(manifest[field.split()[0]] for field in MANIFEST.split(", ")[:6]) + (manifest["sections"],)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{target}/manifest/m={number:06d}")
    used = {s["folder"] for m in (manifest, before) if m for s in m["sections"]}
    for section in SECTIONS:
        for folder in storage.children(spark, f"{target}/{section}"):
            if f"{section}/{folder}" not in used:
                storage.delete(spark, f"{target}/{section}/{folder}")
    for name in names[:-1]:
        storage.delete(spark, f"{target}/manifest/{name}")


def _section(meta: dict, name: str) -> dict:
    return next(s.asDict() if hasattr(s, "asDict") else s for s in meta["sections"] if s["name"] == name)


def read_section(spark: SparkSession, target: str, section: str) -> DataFrame:
    if section not in SECTIONS:
        raise ValueError("unknown section: " + section)
    meta = read_meta(spark, target)
    if meta is None:
        raise SnapshotInvalid("no complete snapshot at " + target)
    try:
        return spark.read.parquet(f"{target}/{_section(meta, section)['folder']}")
    except AnalysisException as missing:
        raise SnapshotInvalid(f"section {section} is missing") from missing


# ── writing ──────────────────────────────────────────────────────────────────


def _store(df: DataFrame, target: str, name: str, before: dict | None) -> dict:
    """Write a section, or keep the folder of the last snapshot where that holds the same rows."""
    spark, folder = df.sparkSession, f"{name}/v={uuid.uuid4().hex}"
    df.write.parquet(f"{target}/{folder}")
    count, digest = digest_of(spark.read.schema(df.schema).parquet(f"{target}/{folder}"))
    if before is not None:
        old = _section(before, name)
        if (old["row_count"], old["digest"]) == (count, digest):
            storage.delete(spark, f"{target}/{folder}")
            return old
    return {"name": name, "folder": folder, "row_count": count, "digest": digest}


def write(files: DataFrame, decls: DataFrame, root: str, target: str, git_head: str | None = None) -> dict:
    """Write the sections that changed and publish them; returns the manifest."""
    spark = files.sparkSession
    before = read_meta(spark, target)
    shown = ~paths.is_sensitive(F.col("path"))
    held = {"content": _store(files.where(shown).select("path", "content", "length", "mtime_ns"), target, "content", before)}
    held["outline"] = _store(decls.where(shown), target, "outline", before)
    stored = listing.as_text(spark.read.parquet(f"{target}/{held['content']['folder']}"))
    outline = spark.read.parquet(f"{target}/{held['outline']['folder']}")
    held["tree"] = _store(symbols.symbol_counts(stored, outline), target, "tree", before)
    held["freq"] = _store(pairs.pair_weights(pairs.pair_counts(stored)), target, "freq", before)
    size = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    manifest = {
        "format_version": FORMAT_VERSION, "root_hash": root_hash(spark, root), "git_head": git_head, "file_count": size[0],
        "total_bytes": size[1], "indexed_at": time.time_ns() // 1_000_000, "sections": [held[name] for name in SECTIONS],
    }
    _publish(spark, target, manifest)
    return manifest


def copy_to(spark: SparkSession, target: str, second: str) -> list[str]:
    """Bring the snapshot at ``second`` up to the one at ``target``; returns the sections that moved."""
    meta = read_meta(spark, target)
    if meta is None:
        raise SnapshotInvalid("no complete snapshot at " + target)
    there, moved, sections = read_meta(spark, second), [], []
    for name in SECTIONS:
        own = _section(meta, name)
        old = _section(there, name) if there else None
        if old is None or (old["row_count"], old["digest"]) != (own["row_count"], own["digest"]):
            spark.read.parquet(f"{target}/{own['folder']}").write.mode("overwrite").parquet(f"{second}/{own['folder']}")
            moved.append(name)
            old = own
        sections.append(old)
    _publish(spark, second, {**meta, "sections": sections})
    return moved


def write_dual(files: DataFrame, decls: DataFrame, root: str, target: str, shared_root: str, git_head: str | None = None) -> str:
    """Also keep a copy in a shared folder, keyed by the hash of the root path."""
    write(files, decls, root, target, git_head)
    second = f"{shared_root}/{root_hash(files.sparkSession, root) & (2**64 - 1):x}"
    copy_to(files.sparkSession, target, second)
    return second


def size_and_time(spark: SparkSession, target: str) -> tuple[int, int]:
    """Bytes and newest modification time (ns) of the files of the newest snapshot."""
    folders = [f"{target}/{s['folder']}" for s in read_meta(spark, target)["sections"]]
    row = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
        .agg(F.sum("length").alias("b"), F.max(F.unix_micros("modificationTime")).alias("t")).first()
    )
    return int(row["b"] or 0), int(row["t"] or 0) * 1000


# ── loading ──────────────────────────────────────────────────────────────────


def checked(spark: SparkSession, target: str, expected_root: str | None = None, digests: bool = True) -> dict:
    """The newest manifest, if every section it names holds the rows it says; ``digests`` reads them."""
    meta = read_meta(spark, target)
    if meta is None:
        raise SnapshotInvalid("no complete snapshot at " + target)
    if meta["format_version"] != FORMAT_VERSION:
        raise SnapshotInvalid("snapshot of another format")
    if expected_root is not None and meta["root_hash"] != root_hash(spark, expected_root):
        raise SnapshotInvalid("snapshot belongs to another root")
    for name in SECTIONS:
        section, rows = _section(meta, name), read_section(spark, target, name)
        same = digest_of(rows) == (section["row_count"], section["digest"]) if digests else rows.count() == section["row_count"]
        if not same:
            raise SnapshotInvalid(f"section {name} is not what was written")
    if meta["file_count"] == 0:
        raise SnapshotInvalid("snapshot is empty")
    return meta


def load(spark: SparkSession, target: str, root: str, expected_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, declarations) of a valid snapshot, brought up to date from ``root``.

    Files that are gone from the tree are dropped; a file of another time or size than its stored one
    is read and parsed again.
    """
    checked(spark, target, expected_root)
    content, outline = read_section(spark, target, "content"), read_section(spark, target, "outline")
    current = listing.walk(spark, root)
    there = current.select("path", F.col("mtime_ns").alias("now_ns"), F.col("length").alias("now_length"))
    same = content.join(there, "path").where("mtime_ns = now_ns and length = now_length").select(*content.columns)
    changed = current.join(content.select("path"), "path", "left_semi").join(same.select("path"), "path", "left_anti")
    fresh = listing.read_files(changed, root).select("path", "content", "length", "mtime_ns")
    files = same.unionByName(fresh)
    decls = outline.join(same.select("path"), "path", "left_semi")
    return files, decls.unionByName(symbols.declarations(listing.as_text(fresh)).select(*decls.columns))


def secondary_checkpoint(spark: SparkSession, path: str) -> dict[str, int]:
    """Progress counters of a checkpoint: a snapshot's meta, or a small JSON file."""
    raw = read_meta(spark, path)
    if raw is None:
        text = spark.read.text(path, wholetext=True).first()
        row = spark.range(1).select(
            F.get_json_object(F.lit(text[0]), "$.tier2_processed").alias("p"),
            F.get_json_object(F.lit(text[0]), "$.tier2_queued").alias("q"),
        ).first()
        raw = {"tier2_processed": row["p"], "tier2_queued": row["q"]}
    return {
        "processed_files": int(raw.get("tier2_processed") or 0),
        "queued_files": int(raw.get("tier2_queued") or 0),
    }

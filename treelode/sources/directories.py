"""The listing of a tree as a table of directories, and a data source of what moved since.

A directory's times move when entries come, go or are renamed (its change time even where a copying
tool puts the modification time back), so a directory that kept its inode, times and ignore files
is not listed again; its known files are only looked at one by one, for edits in place.  The table is a base and later deltas, all split by the same hash of
the path; the source plans a partition for each of these buckets and reads the newest rows of it.

``spark.read`` compares once; ``spark.readStream`` compares once per trigger, and its offset names
the listing compared with.  Both report differences between tree and table, whatever was reported
before: what a failed batch left undone is reported again, and once it is kept in the table it no
longer is.  The table must lie on a store that tasks can open through Arrow's file systems.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from stat import S_ISREG

import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from treelode.sources import listing, storage

SOURCE = "treelode_moved"
#: ``gone``: no directory any more. ``rules``: its ignore files changed. ``listed``: its entries moved
#: or may have. ``edited``: one of its files has another size or time.
SIGNALS = "path STRING, part INT, action STRING, name STRING, length BIGINT, mtime_ns BIGINT"
KEPT = listing.DIRECTORY + ", gone BOOLEAN, bucket INT"
#: A directory that was changed this shortly before it was listed may have been changed again in the
#: same tick of the file system's clock, so it is listed once more.
RACY_NS = 2_000_000_000
#: Rows of directories in a bucket, and deltas that are kept before they become a new base.
BUCKET_ROWS, DELTAS = 500, 16


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def parse_chain(names: list[str], last: int | None = None) -> list[tuple[int, int, str]]:
    """(number, buckets, folder) of the newest base up to ``last`` and the deltas after it, newest first."""
    found = []
    for name in names:
        kind, _, rest = name.partition("-")
        if kind in ("base", "delta"):
            number, buckets = rest.split("-")
            found.append((int(number), int(buckets), name))
    found = sorted((f for f in found if last is None or f[0] <= last), reverse=True)
    base = next((i for i, f in enumerate(found) if f[2].startswith("base")), None)
    return [] if base is None else found[: base + 1]


def finished(folder: str, last: int | None = None) -> list[tuple[int, int, str]]:
    """The chain, as a process without a session sees it."""
    fs, at = _opened(folder)
    entries = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    names = [e.base_name for e in entries if e.base_name.startswith(("base-", "delta-"))]
    marks = fs.get_file_info([f"{at}/{name}/_SUCCESS" for name in names]) if names else []
    return parse_chain([n for n, m in zip(names, marks) if m.type != pafs.FileType.NotFound], last)


def moved_in(root: str, row: dict, racy_ns: int = RACY_NS) -> Iterator[tuple]:
    """What differs between one row of the table and the tree."""
    path, part = row["path"], row["part"]

    def signal(action: str, name: str | None = None, length: int = 0, mtime: int = 0) -> tuple:
        return path, part, action, name, length, mtime

    stat = listing.directory_stat(root, path)
    if stat is None:
        yield signal("gone" if path else "rules")
        return
    full = os.path.join(root, path)
    if listing.rule_files(full, path) != row["rule_files"]:
        yield signal("rules")
        return
    young = row["listed_ns"] - max(row["mtime_ns"], row["ctime_ns"]) < racy_ns
    if young or (stat.st_ino, stat.st_mtime_ns, stat.st_ctime_ns) != (row["inode"], row["mtime_ns"], row["ctime_ns"]):
        yield signal("listed")
        return
    for file in row["files"]:
        try:
            found = os.lstat(os.path.join(full, file["name"]))
        except (FileNotFoundError, NotADirectoryError):
            yield signal("listed")
            return
        if not S_ISREG(found.st_mode):
            yield signal("listed")
            return
        if (found.st_size, found.st_mtime_ns) != (file["length"], file["mtime_ns"]):
            yield signal("edited", file["name"], found.st_size, found.st_mtime_ns)


@dataclass
class Bucket(InputPartition):
    folders: list[str]  # newest first, the base last

    def rows(self) -> Iterator[dict]:
        """The newest row of each part of a directory."""
        later: set[tuple] = set()
        for number, folder in enumerate(self.folders):
            fs, at = _opened(folder)
            if fs.get_file_info(at).type == pafs.FileType.NotFound:
                continue
            base = number == len(self.folders) - 1
            for batch in ds.dataset(at, filesystem=fs, format="parquet").to_batches(batch_size=16):
                for row in batch.to_pylist():
                    key = row["path"], row["part"]
                    if key in later:
                        continue
                    if not base:
                        later.add(key)
                    if not row["gone"]:
                        yield row


class _Compared:
    """Plans a partition per bucket and compares its rows with the tree."""

    def __init__(self, options: dict):
        self.root, self.folder = options["root"], options["table"]
        self.racy_ns = int(options.get("racy_ns", RACY_NS))

    def planned(self, last: int | None = None) -> list[Bucket]:
        # A replayed batch may find that the listing it names was merged: any newer one will do.
        chain = finished(self.folder, last) or finished(self.folder)
        buckets = chain[-1][1] if chain else 0
        return [Bucket([f"{self.folder}/{name}/bucket={b}" for *_, name in chain]) for b in range(buckets)]

    def read(self, partition: Bucket) -> Iterator[tuple]:
        for row in partition.rows():
            yield from moved_in(self.root, row, self.racy_ns)


class _Once(_Compared, DataSourceReader):
    def partitions(self) -> list[Bucket]:
        return self.planned()


class _Continuous(_Compared, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at_ms": 0, "listing": 0}

    def latestOffset(self) -> dict:
        chain = finished(self.folder)
        return {"at_ms": time.time_ns() // 1_000_000, "listing": chain[0][0] if chain else 0}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        return self.planned(end["listing"])

    def commit(self, end: dict) -> None:
        """Nothing to give back: the table, not the stream, holds what was seen."""


class Moved(DataSource):
    """Options ``root`` (the tree), ``table`` (its listing) and ``racy_ns``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SIGNALS

    def reader(self, schema) -> DataSourceReader:
        return _Once(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Continuous(self.options)


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it, the root included."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))
    return F.array_distinct(F.concat(F.array(F.lit("")), above))


@dataclass
class Change:
    files: DataFrame  # files that came or moved, as listed: path, length, mtime_ns, dir_mtimes
    paths: DataFrame  # their paths, and those of files that went
    rows: DataFrame   # rows to keep


class Directories:
    """The table of one tree."""

    def __init__(self, spark: SparkSession, root: str, folder: str, racy_ns: int = RACY_NS):
        self.spark, self.root, self.folder = spark, root, folder
        self.options = {"root": root, "table": folder, "racy_ns": str(racy_ns)}
        spark.dataSource.register(Moved)

    def _keep(self, df: DataFrame) -> DataFrame:
        """Written down beside the table until the listing is kept."""
        path = f"{self.folder}-steps/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _forget(self) -> None:
        storage.delete(self.spark, f"{self.folder}-steps")

    # ── the table ────────────────────────────────────────────────────────────

    def chain(self) -> list[tuple[int, int, str]]:
        names = storage.children(self.spark, self.folder)
        return parse_chain([n for n in names if "_SUCCESS" in storage.children(self.spark, f"{self.folder}/{n}")])

    def _write(self, kind: str, rows: DataFrame, buckets: int) -> None:
        chain = self.chain()
        number = chain[0][0] + 1 if chain else 1
        split = rows.withColumn("bucket", F.pmod(F.hash("path"), F.lit(buckets)))
        target = f"{self.folder}/{kind}-{number:012d}-{buckets}"
        split.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)

    def replace(self, rows: DataFrame) -> None:
        """Keep a whole listing.  Chains older than the one before are removed."""
        before = self.chain()
        held = rows.count()
        if not held:  # the root alone, of which nothing is known yet
            rows = self.spark.createDataFrame([("", 0, 0, 0, 0, 0, "", [], [], [])], listing.DIRECTORY)
        self._write("base", rows.withColumn("gone", F.lit(False)), max(8, -(-held // BUCKET_ROWS)))
        kept = {name for *_, name in (*before, *self.chain())}
        for name in storage.children(self.spark, self.folder):
            if name not in kept:
                storage.delete(self.spark, f"{self.folder}/{name}")

    def add(self, rows: DataFrame) -> None:
        """Keep rows that replace those of the same directory and part."""
        chain = self.chain()
        self._write("delta", rows, chain[-1][1])
        self._forget()
        if len(chain) > DELTAS:
            self.replace(self.current())

    def current(self, only: DataFrame | None = None) -> DataFrame:
        """Newest rows; with ``only``, those of its distinct paths, out of their buckets."""
        chain = self.chain()
        wanted = None
        if only is not None:
            near = only.select(F.pmod(F.hash("path"), F.lit(chain[-1][1])).alias("b")).distinct().collect()  # at most one row a bucket
            wanted = F.col("bucket").isin([r["b"] for r in near])
        layers = []
        for number, _, name in chain:
            layer = self.spark.read.schema(KEPT).parquet(f"{self.folder}/{name}")
            layer = layer if wanted is None else layer.where(wanted).join(only, "path", "left_semi")
            layers.append(layer.drop("bucket").withColumn("number", F.lit(number)))
        rows = reduce(DataFrame.unionByName, layers)
        newest = F.max_by(F.struct(*(c for c in rows.columns if c != "number")), "number").alias("row")
        return rows.groupBy("path", "part").agg(newest).select("row.*").where("not gone").drop("gone")

    # ── what moved ───────────────────────────────────────────────────────────

    def signals(self) -> DataFrame:
        """Differences between the tree and the table, once."""
        return self.spark.read.format(SOURCE).options(**self.options).load()

    def signal_stream(self) -> DataFrame:
        return self.spark.readStream.format(SOURCE).options(**self.options).load()

    def moved(self, signals: DataFrame | None = None) -> Change | None:
        """List again what ``signals`` name, and what is new below; None where nothing moved.

        A directory whose ignore files changed is listed again with all below it; what lies below
        one that is gone is gone.
        """
        # Written down once: a second look at the tree could see other differences.
        signals = self._keep(self.signals() if signals is None else signals)
        actions = {r["action"] for r in signals.select("action").distinct().collect()}  # of four
        if not actions:
            self._forget()
            return None
        if actions == {"edited"}:
            files, parts = self._edited(signals)
            return Change(files, files.select("path"), parts.withColumn("gone", F.lit(False)))
        whole = signals.where("action in ('gone', 'rules')").select("path", F.col("action").alias("why")).distinct()
        touched = signals.where("action = 'listed'").select("path").distinct()
        again = touched.withColumn("deep", F.lit(False))
        below = touched.limit(0)
        if actions & {"gone", "rules"}:
            each = self.current().where("part = 0").select("path", F.explode(ancestors(F.col("path"))).alias("above"))
            held = self._keep(each.join(whole.select(F.col("path").alias("above")), "above", "left_semi"))
            below = held.select("path").distinct()
            inside = held.where("path <> above").select("path").distinct()
            starts = whole.where("why = 'rules'").select("path", F.lit(True).alias("deep"))
            again = starts.unionByName(again.join(below, "path", "left_anti")).join(inside, "path", "left_anti")
        affected = below.unionByName(touched).distinct()
        old = self._keep(self.current(affected))
        fresh = self._listed_again(old.where("part = 0").join(again, "path").select("path", "dir_mtimes", "rules", "deep"), below)
        new, was = listing.files_of(fresh), listing.files_of(old)
        same = was.select("path", F.col("length").alias("l"), F.col("mtime_ns").alias("m"))
        files = new.join(same, "path", "left").where("l is null or l <> length or m <> mtime_ns").drop("l", "m")
        went = was.select("path").join(new.select("path"), "path", "left_anti")
        dead = old.join(fresh.select("path", "part"), ["path", "part"], "left_anti").withColumn("files", F.expr("slice(files, 1, 0)"))
        rows = fresh
        if "edited" in actions:
            edited, parts = self._edited(signals.where("action = 'edited'").join(affected, "path", "left_anti"))
            files, rows = files.unionByName(edited), rows.unionByName(parts)
        files = self._keep(files)
        rows = rows.withColumn("gone", F.lit(False)).unionByName(dead.withColumn("gone", F.lit(True)))
        return Change(files, files.select("path").unionByName(went), rows)

    def _listed_again(self, seeds: DataFrame, below: DataFrame) -> DataFrame:
        """Rows of the directories ``seeds``, and of all below them that the table does not hold."""
        flat = self._keep(listing.listed(seeds.where("not deep"), self.root, 0))
        inner = flat.where("part is null")
        known = self.current(inner.select("path").distinct()).select("path").join(below, "path", "left_anti")
        unknown = inner.join(known, "path", "left_anti").select("path", "dir_mtimes", "rules")
        starts = self._keep(unknown.unionByName(seeds.where("deep").select("path", "dir_mtimes", "rules")))
        found = flat.where("part is not null")
        return found if starts.isEmpty() else found.unionByName(listing.list_below(starts, self.root, self._keep))

    def _edited(self, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Files edited in place, and the rows of their directories with their new marks."""
        stamp = F.struct("name", "length", "mtime_ns").alias("stamp")
        per_part = edits.groupBy("path", "part").agg(F.collect_list(stamp).alias("stamps"))  # at most PART_FILES each
        old = self.current(edits.select("path").distinct()).join(per_part, ["path", "part"])
        unlike = F.filter("files", lambda f: ~F.exists("stamps", lambda s: s["name"] == f["name"]))
        parts = old.withColumn("files", F.concat(unlike, F.col("stamps"))).drop("stamps")
        return listing.files_of(old.withColumn("files", F.col("stamps"))), parts

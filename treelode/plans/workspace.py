"""A workspace: one indexed source tree and its change log.

State lives below ``state_dir`` in the runs of a ``TextStore``.  A full index writes a complete
run; a refresh writes only what changed.  A commit row publishes a run and the batch of versions
written with it, and holds the last sequence number given out.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.functions.paths import STATE_DIR, is_safe_request
from treelode.operators import deps, diff, search, symbols, tree, versions
from treelode.plans.store import COMMITS, TextStore, one_writer
from treelode.schema import VERSIONS
from treelode.session import cut_lineage
from treelode.sources import corpus, listing, snapshot, storage
from treelode.sources.directories import Directories


class Workspace(TextStore):
    def __init__(self, spark: SparkSession, root: str, state_dir: str | None = None, max_bytes: int | None = None):
        super().__init__(spark, state_dir or os.path.join(root, STATE_DIR))
        self.root = root
        self.watching = False
        self.max_bytes = max_bytes

    # ── stored tables ────────────────────────────────────────────────────────

    def stream_folder(self, name: str) -> str:
        """Where a stream over this workspace keeps its progress."""
        return self._table(f"streams/{name}")

    @property
    def directories(self) -> Directories:
        """The tree as it was last listed."""
        return Directories(self.spark, self.root, self._table("directories"))

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(COMMITS).parquet(self._table("commits"))
        except AnalysisException:
            return None

    def _commit_with(self, gen: int | None, runs: list | None, head: str | None, batch: str, last_doc: int) -> None:
        """Publish runs and a batch of versions in one row."""
        written = self.spark.read.schema(VERSIONS).parquet(f"{self._table('versions')}/batch={batch}")
        last = written.agg(F.max("seq")).first()[0]
        self._commit(gen, runs, head, batch, self.current_seq() if last is None else last, last_doc)

    def _append_versions(self, entries: DataFrame, order_by: list[str]) -> str:
        """Number new versions and write them as a batch that a commit publishes.

        Payloads are written first, where they lie; only the other columns are sorted and numbered,
        and find their payload by its place.
        """
        batch = uuid.uuid4().hex
        if "data" in entries.columns:
            entries = versions.stored_payloads(entries, f"{self._table('payloads')}/batch={batch}")
        else:
            entries = entries.withColumn("place", F.lit(None).cast("bigint"))
        numbered = versions.number_rows(entries, order_by, self.current_seq())
        columns = [field.split()[0] for field in VERSIONS.split(", ")]
        numbered.select(*columns).write.parquet(f"{self._table('versions')}/batch={batch}")
        return batch

    def symbols(self) -> DataFrame:
        return symbols.symbols(self.declarations())

    def edges(self) -> DataFrame:
        return deps.edges(self.declarations())

    def stats(self) -> DataFrame:
        view = self.view()
        files = view.current("files")
        counted = symbols.symbol_counts(listing.as_text(files), view.current("declarations"))
        return counted.join(files.select("path", "mtime_ns", "dir_mtimes"), "path")

    def _log(self) -> DataFrame:
        """Versions of committed batches, with their batch; what a job left behind before its commit
        is not seen."""
        commits = self._commits()
        if commits is None:
            return self.spark.createDataFrame([], VERSIONS + ", batch STRING")
        log = self.spark.read.schema(VERSIONS + ", batch STRING").parquet(self._table("versions"))
        return log.join(commits.select("batch").distinct(), "batch", "left_semi")

    def versions(self) -> DataFrame:
        return self._log().drop("batch", "place")

    def with_payloads(self, log: DataFrame) -> DataFrame:
        """Rows of the log with ``data``, null where a version has none."""
        if not storage.children(self.spark, self._table("payloads")):
            return log.withColumn("data", F.lit(None).cast("binary")).drop("batch", "place")
        held = self.spark.read.schema("place BIGINT, data BINARY, batch STRING").parquet(self._table("payloads"))
        return log.join(held, ["batch", "place"], "left").drop("batch", "place")

    # ── writing ──────────────────────────────────────────────────────────────

    @one_writer
    def index(self) -> dict:
        """Walk, read and parse everything; one snapshot version per walked file."""
        commit = self._commit_row()
        gen = 0 if commit is None or commit["gen"] is None else commit["gen"] + 1
        tree_rows = listing.list_tree(self.spark, self.root)
        found = listing.files_of(tree_rows)
        last_doc = self._write_generation(gen, self._as_known(found, gen), found, commit)
        entries = found.select("path", F.col("length").alias("size"))
        batch = self._append_snapshots(entries)
        self._commit_with(gen, [(gen, gen, 0)], listing.git_head(self.root), batch, last_doc)
        self.directories.replace(tree_rows)
        return self.index_result()

    def index_result(self) -> dict:
        return {"started": True, "indexed_files": self.indexed_files(), "current_seq": self.current_seq()}

    @staticmethod
    def _as_known(found: DataFrame, gen: int) -> DataFrame:
        return found.select(
            "path", F.expr("mtime_ns div 1000000").alias("mtime_ms"), F.col("length").alias("size"),
            F.lit(0).cast("bigint").alias("hash"), F.lit(gen).cast("bigint").alias("content_gen"),
            F.lit(False).alias("deleted"),
        )

    def _write_generation(self, gen: int, known: DataFrame, to_read: DataFrame, commit) -> int:
        """Write a run; returns the last document number given out."""
        last = 0 if commit is None else commit["last_doc"] or 0
        numbered = self._numbered(corpus.indexable_paths(to_read, self.max_bytes), last)
        self._write_run(gen, known, listing.read_files(numbered, self.root, self.max_bytes))
        return self._last_doc_of(gen, last)

    def _append_snapshots(self, entries: DataFrame) -> str:
        made = entries.select(
            "path", F.lit(0).cast("bigint").alias("agent"),
            F.unix_millis(F.current_timestamp()).alias("timestamp_ms"), F.lit("snapshot").alias("op"),
            F.lit(0).cast("bigint").alias("hash"), F.col("size").cast("bigint").alias("size"),
        )
        return self._append_versions(made, ["path"])

    @one_writer
    def record_edits(self, edits: DataFrame) -> int:
        """Append edit versions ``(path, agent, op, hash, size, data, ord)`` in ``ord`` order."""
        made = edits.select(
            "path", "agent", F.unix_millis(F.current_timestamp()).alias("timestamp_ms"), "op", "hash", "size",
            "data", "ord",
        )
        batch = self._append_versions(made, ["ord", "path"])
        commit = self._commit_row()
        gen, runs, head, last_doc = (None, None, None, 0) if commit is None else (commit["gen"], commit["runs"], commit["git_head"], commit["last_doc"])
        self._commit_with(gen, runs, head, batch, last_doc)
        return self.current_seq()

    @one_writer
    def refresh(self, strict_hash: bool = True, signals: DataFrame | None = None) -> int:
        """Pick up created, modified and deleted files; returns how many changed.

        Only directories that moved since the last listing are listed again; ``signals`` says which,
        where a stream has found out.  The listing is kept after the commit, so what a failed job
        left undone is found again.  With ``strict_hash`` a file whose stored hash is still unknown is hashed from the
        content stored in the index, so touching a file is not reported as a change.
        """
        commit = self._commit_row()
        head = listing.git_head(self.root)
        if commit is None or commit["gen"] is None or head != commit["git_head"]:
            before = self.current_seq()
            self.index()
            return self.current_seq() - before
        if not self.directories.chain():  # a state that was written without one
            self.directories.replace(listing.list_tree(self.spark, self.root).where("false"))
        moved = self.directories.moved(signals)
        if moved is None:
            return 0
        changed = self._record(commit, head, moved.files, moved.paths, strict_hash)
        self.directories.add(moved.rows)
        return changed

    def _record(self, commit, head: str | None, found: DataFrame, paths: DataFrame, strict_hash: bool) -> int:
        """Write what differs between the index and ``found``, among the files in ``paths``."""
        gen = commit["gen"] + 1
        known = self.view().known().join(paths, "path", "left_semi")
        fresh = found.select(
            "path", F.expr("mtime_ns div 1000000").alias("mtime_ms"), F.col("length").alias("size"), "mtime_ns", "dir_mtimes"
        )
        if strict_hash:
            known = self._with_stored_hash(known, fresh)
        touched = diff.needs_hash(known, fresh)
        hashed = listing.read_files(
            found.join(touched, "path", "left_semi"), self.root, self.max_bytes
        ).select("path", corpus.content_hash(F.col("content")).alias("hash"))
        current = fresh.join(hashed, "path", "left").select("path", "mtime_ms", "size", "hash")
        changes = cut_lineage(
            diff.diff(known.select("path", "mtime_ms", "size", "hash"), current)
            .join(known.select("path", "content_gen", F.col("mtime_ms").alias("_was")), "path", "left")
            .filter((F.col("change") != "unchanged") | (F.col("mtime_ms") != F.col("_was")))
        )
        if changes.isEmpty():
            return 0
        real = changes.filter("change != 'unchanged'")
        gone = F.col("change") == "deleted"
        delta = changes.select(
            "path", "mtime_ms", "size", F.coalesce("hash", F.lit(0)).cast("bigint").alias("hash"),
            F.when(F.col("change") == "unchanged", F.col("content_gen")).otherwise(F.lit(gen)).cast("bigint").alias("content_gen"),
            gone.alias("deleted"),
        )
        to_read = found.join(real.filter(~gone).select("path"), "path", "left_semi")
        last_doc = self._write_generation(gen, delta, to_read, commit)
        batch = self._append_versions(diff.to_versions(real).drop("data"), ["path"])
        self._commit_with(gen, [*commit["runs"], (gen, gen, 0)], head, batch, last_doc)
        self.compact()
        return real.count()

    def _with_stored_hash(self, known: DataFrame, fresh: DataFrame) -> DataFrame:
        """Fill unknown hashes of same-sized, re-stamped files from the stored content."""
        moved = known.join(fresh.select("path", F.col("mtime_ms").alias("_m"), F.col("size").alias("_s")), "path")
        moved = moved.filter((F.col("_m") != F.col("mtime_ms")) & (F.col("_s") == F.col("size")) & (F.col("hash") == 0))
        stored = self.view().current("files").join(moved.select("path"), "path", "left_semi").select(
            "path", corpus.content_hash(F.col("content")).alias("_stored")
        )
        return known.join(stored, "path", "left").withColumn(
            "hash", F.when(F.col("hash") == 0, F.coalesce("_stored", F.lit(0))).otherwise(F.col("hash"))
        ).drop("_stored")

    def notify(self, changed: Iterable[str]) -> int:
        """Re-index the named files at once."""
        return self.notify_frame(self.spark.createDataFrame([(p,) for p in changed], "path STRING"))

    @one_writer
    def notify_frame(self, named: DataFrame) -> int:
        """Re-index ``named(path)``; names outside the root are dropped.

        Only the named files are looked at, under the ignore rules above each of them.
        """
        trimmed = F.trim("path", F.lit(" \t\r"))
        prefix = self.root.rstrip("/") + "/"
        rel = F.when(F.startswith(trimmed, F.lit(prefix)), F.substring(trimmed, F.lit(len(prefix) + 1), F.length(trimmed))).otherwise(trimmed)
        wanted = named.select(rel.alias("path")).filter(is_safe_request(F.col("path"))).distinct()
        found = cut_lineage(listing.stat_paths(wanted, self.root))
        if found.isEmpty():
            return 0
        commit = self._commit_row()
        if commit is None or commit["gen"] is None:  # the named files are among all others
            self.index()
            return found.count()
        gen = commit["gen"] + 1
        last_doc = self._write_generation(gen, self._as_known(found, gen), found, commit)
        batch = self._append_snapshots(found.select("path", F.col("length").alias("size")))
        self._commit_with(gen, [*commit["runs"], (gen, gen, 0)], commit["git_head"], batch, last_doc)
        self.compact()
        return found.count()

    # ── reading ──────────────────────────────────────────────────────────────

    def indexed_files(self) -> int:
        return self.view().current("files").count()

    def current_seq(self) -> int:
        commit = self._commit_row()
        return 0 if commit is None else commit["last_seq"] or 0

    def tree(self, path=None, depth=None, max_nodes=None, include=(), sort="name", dirs_first=True) -> DataFrame:
        return tree.ordered(tree.nodes(self.stats(), path, depth, include, sort, dirs_first), max_nodes)

    def outline(self, path: str) -> DataFrame:
        return symbols.outlines(
            self.files().filter(F.col("path") == path), self.declarations().filter(F.col("path") == path)
        )

    def scoped_search(self, query: str, max_results: int | None = None) -> DataFrame:
        hits = symbols.scoped_search(self.files(), query)
        return hits.orderBy("path", "line_num").limit(search.clamp_results(max_results))

    def imports(self, path: str) -> DataFrame:
        return deps.imports_of(self.edges(), path)

    def imported_by(self, path: str) -> DataFrame:
        return deps.imported_by(self.edges(), path)

    def changes(self, since: int = 0) -> DataFrame:
        return versions.changes_since(self.versions(), since)

    def changes_count(self, since: int = 0, keep: int | None = None) -> int:
        """Versions newer than ``since``; with ``keep``, among the newest ones of each path."""
        return versions.changes_count(versions.retained(self.versions(), keep), since).first()["changes"]

    def at_cursor(self, cursor: int, keep: int | None = None) -> DataFrame:
        """Each path as of ``cursor``, payload included; with ``keep``, among its newest versions."""
        return self.with_payloads(versions.at_cursor(versions.retained(self._log(), keep), cursor))

    def hot_files(self, limit: int) -> DataFrame:
        return versions.hot_files(self.view().current("files").select("path"), self.versions(), limit)

    def fuzzy(self, query: str, max_results: int) -> DataFrame:
        return search.fuzzy_top(self.view().current("files"), query, max_results)

    def search_indexed(self, postings: DataFrame, query: str, max_results: int | None = None, regex: bool = False) -> DataFrame:
        """Search through a trigram index built from this workspace's current files."""
        return search.top_results(search.search_indexed(self.files(), postings, query, regex), max_results)

    # ── snapshots ────────────────────────────────────────────────────────────

    @property
    def snapshot_path(self) -> str:
        return self._table("snapshot")

    def snapshot(self, write: bool = False) -> dict:
        if write:
            snapshot.write(
                self.view().current("files"), self.declarations(), self.root, self.snapshot_path, listing.git_head(self.root)
            )
        if snapshot.read_meta(self.spark, self.snapshot_path) is None:
            return {"exists": False, "path": self.snapshot_path, "wrote": write}
        size, updated = snapshot.size_and_time(self.spark, self.snapshot_path)
        return {
            "exists": True, "path": self.snapshot_path, "size_bytes": size, "updated_at": updated, "wrote": write,
        }

    def status(self) -> dict:
        try:
            indexed = self.indexed_files()
        except LookupError:
            indexed = 0
        return {
            "project_root": self.root, "indexed_files": indexed, "current_seq": self.current_seq(),
            "watcher_running": self.watching,
        }

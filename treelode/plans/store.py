"""Texts and their indexes in immutable runs, searched index first.

Every write makes a run: the texts that are new, what is known of each touched path, and the
indexes of those texts.  One commit row names the runs that count, oldest first; the first is
complete, later ones hold changes.  A job that dies half-way leaves nothing visible, and readers of
an older commit keep their runs until ``vacuum``.

Texts are numbered densely and stored in the order of their numbers, in one folder per
``SPAN`` of them.  A search finds the numbers of its candidates in the posting blocks, hands the
ranges they lie in to the scan of the texts, and tests only texts that met a candidate.

``compact`` merges runs in tiers: as soon as ``FAN`` runs of one level exist they become one run of
the next, sorted and split by key ranges.  Rows that newer ones replace are left behind; deletions
are carried until they meet the complete run.  So a lookup opens a number of files that grows with
the logarithm of the number of writes.
"""

from __future__ import annotations

import contextlib
import functools
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.functions import regex as dialect
from treelode.operators import blocks, postings, search, symbols, words
from treelode.operators.numbering import as_bits, marked_in, with_dense_numbers
from treelode.sources import corpus, listing, storage

COMMITS = (
    "gen BIGINT, runs ARRAY<STRUCT<run: BIGINT, hi: BIGINT, level: INT>>, git_head STRING, committed_ms BIGINT, "
    "batch STRING, last_seq BIGINT, last_doc BIGINT"
)
FILES = "doc_id BIGINT, path STRING, content BINARY, length BIGINT, mtime_ns BIGINT, dir_mtimes ARRAY<BIGINT>, gen BIGINT, span BIGINT"
KNOWN = "path STRING, mtime_ms BIGINT, size BIGINT, hash BIGINT, content_gen BIGINT, deleted BOOLEAN, gen BIGINT"
#: Indexes of a run; those of the second group name documents by number, as posting blocks or lists of words.
BY_PATH, BLOCKS = ("declarations",), {"words": words.LISTS, "trigrams": postings.BLOCKS, "ngrams": postings.BLOCKS}
INDEXES = (*BY_PATH, *BLOCKS)
#: Documents in one folder of texts, as a power of two.
SPAN_BITS = 16
#: Runs of one level that become one run of the next, and ranges a search hands to a scan.
FAN, RANGES = 4, 200
#: Bytes of text that a merge deals out anew; more is written as it lies.
DEALT = 1 << 28
#: Shuffle files go with the job that wrote them, instead of when the driver next collects its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def one_writer(method):
    """Writers of one store take turns: a run and its numbers are read, written and committed by
    one of them at a time."""

    @functools.wraps(method)
    def alone(self, *args, **kwargs):
        with self._writer:
            return method(self, *args, **kwargs)

    return alone


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that write a table here leave no shuffle files."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def any_of(conditions: list[Column]) -> Column:
    """A balanced OR, so that many conditions make no deep tree."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2])] + conditions[len(conditions) // 2 * 2 :]
    return conditions[0]


def id_ranges(found: DataFrame, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that cover all ``doc_id`` of ``found``; one row per range is gathered."""
    low, high = found.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return []
    bits = 0
    while (high - low) >> bits >= most:
        bits += 1
    cell = F.shiftright(F.col("doc_id") - low, bits)
    rows = found.groupBy(cell.alias("cell")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("low").collect()
    out: list[tuple[int, int]] = []
    for row in rows:
        if out and row["low"] <= out[-1][1] + 1:
            out[-1] = (out[-1][0], row["high"])
        else:
            out.append((row["low"], row["high"]))
    return out


def in_ranges(ranges: list[tuple[int, int]]) -> Column:
    """Texts whose number lies in a range; their folder is tested too, so that others stay closed."""
    spans = sorted({(low >> SPAN_BITS, high >> SPAN_BITS) for low, high in ranges})
    by_folder = any_of([F.col("span").between(a, b) for a, b in spans])
    return by_folder & any_of([F.col("doc_id").between(a, b) for a, b in ranges])


@dataclass(frozen=True)
class View:
    """The runs of one commit, as a reader sees them."""

    store: "TextStore"
    gen: int
    runs: tuple
    last_doc: int

    def read(self, name: str, runs: tuple) -> DataFrame:
        spark, table = self.store.spark, self.store._table(name)
        reader = spark.read.option("basePath", table)
        if name in ("files", "known"):
            reader = reader.schema(FILES if name == "files" else KNOWN)
        elif name in BLOCKS:
            reader = reader.schema(BLOCKS[name])
        return reader.parquet(*[f"{table}/run={r['run']}" for r in runs]).drop("run")

    @property
    def later(self) -> tuple:
        return self.runs[1:]

    def recent(self) -> DataFrame:
        """Newest known row of every path that a later run touched."""
        return newest(self.read("known", self.later))

    def known(self) -> DataFrame:
        """Every path as last seen: path, mtime_ms, size, hash, content_gen."""
        rows = self.read("known", self.runs[:1])
        if self.later:
            recent = self.recent()
            rows = rows.join(recent.select("path"), "path", "left_anti").unionByName(recent)
        return rows.where(~F.col("deleted")).drop("deleted", "gen")

    def current(self, name: str, only: Column | None = None) -> DataFrame:
        """Rows of a table that belong to the newest content of their path.

        The rows of the complete run only meet the paths that changed since, a small relation that
        Spark broadcasts while it is small, so base contents are not shuffled on every read.
        ``only`` is tested in the scans.
        """
        chosen = (lambda df: df) if only is None else (lambda df: df.where(only))
        base = chosen(self.read(name, self.runs[:1]))
        if not self.later:
            return base.drop("gen", "span")
        recent, base_hi = self.recent(), self.runs[0]["hi"]
        newer = F.col("content_gen") > base_hi
        moved = recent.where(F.col("deleted") | newer)
        live = recent.where(~F.col("deleted") & newer).select("path", F.col("content_gen").alias("gen"))
        kept = base.join(moved.select("path"), "path", "left_anti")
        later = chosen(self.read(name, self.later)).join(live, ["path", "gen"], "left_semi")
        return kept.unionByName(later.select(*kept.columns)).drop("gen", "span")

    def blocks(self, name: str) -> DataFrame:
        """Posting blocks, or lists of words, of all runs.  A text that is stored again has a new number, so numbers of
        older texts meet no current one."""
        return self.read(name, self.runs)


def newest(known: DataFrame) -> DataFrame:
    row = F.max_by(F.struct("mtime_ms", "size", "hash", "content_gen", "deleted", "gen"), "gen").alias("r")
    return known.groupBy("path").agg(row).select("path", "r.*")


class TextStore:
    def __init__(
        self, spark: SparkSession, state_dir: str, indexes: tuple[str, ...] = INDEXES, block_bytes: int = blocks.BLOCK_BYTES
    ):
        self.spark = spark
        self.state_dir = state_dir
        self.indexes = indexes
        self.block_bytes = block_bytes
        self._writer = threading.RLock()
        self._numbers: list[str] = []

    def _table(self, name: str) -> str:
        return f"{self.state_dir}/{name}"

    # ── commits ──────────────────────────────────────────────────────────────

    def _commit_names(self) -> list[str]:
        return [n for n in storage.children(self.spark, self._table("commits")) if n.startswith("commit=")]

    def _commit_row(self):
        """The newest finished commit: one listing, and one file read."""
        for name in reversed(self._commit_names()):
            folder = f"{self._table('commits')}/{name}"
            if "_SUCCESS" in storage.children(self.spark, folder):
                return self.spark.read.schema(COMMITS).parquet(folder).first()
        return None

    def _commit(self, gen: int | None, runs: list | None, head: str | None, batch: str | None = None, last_seq: int = 0, last_doc: int = 0) -> None:
        """Publish runs, and a batch of versions written with them, in one row."""
        names = self._commit_names()
        number = int(names[-1].split("=")[1]) + 1 if names else 0
        row = (gen, runs, head, time.time_ns() // 1_000_000, batch, last_seq, last_doc)
        self.spark.createDataFrame([row], COMMITS).coalesce(1).write.parquet(f"{self._table('commits')}/commit={number:012d}")

    def view(self) -> View:
        commit = self._commit_row()
        if commit is None or commit["gen"] is None:
            raise LookupError("workspace is not indexed")
        return View(self, commit["gen"], tuple(commit["runs"]), commit["last_doc"] or 0)

    # ── writing ──────────────────────────────────────────────────────────────

    def _scratch(self, df: DataFrame, held: list[str] | None = None) -> DataFrame:
        """A table of one operation, in the store's own folder; what is in ``held`` goes with
        ``_drop``, and ``vacuum`` removes the rest."""
        path = f"{self._table('scratch')}/{time.time_ns() // 1_000_000}-{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        if held is not None:
            held.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _drop(self, held: list[str]) -> None:
        while held:
            storage.delete(self.spark, held.pop())

    def _numbered(self, rows: DataFrame, last_doc: int) -> DataFrame:
        """Numbers only grow; a text that is stored again gets a new one.  The rows are read once, to be
        stored as texts."""
        return with_dense_numbers(rows, "doc_id", functools.partial(self._scratch, held=self._numbers), first=last_doc + 1)

    def _write(self, name: str, run: int, df: DataFrame, *folders: str) -> None:
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").partitionBy(*folders).parquet(f"{self._table(name)}/run={run}")

    def _write_texts(self, run: int, gen: Column, files: DataFrame) -> DataFrame:
        """The texts of a run by number, in folders of ``SPAN`` of them; returns them as stored."""
        placed = files.withColumn("gen", gen.cast("bigint")).withColumn("span", F.shiftright("doc_id", SPAN_BITS))
        columns = [f.split()[0] for f in FILES.split(", ")]
        self._write("files", run, placed.select(*columns).sortWithinPartitions("span", "doc_id"), "span")
        self._drop(self._numbers)
        return self.spark.read.schema(FILES).parquet(f"{self._table('files')}/run={run}")

    def _declared(self, texts: DataFrame) -> DataFrame:
        """Symbols of stored texts; those of more than ``block_bytes`` are parsed in blocks."""
        large = F.col("length") > self.block_bytes
        if texts.where(large).isEmpty():
            return symbols.declarations(texts)
        in_blocks = blocks.declarations(blocks.cut(texts.where(large), self.block_bytes))
        return symbols.declarations(texts.where(~large)).unionByName(in_blocks)

    def _write_indexes(self, run: int, texts: DataFrame) -> None:
        gen = F.lit(run).cast("bigint").alias("gen")
        made = {
            "declarations": lambda: self._declared(texts).select("*", gen),
            "words": lambda: words.build(texts).sortWithinPartitions("word", "shard"),
            "trigrams": lambda: postings.sorted_runs(postings.build(texts)),
            "ngrams": lambda: postings.sorted_runs(postings.build(texts, postings.ngram_terms())),
        }
        for name in self.indexes:
            self._write(name, run, made[name]())

    def _write_run(self, run: int, known: DataFrame, files: DataFrame) -> None:
        stored = self._write_texts(run, F.lit(run), files)
        self._write_indexes(run, listing.as_text(stored))
        self._write("known", run, known.withColumn("gen", F.lit(run).cast("bigint")))

    def _last_doc_of(self, run: int, before: int) -> int:
        stored = self.spark.read.schema(FILES).parquet(f"{self._table('files')}/run={run}")
        return max(before, stored.agg(F.max("doc_id")).first()[0] or 0)

    @one_writer
    def put(self, files: DataFrame, gone: DataFrame | None = None) -> int:
        """Store ``files(path, text)`` in place of what their paths held, and drop the paths of
        ``gone(path)``; returns the generation.  A path may occur once; a null text is empty."""
        commit = self._commit_row()
        first = commit is None or commit["gen"] is None
        gen = 0 if first else commit["gen"] + 1
        last = 0 if commit is None else commit["last_doc"] or 0
        content = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
        rows = files.select(
            "path", content.alias("content"), F.octet_length(content).cast("bigint").alias("length"),
            F.lit(0).cast("bigint").alias("mtime_ns"), F.array().cast("array<bigint>").alias("dir_mtimes"),
        )
        stored = self._write_texts(gen, F.lit(gen), self._numbered(rows, last))
        self._write_indexes(gen, listing.as_text(stored))
        zero = F.lit(0).cast("bigint")
        known = stored.select(
            "path", zero.alias("mtime_ms"), F.col("length").alias("size"), corpus.content_hash(F.col("content")).alias("hash"),
            F.lit(gen).cast("bigint").alias("content_gen"), F.lit(False).alias("deleted"),
        )
        if gone is not None:
            known = known.unionByName(gone.select(
                "path", zero.alias("mtime_ms"), zero.alias("size"), zero.alias("hash"), F.lit(gen).cast("bigint").alias("content_gen"), F.lit(True).alias("deleted")
            ))
        self._write("known", gen, known.withColumn("gen", F.lit(gen).cast("bigint")))
        runs = [] if first else list(commit["runs"])
        self._publish(commit, gen, [*runs, (gen, gen, 0)], self._last_doc_of(gen, last))
        self.compact()
        return gen

    def _publish(self, commit, gen: int, runs: list, last_doc: int) -> None:
        head, seq = (None, 0) if commit is None else (commit["git_head"], commit["last_seq"] or 0)
        self._commit(gen, [tuple(r) for r in runs], head, None, seq, last_doc)

    # ── merging ──────────────────────────────────────────────────────────────

    @one_writer
    def compact(self, fan: int = FAN, everything: bool = False) -> int:
        """Merge runs of one level while there are ``fan`` of them, or all; returns how many merges."""
        merges = 0
        while True:
            commit = self._commit_row()
            if commit is None or commit["gen"] is None:
                return merges
            runs = list(commit["runs"])
            level = runs[-1]["level"]
            start = next(i for i in range(len(runs)) if i and runs[i]["level"] <= level) if len(runs) > 1 else 1
            if everything and len(runs) > 1:
                start = 0
            elif len(runs) - start < fan:
                return merges
            merged = commit["gen"] + 1
            top = 0 if start == 0 else level + 1
            self._merge(View(self, commit["gen"], tuple(runs), 0), tuple(runs[start:]), merged, complete=start == 0)
            self._publish(commit, merged, [*runs[:start], (merged, runs[-1]["hi"], top)], commit["last_doc"])
            merges += 1
            everything = False

    def _merge(self, view: View, runs: tuple, run: int, complete: bool) -> None:
        held: list[str] = []
        known = newest(view.read("known", runs))
        known = self._scratch(known.where(~F.col("deleted")) if complete else known, held)
        live = known.where(~F.col("deleted")).select("path", F.col("content_gen").alias("gen"))
        of = lambda name: view.read(name, runs).join(live, ["path", "gen"], "left_semi")
        self._write("known", run, known)
        # Only the numbers of live texts are found by path.
        ids = self._scratch(as_bits(of("files").select("doc_id")), held)
        files = marked_in(view.read("files", runs), ids, "found").drop("found")
        # Numbers ascend from run to run and inside them, so large runs need no shuffle of their texts;
        # small ones become few files.
        if (view.read("files", runs).agg(F.sum("length")).first()[0] or 0) <= DEALT:
            files = files.repartitionByRange("doc_id")
        texts = self._write_texts(run, F.col("gen"), files)
        for name in self.indexes:
            if name == "declarations":
                made = of(name).repartitionByRange("path").sortWithinPartitions("path")
            elif name == "words":
                lists = self._scratch(words.live_lists(view.read(name, runs), texts), held)
                made = lists.repartitionByRange("word", "shard").sortWithinPartitions("word", "shard")
            else:
                # Ranges are found by a first pass over the rows, which would unpack every list twice.
                made = postings.key_ranges(self._scratch(postings.live_blocks(view.read(name, runs), texts), held))
            self._write(name, run, made)
        self._drop(held)

    @one_writer
    def vacuum(self, keep_ms: int = 3_600_000) -> list[str]:
        """Delete folders that no commit of the last ``keep_ms`` names: merged runs, what a job left
        before its commit, scratch tables and versions without a commit.  Returns what went."""
        since = time.time_ns() // 1_000_000 - keep_ms
        newest_row = self._commit_row()
        if newest_row is None:
            return []
        log = self.spark.read.schema(COMMITS).parquet(self._table("commits"))
        # The last commit before that time was still the newest one then.
        first = log.agg(F.coalesce(F.max(F.when(F.col("committed_ms") < since, F.col("commit"))), F.lit(0))).first()[0]
        recent = log.where(F.col("commit") >= first)
        used = {r[0] for r in recent.select(F.explode("runs.run")).distinct().collect()}
        doomed = [
            f"{name}/{folder}" for name in ("files", *INDEXES, "known") for folder in storage.children(self.spark, self._table(name))
            if folder.startswith("run=") and int(folder[4:]) not in used
        ]
        doomed += [f"scratch/{f}" for f in storage.children(self.spark, self._table("scratch")) if int(f.split("-")[0]) < since]
        batches = storage.children(self.spark, self._table("versions"))
        if batches:
            held = {r[0] for r in log.select("batch").distinct().collect()}
            doomed += [f"{t}/{b}" for t in ("versions", "payloads") for b in storage.children(self.spark, self._table(t)) if b.startswith("batch=") and b[6:] not in held]
        for path in doomed:
            storage.delete(self.spark, self._table(path))
        return doomed

    # ── reading ──────────────────────────────────────────────────────────────

    def files(self) -> DataFrame:
        return listing.as_text(self.view().current("files"))

    def declarations(self) -> DataFrame:
        return self.view().current("declarations")

    def words(self, only: Column | None = None) -> DataFrame:
        """Stored word postings of the current texts, one row each; ``only`` is tested in the scans."""
        view = self.view()
        lists = view.blocks("words")
        found = words.rows(lists if only is None else lists.where(only))
        return found.join(view.current("files").select("doc_id", "path"), "doc_id").select("word", "path", "line_num")

    def search_word(self, word: str) -> DataFrame:
        """The word reaches the scan of every run."""
        return words.lookup(self.words(F.col("word") == word), word)

    def trigrams(self) -> DataFrame:
        """Stored trigram postings of the current texts, one row each."""
        view = self.view()
        rows = postings.rows(view.blocks("trigrams")).withColumnRenamed("term", "tri")
        return rows.join(view.current("files").select("doc_id"), "doc_id", "left_semi")

    def ngram_candidates(self, query: str) -> DataFrame | None:
        """Paths whose text shares a sparse n-gram with the query, from the stored lists."""
        view = self.view()
        found = postings.ngram_candidates(view.blocks("ngrams"), query)
        return None if found is None else self._met(view, found).select("path")

    def candidates(self, query: str, is_regex: bool = False, view: View | None = None) -> DataFrame | None:
        """doc_id of the texts that the stored trigrams allow; None where they cannot tell."""
        blocks = (view or self.view()).blocks("trigrams")
        if not is_regex:
            return postings.candidates(blocks, query)
        grams = dialect.decompose(query)
        return postings.candidates_query(blocks, grams) if grams.prunes else None

    def _met(self, view: View, found: DataFrame) -> DataFrame:
        """Current texts with a number in ``found``: only the ranges of those numbers are read.

        Numbers of texts that were replaced or dropped are left out first, so that no text is joined
        by its path.  Both sides decide the column ``text``, so no test of it can move below the join.
        """
        if view.later:
            found = found.join(view.current("files").select("doc_id"), "doc_id", "left_semi")
        found = self._scratch(found.select("doc_id"))
        rows = view.read("files", view.runs).where(in_ranges(id_ranges(found))).drop("gen", "span")
        met = marked_in(rows, as_bits(found), "found")
        return met.withColumn("text", F.when(F.col("found"), F.col("content").cast("string"))).drop("found")

    def search(self, query: str, max_results: int | None = None, regex: bool = False, path: str | None = None) -> DataFrame:
        """Lines that match, from the texts that the stored trigrams allow, in (path, line) order."""
        return search.top_results(self.matches(query, regex, path), max_results)

    def matches(self, query: str, regex: bool = False, path: str | None = None) -> DataFrame:
        view = self.view()
        found = self.candidates(query, regex, view)
        files = listing.as_text(view.current("files")) if found is None else self._met(view, found)
        return search.search_regex(files, query, path) if regex else search.search_substring(files, query, path)

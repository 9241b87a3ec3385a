"""Trigram index with position and successor masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.functions.regex import TrigramQuery, literal_trigrams
from treelode.schema import TRIGRAM_POSTINGS

FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
BLANK = np.isin(np.arange(256), [32, 9, 10, 13])
#: The successor of a text's last trigram, and both masks of a place (three bits) and a successor (four).
NO_NEXT = 8
MARKS = np.array([(1 << (code >> 4)) << 8 | (1 << (code & 15)) * (code & 15 < NO_NEXT) for code in range(128)], dtype=np.uint32).astype(np.uint16)


def postings(files: DataFrame, only: list[int] | None = None) -> DataFrame:
    """One row per (doc_id, trigram); ``files`` has ``doc_id BIGINT`` and ``text``.

    The masks of a document are folded inside its own task, so no per-byte row ever
    reaches a shuffle.  ``only`` keeps just the trigrams a query asks for.
    """
    wanted = None if only is None else np.array(sorted(only), dtype=np.int64)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            offsets, data = _binary_buffers(batch.column(1))
            for lo, hi in _chunks(offsets):
                docs, tri, nxt, loc = masks(offsets[lo:hi + 1], data, wanted)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).take(pa.array(docs)),
                        pa.array(tri.astype(np.int32)),
                        pa.array(nxt.astype(np.int32)),
                        pa.array(loc.astype(np.int32)),
                    ],
                    names=["doc_id", "tri", "next_mask", "loc_mask"],
                )

    return files.select("doc_id", F.col("text").cast("binary").alias("content")).mapInArrow(build, TRIGRAM_POSTINGS)


def _binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column; nulls count as empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)


def _chunks(offsets: np.ndarray, budget: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Document ranges of roughly ``budget`` bytes, to bound working memory."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1)
        yield lo, hi
        lo = hi


def masks(offsets: np.ndarray, data: np.ndarray, wanted: np.ndarray | None = None):
    """(document index, trigram, next_mask, loc_mask) of documents laid end to end.

    One number per byte holds its document, trigram, place and successor, so that a plain sort of
    numbers brings equal trigrams together.
    """
    base, stop = int(offsets[0]), int(offsets[-1])
    raw, sizes, ends = data[base:stop], np.diff(offsets), offsets[1:] - base
    empty = np.zeros(0, np.int64)
    if len(raw) < 3:
        return empty, empty, empty, empty
    folded, blank = FOLD[raw], BLANK[raw]
    good = np.zeros(len(raw), bool)
    good[:-2] = ~(blank[:-2] & blank[1:-1] & blank[2:])
    for back in (1, 2):
        good[ends[sizes >= back] - back] = False
    follow = np.zeros(len(raw), np.uint8)
    follow[:-3] = folded[3:] & 7
    follow[ends[sizes >= 3] - 3] = NO_NEXT
    place = np.arange(len(raw)).astype(np.uint8) - np.repeat((ends - sizes).astype(np.uint8), sizes)
    tri = np.zeros(len(raw), np.int64)
    tri[:-2] = (folded[:-2].astype(np.int32) << 16) | (folded[1:-1].astype(np.int32) << 8) | folded[2:]
    if wanted is not None:
        good &= np.isin(tri, wanted)
    key = np.repeat(np.arange(len(sizes)) << 31, sizes)
    key |= (tri << 7) | (place & 7) << 4 | follow
    key = np.sort(key[good])
    if len(key) == 0:
        return empty, empty, empty, empty
    marks, found = MARKS[key & 127], key >> 7
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    both, found = np.bitwise_or.reduceat(marks, first), found[first]
    return found >> 24, found & 0xFFFFFF, (both & 255).astype(np.uint8), (both >> 8).astype(np.uint8)


def candidates(index: DataFrame, query: str) -> DataFrame | None:
    """Documents that hold every trigram of ``query`` and pass the mask checks.

    None when the query is too short to prune.  All-whitespace trigrams are never
    indexed, so they are not asked for.
    """
    grams = literal_trigrams(query)
    if not grams:
        return None
    raw = query.encode("utf-8", "surrogateescape").lower()
    aggs = [F.count(F.lit(1)).alias("n")]
    sequence = [int.from_bytes(raw[i:i + 3], "big") for i in range(len(raw) - 2)]
    known = set(grams)
    for tri in grams:
        chosen = F.col("tri") == tri
        aggs.append(F.max(F.when(chosen, F.col("next_mask"))).alias(f"n{tri}"))
        aggs.append(F.max(F.when(chosen, F.col("loc_mask"))).alias(f"l{tri}"))
    ok = F.col("n") == len(grams)
    for i in range(len(sequence) - 1):
        a, b = sequence[i], sequence[i + 1]
        if a not in known or b not in known:
            continue
        loc = F.col(f"l{a}")
        rotated = F.shiftleft(loc, 1).bitwiseOR(F.shiftright(loc, 7)).bitwiseAND(F.lit(255))
        ok = ok & (F.col(f"n{a}").bitwiseAND(F.lit(1 << (raw[i + 3] % 8))) != 0)
        ok = ok & (rotated.bitwiseAND(F.col(f"l{b}")) != 0)
    return index.filter(F.col("tri").isin(grams)).groupBy("doc_id").agg(*aggs).filter(ok).select("doc_id")


def candidates_query(index: DataFrame, query: TrigramQuery) -> DataFrame:
    """Documents that satisfy the all-of and any-of trigrams of a decomposed pattern."""
    ok = F.lit(True)
    aggs = []
    for i, group in enumerate([query.all_of, *query.any_of]):
        aggs.append(F.sum(F.col("tri").isin(list(group)).cast("int")).alias(f"g{i}") if group else F.lit(0).alias(f"g{i}"))
    if query.all_of:
        ok = ok & (F.col("g0") == len(query.all_of))
    if query.any_of:
        some = F.lit(False)
        for i, group in enumerate(query.any_of, start=1):
            some = some | (F.col(f"g{i}") == len(group))
        ok = ok & some
    return index.filter(F.col("tri").isin(query.trigrams())).groupBy("doc_id").agg(*aggs).filter(ok).select("doc_id")


def merged(base: DataFrame, overlay: DataFrame, replaced: DataFrame) -> DataFrame:
    """Immutable base plus newer postings; ``replaced(doc_id)`` hides stale base rows."""
    return base.join(replaced.select("doc_id"), "doc_id", "left_anti").unionByName(overlay)


def lookup(index: DataFrame, tri: int) -> DataFrame:
    """Posting list of one trigram, by document."""
    return index.filter(F.col("tri") == tri).select("doc_id", "next_mask", "loc_mask")


def file_count(index: DataFrame) -> DataFrame:
    return index.agg(F.count_distinct("doc_id").alias("files"))


def sorted_runs(index: DataFrame) -> DataFrame:
    """Postings in one sorted run per task: nothing is shuffled or built twice, and page
    statistics find a trigram inside each run."""
    return index.sortWithinPartitions("tri", "doc_id")


def write_postings(index: DataFrame, target: str, git_head: str | None = None) -> None:
    """Sorted runs; a one-row header (document count, commit) is written last, beside them."""
    sorted_runs(index).write.mode("overwrite").parquet(f"{target}/postings")
    header = file_count(read_postings(index.sparkSession, target)).withColumn("git_head", F.lit(git_head).cast("string"))
    header.coalesce(1).write.mode("overwrite").parquet(f"{target}/header")


def read_postings(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/postings")


def read_header(spark: SparkSession, target: str) -> dict:
    return spark.read.parquet(f"{target}/header").first().asDict()

"""Exact top-k inner products by distributed histogram selection.

Vectors are turned into whole numbers, so scores are whole numbers too.  Every score of every
(query, candidate) pair is computed in each pass, against blocks of queries:

1. passes that count scores into a few bins per query, first over the whole possible range,
   then inside the bin that holds the k-th score, until that bin is a single value;
2. a pass that keeps scores above the k-th value, and of those equal to it the k with the
   smallest ids in each partition; ties are then broken by id.

A partition reports bins from the top only until it has counted k scores: bins below can't
hold the k-th score.  So what is shuffled grows with queries times k, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that travel with a task at once, and candidates scored at once.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 1024
BINS = 128
HIGHEST, SIGN = np.int64(2**63 - 1), np.uint64(1 << 63)


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``vec_id long, v array<bigint>``: floor(scale * x) of every component.

    Rows with a null id, a null vector, or a null or non-finite component are left out.
    """
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & finite).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"),
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, shorter ones filled with zeros (they add nothing)."""
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def scored(batches: Iterator[pa.RecordBatch], queries: np.ndarray, bound: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate ids and their scores against all queries, block after block.

    No score is larger than ``bound``.  Beyond 53 bits sums are taken in whole numbers, modulo
    2 ** 64; those that may not fit a long are cut to its range.
    """
    right, whole = queries.T.astype(np.float64), queries.T
    for batch in batches:
        for start in range(0, batch.num_rows, CANDIDATE_BLOCK):
            part = batch.slice(start, CANDIDATE_BLOCK)
            left = matrix(part.column("v"), queries.shape[1])
            scores = (left.astype(np.float64) @ right).astype(np.int64) if bound < 1 << 52 else left @ whole
            if bound >= 1 << 62:
                rough = left.astype(np.float64) @ right
                scores = np.where(rough >= 2.0**63, HIGHEST, np.where(rough <= -(2.0**63), -HIGHEST, scores))
            yield part.column("vec_id").to_numpy(), scores


def ordered(scores: np.ndarray) -> np.ndarray:
    """Scores as unsigned numbers in the same order, so that the difference of any two fits."""
    return scores.view(np.uint64) ^ SIGN


def select_block(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, bound: float) -> DataFrame:
    """The k best candidates of each query of one block: query_id, vec_id, score (ties included)."""
    n = len(ids)
    lowest = ordered(np.array([-(2**63) if bound >= 2.0**62 else -int(bound) - 1], np.int64))[0]
    span = 2**64 - int(lowest) if bound >= 2.0**62 else 2 * int(bound) + 2

    def histogram(low: np.ndarray, width: int, need: np.ndarray):
        """A task that counts ordered scores in [low, low + BINS * width) of each query, from the top."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((n, BINS), np.int64)
            column = np.arange(n)
            for own, scores in scored(batches, queries, bound):
                key = ordered(scores)
                at = (key - low) // np.uint64(width)
                good = (key >= low) & (at < BINS) & (own[:, None] != ids[None, :])
                flat = (column[None, :] * BINS + at.astype(np.int64))[good]
                counts += np.bincount(flat, minlength=n * BINS).reshape(n, BINS)
            from_top = counts[:, ::-1].cumsum(1)[:, ::-1]
            useful = (counts > 0) & (from_top - counts < need[:, None])
            q, b = np.nonzero(useful)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], ["q", "bin", "n"])

        return task

    low = np.full(n, lowest, np.uint64)
    need = np.full(n, k, np.int64)
    width = 1
    while width * BINS < span:
        width *= BINS
    done = np.zeros(n, bool)  # fewer than k candidates: everything is kept
    while True:
        rows = (
            candidates.mapInArrow(histogram(low, width, need), "q int, bin int, n bigint")
            .groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
        )
        counts = np.zeros((n, BINS), np.int64)
        counts[rows["q"].to_numpy(), rows["bin"].to_numpy()] = rows["n"].to_numpy()
        from_top = counts[:, ::-1].cumsum(1)[:, ::-1]
        reach = from_top >= need[:, None]
        done |= ~reach.any(1)
        at = np.where(reach.any(1), BINS - 1 - reach[:, ::-1].argmax(1), 0)
        over = np.where(reach.any(1), from_top[np.arange(n), at] - counts[np.arange(n), at], 0)
        need = np.where(done, need, need - over)
        low = np.where(done, lowest, low + at.astype(np.uint64) * np.uint64(width))
        if width == 1 or done.all():
            break
        width //= BINS
    kth = (low ^ SIGN).view(np.int64)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        names = ["query_id", "vec_id", "score"]

        def smallest() -> tuple[np.ndarray, np.ndarray]:
            q = np.concatenate([t[0] for t in ties])
            v = np.concatenate([t[1] for t in ties])
            order = np.lexsort((v, q))
            q, v = q[order], v[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            return q[rank < k], v[rank < k]

        for own, scores in scored(batches, queries, bound):
            other = own[:, None] != ids[None, :]
            r, q = np.nonzero(other & ((scores > kth) | done))
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[r]), pa.array(scores[r, q])], names)
            r, q = np.nonzero(other & (scores == kth) & ~done)
            if len(r):
                ties.append((q, own[r]))
                held += len(r)
                if held > 1 << 20:
                    ties[:] = [smallest()]
                    held = len(ties[0][0])
        if ties:
            q, v = smallest()
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(kth[q])], names)

    return candidates.mapInArrow(final, "query_id bigint, vec_id bigint, score bigint")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates.

    ``queries`` is a stated set of rows of the same shape; it goes through tasks in blocks of
    ``QUERY_BLOCK``.  A candidate with the query's own id takes no part.  Ties go to the smaller
    id.  Rows with a null id, a null vector, or a null or non-finite component take no part on
    either side; an empty vector scores 0.  Scores beyond a long are cut to it.  Vectors of different lengths are compared as if filled with zeros.
    Repeated candidate rows count one by one; a repeated query id is asked once for each distinct
    vector.  Fewer candidates than k give them all; empty tables give no rows.
    """
    candidates = whole_vectors(vectors, id_column, vector_column, scale)
    asked = whole_vectors(queries, id_column, vector_column, scale).distinct()
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    size = lambda df: df.agg(F.max(F.sqrt(norm)), F.max(F.size("v"))).first()
    (longest, wide), (longest_asked, wide_asked) = size(candidates), size(asked)
    empty = vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    parts = []
    if longest is not None and longest_asked is not None:
        width = max(1, wide, wide_asked)
        bound = max(1.0, longest * longest_asked * (1 + 1e-9))  # no inner product is larger
        rows: list[tuple] = []

        def flush() -> None:
            column = pa.array([r[1] for r in rows], pa.list_(pa.int64()))
            parts.append(select_block(candidates, np.array([r[0] for r in rows], np.int64), matrix(column, width), k, bound))
            rows.clear()

        for row in asked.orderBy("vec_id", "v").toLocalIterator():
            rows.append(tuple(row))
            if len(rows) == QUERY_BLOCK:
                flush()
        if rows:
            flush()
    found = empty
    for part in parts:
        found = found.unionAll(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Importance resampling towards a target text, with an exact distributed selection.

Hashed word n-grams are counted over the corpus and over the target; a bucket's gain is a scaled
log ratio of both.  A document's weight is the mean gain of its features, taken with arrays over
whole slices of the table; its score adds Gumbel noise made from its id, so the largest scores
are a weighted draw without replacement.

The k largest are found by quickselect over a written table of scores.  Each round takes a few
random rows of the range that is left as pivots, counts exactly how many rows lie below, at and
between them, and goes on in the gap that holds the k-th row, until a pivot is that row.  The
composite key (score, id, text hash, row number) is unique, so ties need no care.  Only the rows
up to the k-th are then sorted, by range, and ranked.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelode.llm.common import SLICE_BYTES, Scratch, bytes_of, per_process, text_slices
from treelode.operators.numbering import with_dense_numbers

BUCKETS, SCALE = 10_000, 1000
#: Words hashed column by column; longer ones are hashed one by one.
COLUMNS = 64
PIVOTS = 15
SCORED = "doc bigint, twin bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


class Crc:
    """CRC-32 of many byte strings at once."""

    def __init__(self) -> None:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
        self.table = table.astype(np.uint32)
        # after[n][i][b]: what byte i of a checksum, if b, becomes behind n more bytes.
        after = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
        for _ in range(COLUMNS):
            after.append(self.table[after[-1] & 255] ^ (after[-1] >> 8))
        self.after = np.stack(after).astype(np.uint32)

    def of(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        short = -np.minimum(lengths, COLUMNS)
        order = np.argsort(short, kind="stable")
        short, first = short[order], starts[order]
        for column in range(-int(short[0]) if len(order) else 0):
            live = int(np.searchsorted(short, -column, side="left"))
            state = out[order[:live]]
            out[order[:live]] = self.table[(state ^ data[first[:live] + column]) & 255] ^ (state >> 8)
        out ^= np.uint32(0xFFFFFFFF)
        for i in np.flatnonzero(lengths > COLUMNS):
            out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
        return out

    def with_byte(self, sums: np.ndarray, byte: int) -> np.ndarray:
        state = sums ^ np.uint32(0xFFFFFFFF)
        return self.table[(state ^ np.uint32(byte)) & 255] ^ (state >> 8) ^ np.uint32(0xFFFFFFFF)

    def joined(self, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Checksum of two strings in a row from those of both and the second one's length (up to COLUMNS)."""
        out = right.copy()
        for i in range(4):
            out ^= self.after[length, i, (left >> np.uint32(8 * i)) & 255]
        return out


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and row of every word of lower-cased texts; no word crosses rows."""
    word = (data >= 0x80) | ((data >= 0x30) & (data <= 0x39)) | ((data >= 0x61) & (data <= 0x7A))
    if not word.any():
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begins = np.flatnonzero(word & (~np.concatenate([[False], word[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(word & (~np.concatenate([word[1:], [False]]) | edge[1:])) + 1
    return begins, ends - begins, np.searchsorted(starts, begins, side="right") - 1


def pieces(data: np.ndarray, starts: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """Bytes, row starts, first row, and whether the first word was counted before.

    Rows above ``limit`` bytes are cut between words; a piece then begins with the last word of
    the one before, so that no pair of words is lost.
    """
    if len(data) <= limit:
        yield data, starts, 0, False
        return
    for row in range(len(starts) - 1):
        text, at, last = data[starts[row] : starts[row + 1]], 0, np.zeros(0, np.uint8)
        while at < len(text):
            gaps = np.flatnonzero(text[at + limit : at + 2 * limit] < 0x30)
            stop = at + limit + int(gaps[0]) if len(gaps) else len(text)
            part = np.concatenate([last, text[at:stop]])
            ends = np.array([0, len(part)])
            yield part, ends, row, len(last) > 0
            begins, lengths, _ = word_spans(part, ends)
            last = np.append(part[begins[-1] : begins[-1] + lengths[-1]], np.uint8(0x20)) if len(begins) else last
            at = stop


def bucketed(batch: pa.RecordBatch, column: str, buckets: int, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket and row of every feature, and the rows of the words, of pieces of a batch."""
    crc = per_process(("resample-crc",), Crc)
    data, starts = bytes_of(batch.column(column))
    lower = data + np.where((data >= 0x41) & (data <= 0x5A), 32, 0).astype(np.uint8)
    for part, at, base, again in pieces(lower, starts, limit):
        begins, lengths, row = word_spans(part, at)
        one = crc.of(part, begins, lengths)
        pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
        short = pair[lengths[pair + 1] <= COLUMNS]
        spaced = crc.with_byte(one, 0x20)
        two = [crc.joined(spaced[short], one[short + 1], lengths[short + 1])]
        two_row = [row[short]]
        for i in pair[lengths[pair + 1] > COLUMNS]:
            two.append(np.array([zlib.crc32(part[begins[i + 1] : begins[i + 1] + lengths[i + 1]], int(spaced[i]))], np.uint32))
            two_row.append(row[i : i + 1])
        one, own = (one[1:], row[1:]) if again else (one, row)
        feature = np.concatenate([one, *two]) % np.uint32(buckets)
        yield feature.astype(np.int64), np.concatenate([own, *two_row]) + base, own + base


def feature_counts(texts: DataFrame, column: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends ``buckets`` sums at most."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch, column):
                for feature, _, _ in bucketed(part, column, buckets):
                    counts += np.bincount(feature, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    sums = texts.select(column).mapInArrow(task, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of a bucket's smoothed shares in target and corpus."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = [float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], np.int64)


def noise(seed: int, doc: int | None) -> int:
    """Scaled Gumbel noise from the id; a null id counts as an empty one."""
    name = f"{seed}:{'' if doc is None else doc}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, seed: int, id_column: str, text_column: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket
    names = [field.split()[0] for field in SCORED.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                total, features, words = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for feature, row, word_row in bucketed(part, "text", len(shared.value)):
                    features += np.bincount(row, minlength=part.num_rows)
                    words += np.bincount(word_row, minlength=part.num_rows)
                    np.add.at(total, row, shared.value[feature])
                weight = total // np.maximum(features, 1)
                score = weight + np.array([noise(seed, d) for d in part.column("doc").to_pylist()], np.int64)
                columns = [part.column("doc"), part.column("twin"), *(pa.array(x) for x in (words, features, weight, score))]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text_column).alias("twin"), F.col(text_column).alias("text"))
    return rows.mapInArrow(task, SCORED)


KEY = ["down", "nameless", "who", "twin", "serial"]


def key_is(less: bool, values: tuple) -> Column:
    """Whether the composite key of a row is below (or else equal to) ``values``."""
    key = F.struct(*KEY)
    other = F.struct(*(F.lit(v).cast("boolean" if c == "nameless" else "long").alias(c) for c, v in zip(KEY, values)))
    return key < other if less else key == other


def nth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple:
    """The k-th smallest composite key (from 1) of ``rows``, which hold k rows at least."""
    low = high = None
    rank, round_ = k, 0
    while True:
        live = rows
        if low is not None:  # the scores alone reach the scan
            live = live.where((F.col("down") >= low[0]) & ~key_is(True, low) & ~key_is(False, low))
        if high is not None:
            live = live.where((F.col("down") <= high[0]) & key_is(True, high))
        random = F.xxhash64("serial", F.lit(round_))
        chosen = sorted(tuple(r) for r in live.select(*KEY).orderBy(random, "serial").limit(pivots).collect())
        # Even places lie between pivots, odd ones at a pivot.
        place = sum((F.when(key_is(True, p), 0).when(key_is(False, p), 1).otherwise(2) for p in chosen), F.lit(0))
        counts = {r["place"]: r["count"] for r in live.groupBy(place.alias("place")).count().collect()}
        for at in range(2 * len(chosen) + 1):
            n = counts.get(at, 0)
            if rank <= n:
                break
            rank -= n
        if at % 2:
            return chosen[at // 2]
        low = chosen[at // 2 - 1] if at else low
        high = chosen[at // 2] if at // 2 < len(chosen) else high
        round_ += 1


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS,
    id_column: str = "doc_id", text_column: str = "text", target_column: str = "text", pivots: int = PIVOTS,
) -> DataFrame:
    """Every row of ``docs`` with n_features, weight, score and rank (null where it isn't drawn).

    Of the rows with ``least_words`` words, ``percent`` in a hundred are drawn, rounded down.  A null
    text has no words; a null id draws its noise from an empty name and comes last among ties.
    Repeated rows are drawn one by one.  An empty target makes all gains those of the smoothing alone;
    an empty table gives no rows.  Columns beside id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    gains = gains_of(feature_counts(docs, text_column, buckets), feature_counts(target, target_column, buckets))
    scored = scores(docs, gains, seed, id_column, text_column).select(
        (-F.col("score")).alias("down"), F.col("doc").isNull().alias("nameless"), F.coalesce("doc", F.lit(0)).alias("who"), "twin",
        F.monotonically_increasing_id().alias("serial"), (F.col("n_words") >= least_words).alias("fit"), "n_features", "weight",
    )
    scored = scratch.save(scored, "scored")
    k = scored.where("fit").count() * percent // 100
    drawn = F.lit(False)
    ranked = scored.limit(0).withColumn("rank", F.lit(0).cast("long"))
    if k:
        last = nth_key(scored.where("fit"), k, pivots)
        drawn = F.col("fit") & (F.col("down") <= last[0]) & (key_is(True, last) | key_is(False, last))
        winners = scored.where(drawn).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
        ranked = with_dense_numbers(winners, "rank", lambda df: scratch.save(df, "winners"), first=1)
    rows = ranked.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))
    return rows.select(
        F.when(~F.col("nameless"), F.col("who")).alias(id_column), "n_features", "weight", (-F.col("down")).alias("score"), "rank"
    )

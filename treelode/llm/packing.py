"""Packing token sequences by bounded-space online best fit.

Each partition keeps a fixed number of open windows.  Whole windows are cut off long documents
first; what is left of a document goes into the open window where it fits best.  When it fits
nowhere and no window is free, the fullest window is emitted.  Windows still open at the end of
a partition are leftovers: their pieces are packed again by fewer and fewer tasks, and the last
task closes its windows.

The tokenized pieces are written once; leftover rounds move only the pieces of open windows, at
most ``OPEN`` windows from each task, whatever the input.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelode.llm.common import Scratch, per_process, text_slices

WINDOW = 1024
#: Open windows per partition, and partitions that one leftover task takes together.
OPEN, FAN_IN = 64, 16
#: Characters for which both libraries split words alike (tests compare them one by one).
SAFE = re.compile("[\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20b5]*\\Z")
SPECIAL = "<|endoftext|>"
PIECE = "doc_id bigint, start bigint, length int, doc_tokens bigint, ids binary"


def tokenizer(json_path: str, ranks_path: str | None):
    """Text -> ids of the tokenizer file.

    The file's own library is exact for every text.  Where ``ranks_path`` gives the same
    vocabulary as ranks, a faster library encodes the texts for which both are alike: those of
    safe characters without special strings.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(json_path)
    if not ranks_path:
        return lambda text: own.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL in text or not SAFE.match(text):
            return own.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class OpenWindows:
    """At most ``limit`` windows that still take pieces; what is emitted goes to ``closed``."""

    def __init__(self, size: int, limit: int) -> None:
        self.size, self.limit = size, limit
        self.windows: list[list] = []
        self.room: list[int] = []
        self.closed: list[list] = []

    def place(self, piece: tuple, length: int) -> None:
        best = -1
        for i, room in enumerate(self.room):
            if length <= room and (best < 0 or room < self.room[best]):
                best = i
        if best < 0:
            if len(self.windows) == self.limit:
                self.emit(min(range(self.limit), key=self.room.__getitem__))
            self.windows.append([piece])
            self.room.append(self.size - length)
            return
        self.windows[best].append(piece)
        self.room[best] -= length
        if not self.room[best]:
            self.emit(best)

    def emit(self, i: int) -> None:
        self.closed.append(self.windows.pop(i))
        self.room.pop(i)


def piece_batch(windows: list[list], first: int, closed: bool) -> pa.RecordBatch:
    """Rows of pieces (doc_id, start, length, doc_tokens, ids) with their window and offset."""
    rows = [(*piece, first + w, offset, closed) for w, window in enumerate(windows) for piece, offset in zip(window, starts(window))]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "closed"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def starts(window: list) -> list[int]:
    return np.cumsum([0, *(piece[2] for piece in window)])[:-1].tolist()


ROW = f"{PIECE}, sequence_id bigint, offset bigint, closed boolean"


def sequence_base(round_number: int) -> int:
    """Sequence ids: the round in the top bits, then the task, then a running number."""
    from pyspark import TaskContext

    return (round_number << 58) | (TaskContext.get().partitionId() << 34)


def first_round(docs: DataFrame, encode_of, id_column: str, text_column: str, end_id: int, window: int, limit: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_process(("encoder", encode_of), lambda: tokenizer(*encode_of))
        space, number = OpenWindows(window, limit), sequence_base(0)
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                for doc, value in zip(part.column("id").to_pylist(), part.column("text")):
                    ids = np.array([*encode(value.as_py() or ""), end_id], "<u4")
                    n = len(ids)
                    whole = n - n % window
                    for start in range(0, whole, window):
                        space.closed.append([(doc, start, window, n, ids[start : start + window].tobytes())])
                    if whole < n:
                        space.place((doc, whole, n - whole, n, ids[whole:].tobytes()), n - whole)
                if space.closed:
                    yield piece_batch(space.closed, number, True)
                    number += len(space.closed)
                    space.closed = []
        if space.windows:
            yield piece_batch(space.windows, number, False)

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(task, ROW)


def next_round(leftovers: DataFrame, tasks: int, round_number: int, window: int, limit: int) -> DataFrame:
    """Pack the pieces of open windows again, in ``tasks`` tasks; the only task closes all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, number = OpenWindows(window, limit), sequence_base(round_number)
        pieces: list[tuple] = []
        for batch in batches:
            pieces += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids")))
        # At most FAN_IN * limit windows meet here: longest first packs them tightest.
        pieces.sort(key=lambda p: (-p[2], p[0] if p[0] is not None else -1, p[1], p[4]))
        for piece in pieces:
            space.place(piece, piece[2])
        if space.closed:
            yield piece_batch(space.closed, number, True)
        if space.windows:
            yield piece_batch(space.windows, number + len(space.closed), tasks == 1)

    moved = leftovers.select("doc_id", "start", "length", "doc_tokens", "ids", "group")
    return moved.repartition(tasks, "group").mapInArrow(task, ROW)


def pack(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, id_column: str = "doc_id", text_column: str = "text",
    end_id: int = 0, window: int = WINDOW, open_windows: int = OPEN, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32 bit),
    sequence_id, offset.

    Every document ends with ``end_id``; a null or empty text is that id alone.  A piece is a
    whole window of a long document, or what is left of a document.  Rows with a null id and
    repeated rows are packed like any other; other columns are ignored; an empty table gives no
    rows.  A sequence shorter than the window is padded by the reader.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.save(first_round(docs, (json_path, ranks_path), id_column, text_column, end_id, window, open_windows), "round-0")
    whole = rows.where("closed")
    left = rows.where("not closed")
    task_of = (F.col("sequence_id").bitwiseAND((1 << 58) - 1) / (1 << 34)).cast("long")
    tasks = left.select(F.countDistinct(task_of)).first()[0]
    number = 0
    while tasks:
        number += 1
        tasks = -(-tasks // fan_in)
        grouped = left.withColumn("group", (task_of % tasks) if tasks > 1 else F.lit(0).cast("long"))
        rows = scratch.save(next_round(grouped, tasks, number, window, open_windows), f"round-{number}")
        whole, left = whole.unionByName(rows.where("closed")), rows.where("not closed")
        if tasks == 1:
            break
        tasks = left.select(F.countDistinct(task_of)).first()[0]
    return whole.drop("closed")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Whole sequences: sequence_id, n_tokens and ids, padded unless their length is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").cast("int").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    blank = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), F.when(power, 0).otherwise(F.lit(window) - F.col("n_tokens"))))
    ids = F.aggregate("parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"]))
    return joined.select("sequence_id", "n_tokens", F.concat(ids, blank).alias("ids"))

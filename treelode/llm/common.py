"""Helpers shared by the training-data operators: tables, shared scratch space, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.session import checkpoint_root

WRITE_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}
#: Text bytes handled at once inside a task, so that working arrays stay small.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop, whatever store it lies in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written once into the shared checkpoint folder, where lost executors don't hurt them.

    Each instance owns a fresh folder.  ``drop`` removes a table that no later step reads;
    what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back: one computation, no lineage before it.

        Nothing reads the shuffles of the finished write again, so their files go at once.
        Whole texts travel to Python in small batches.
        """
        before = {key: self.spark.conf.get(key) for key in WRITE_CONF}
        for key, value in WRITE_CONF.items():
            self.spark.conf.set(key, value)
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))

    def _at_exit(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete_path(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            pass


def one_each(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` with one row of each ``key``.  Only keys that repeat are shuffled with their texts,
    folded where they lie."""
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    if repeated.isEmpty():
        return rows
    several = rows.join(repeated, list(key), "left_semi").dropDuplicates(list(key))
    return rows.join(repeated, list(key), "left_anti").select(*rows.columns).unionByName(several.select(*rows.columns))


def per_process(key: tuple, make):
    """A value that one Python worker builds once and keeps for its later tasks.

    Task functions travel by value, so their module globals are new in every task; an
    entry of ``sys.modules`` is what lasts as long as the process.
    """
    store = sys.modules.setdefault("_treelode_per_process", types.ModuleType("_treelode_per_process")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def forget(key: tuple) -> None:
    store = sys.modules.get("_treelode_per_process")
    if store is not None:
        store.__dict__.pop(key, None)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch of about ``limit`` text bytes (one row at least)."""
    lengths = np.diff(offsets_of(batch.column(column)))
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, base + limit, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def offsets_of(array: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, one more than it has rows; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    buffer = array.buffers()[1]
    if buffer is None or len(array) == 0:
        return np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(buffer, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array as one vector, and where each row starts in it."""
    offsets = offsets_of(array)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory of this process to the system, where its allocator keeps it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

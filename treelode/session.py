"""Session defaults and the two placement helpers every plan shares."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The JVM never compiles a method of more than 8,000 bytes.  Plans that come out larger as one method
#: run as one method per expression instead, which is compiled.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of Arrow batches are often whole files.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.parquet.filterPushdown": "true",
    **COMPILED,
    # Keyed state with timers needs it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


@dataclass(frozen=True)
class Budget:
    """Ingest limits; a value that is not a whole number falls back to its default."""

    max_ram_mb: int = 3800
    target_seconds: int = 60
    batch_min_files: int = 32
    batch_max_files: int = 256

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Budget:
        names = {
            "max_ram_mb": "TREELODE_MAX_RAM_MB", "target_seconds": "TREELODE_INDEX_TARGET_SECONDS",
            "batch_min_files": "TREELODE_BATCH_MIN_FILES", "batch_max_files": "TREELODE_BATCH_MAX_FILES",
        }
        given = {field: env.get(name, "") for field, name in names.items()}
        return cls(**{field: int(text) for field, text in given.items() if text.isdecimal()})

    def conf(self) -> dict[str, str]:
        """Spark settings the budget stands for: memory, and files per Arrow batch."""
        return {
            "spark.driver.memory": f"{self.max_ram_mb}m", "spark.executor.memory": f"{self.max_ram_mb}m",
            "spark.sql.execution.arrow.maxRecordsPerBatch": str(self.batch_max_files),
        }


def build_session(app: str = "treelode", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def compiled(df: DataFrame) -> DataFrame:
    """``df``, in a session that compiles its large expressions; see ``COMPILED``."""
    for key, value in COMPILED.items():
        df.sparkSession.conf.set(key, value)
    return df


def spread(df: DataFrame, rows_per_task: int | None = None, *order: str) -> DataFrame:
    """Give a narrow, CPU-heavy plan at least one partition per core.

    A small table arrives as a single Parquet row group, hence as one task.  Such an
    input is redistributed.  A large input already has more splits than cores and is
    returned untouched, so no text is ever shuffled just for balance.

    With ``rows_per_task`` the narrow rows of a table, of which each becomes much work, are dealt
    out by their number: splits follow bytes, and a split may hold many row groups or none.  With
    ``order`` a task gets a range of them, so that what follows can fold neighbours in the task.
    """
    spark = df.sparkSession
    wanted = spark.sparkContext.defaultParallelism
    if rows_per_task is not None:
        wanted = max(wanted, -(-df.count() // rows_per_task))
        return df.repartitionByRange(wanted, *order) if order else df.repartition(wanted)
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) is a temporary folder used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        root = current or tempfile.mkdtemp(prefix="treelode-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder; survives executor loss."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)

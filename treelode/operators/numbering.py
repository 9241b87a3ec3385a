"""Dense row numbers without a sort or a shuffle, and sets of them as bits.

Each task numbers its own rows while they are written; a second, narrow pass over the written
table adds how many rows the tasks before it wrote.  Only one count per task is gathered.

Rows of whole texts meet a set of numbers as words of 64 bits, so that the set is sent to the texts
and no text is shuffled to find it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: ``monotonically_increasing_id`` holds the task above this bit and the row below it.
TASK_BIT = 33
#: Numbers of one word of bits, as a power of two, and words of a set that is sent to every task; a
#: larger one is joined as Spark chooses.
WORD_BITS, SENT = 6, 1 << 20


def starts_by_task(marked: DataFrame, mark: str) -> DataFrame:
    """part, start: rows of earlier tasks, for each task that wrote rows (one row per task)."""
    counts = marked.groupBy(F.shiftright(mark, TASK_BIT).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def with_dense_numbers(df: DataFrame, column: str, save: Callable[[DataFrame], DataFrame], first: int = 0) -> DataFrame:
    """``df`` with ``column``: numbers from ``first`` without gaps, in partition and row order.

    ``save`` writes a table to shared storage and returns it as read back, so numbers stay the same
    however often the result is computed.
    """
    mark = f"{column}_mark"
    marked = save(df.withColumn(mark, F.monotonically_increasing_id()))
    starts = starts_by_task(marked, mark)
    part = F.shiftright(mark, TASK_BIT)
    inside = F.col(mark).bitwiseAND(F.lit((1 << TASK_BIT) - 1))
    joined = marked.join(F.broadcast(starts), part == starts["part"])
    return joined.withColumn(column, F.lit(first).cast("long") + F.col("start") + inside).select(*df.columns, column)


def as_bits(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """word, bits: the set of all numbers in ``column``, 64 in a row at most."""
    number = F.col(column).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(F.lit(63)).cast("int"))
    return ids.where(number.isNotNull()).groupBy(F.shiftright(number, WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))


def marked_in(rows: DataFrame, bits: DataFrame, mark: str, column: str = "doc_id") -> DataFrame:
    """Rows whose number is in the set ``bits``; both sides decide the column ``mark``, which is true."""
    number = F.col(column).cast("bigint")
    small = bits.limit(SENT + 1).count() <= SENT
    met = rows.withColumn("word", F.shiftright(number, WORD_BITS)).join(F.broadcast(bits) if small else bits, "word")
    held = F.getbit("bits", number.bitwiseAND(F.lit(63)).cast("int")) == 1
    return met.withColumn(mark, held).where(mark).drop("word", "bits")

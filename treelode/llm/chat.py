"""Chat formatting by perspective rotation.

A dialogue is rendered once for every participant: that speaker's turns become the assistant's,
every other speaker a user with a name, and system turns stay.  The mask marks the characters
to learn: the content of the assistant's turns and the end mark after it.

Dialogues come out in parts of at most ``part_turns`` turns, each one text, with the character
offset at which it starts; a dialogue of usual length is one part.  Turns are dealt out by range
over (conversation, turn), so one endless dialogue is spread over many tasks: places inside it come from
sums per range.  Offsets come from one slim row per part; no text passes that window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelode.llm.common import Scratch

PART_TURNS = 256
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame) -> DataFrame:
    """Add ``place``: the rank of a turn in its dialogue (ties by role, then text), from 0.

    Range partitions are numbered inside, and each dialogue's rows in earlier partitions are
    added: a sum over (partition, dialogue) pairs, however long the dialogue.  The ranges are
    sampled, so the numbered rows are written before anything reads them twice.
    """
    order = ["conv", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    placed = turns.repartitionByRange(*order).withColumn("pid", F.spark_partition_id())
    inside = Window.partitionBy("pid", "conv").orderBy(*order[1:])
    placed = Scratch(turns.sparkSession, "chat").save(placed.withColumn("inside", F.row_number().over(inside) - 1), "placed")
    sizes = placed.groupBy("pid", "conv").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("pid", "conv", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"))
    return placed.join(starts, ["pid", "conv"]).select("conv", "turn", "role", "text", (F.col("inside") + F.col("earlier")).alias("place"))


def rotate(
    turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row per (dialogue, perspective, part): ``conv_id, perspective, part, start_char,
    n_turns, n_masked, text, masks``; ``masks`` are [start, end) character pairs in ``text``.

    Null texts are empty; a null role is the participant ``unknown``; rows with a null
    conversation are left out; null turn numbers come first; equal turn numbers are ordered by
    role and text; repeated rows are turns of their own.  Role names are lower-cased and
    trimmed.  A dialogue of system turns only has no participants and gives no rows.  Other
    columns are ignored.
    """
    role = F.lower(F.trim(F.coalesce(F.col(role_column).cast("string"), F.lit("unknown"))))
    clean = turns.where(F.col(conv_column).isNotNull()).select(
        F.col(conv_column).alias("conv"), F.col(turn_column).alias("turn"), role.alias("role"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    placed = numbered(clean)
    in_part = placed.groupBy("conv", F.floor(F.col("place") / part_turns).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    )
    people = clean.where(F.col("role") != SYSTEM).groupBy("conv", "role").agg(F.count(F.lit(1)).alias("said")).select("conv", F.col("role").alias("who"))
    seen = in_part.join(people, "conv")
    header = F.transform(
        "turns",
        lambda t: F.concat(
            F.lit(START),
            F.when(t["role"] == F.col("who"), F.lit("assistant")).when(t["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), t["role"])),
            F.lit("\n"),
        ),
    )
    seen = seen.withColumn("heads", header)
    lengths = F.transform(F.arrays_zip("turns", "heads"), lambda x: F.char_length(x["heads"]) + F.char_length(x["turns"]["text"]) + F.lit(len(END) + 1))
    seen = seen.withColumn("lengths", lengths).withColumn("chars", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    # The running start of each turn, by folding the lengths once.
    fold = F.aggregate(
        F.arrays_zip("turns", "heads", "lengths"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("masks")),
        lambda a, x: F.struct(
            (a["at"] + x["lengths"]).alias("at"),
            F.when(
                x["turns"]["role"] == F.col("who"),
                F.concat(a["masks"], F.array(F.array(a["at"] + F.char_length(x["heads"]), a["at"] + x["lengths"] - 1))),
            ).otherwise(a["masks"]).alias("masks"),
        ),
        lambda a: a["masks"],
    )
    pieces = F.transform(F.arrays_zip("turns", "heads"), lambda x: F.concat(x["heads"], x["turns"]["text"], F.lit(f"{END}\n")))
    parts = seen.select(
        "conv", "who", "part", "chars", F.size("turns").alias("n_turns"), F.array_join(pieces, "").alias("text"), fold.alias("masks"),
    )
    # Offsets come from rows without texts; every part then meets its own, under a key of its own.
    parts = Scratch(turns.sparkSession, "chat").save(parts, "parts")
    earlier = Window.partitionBy("conv", "who").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv", "who", "part", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).cast("long").alias("start_char"))
    return parts.join(starts, ["conv", "who", "part"]).select(
        F.col("conv").alias(conv_column), F.col("who").alias("perspective"), F.col("part").cast("int").alias("part"),
        "start_char", F.col("n_turns"), F.size("masks").alias("n_masked"), "text", "masks",
    )

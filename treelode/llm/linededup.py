"""Repeated lines dropped by a range partition of line hashes, streamed in document order.

1. Lines are hashed in the scan (128 bits); what is written is hash, document and position.
2. Frequent hashes, at most ``HOT`` of them, are found by a sketch of fixed size.  Their first
   document is a minimum, folded before the shuffle; those few rows are broadcast, and lines with
   such a hash are decided where they lie.
3. All other lines are range-partitioned by hash and sorted by hash, document and position, so
   that a partition streams through each hash and knows its first document.
4. Dropped positions are folded to words of 64 lines: a compressed bitmap per document.  Texts
   take no part until ``kept_texts`` applies the bitmaps.

A document is its id: rows that share one are one document.  Rows without an id are told apart by
their texts, come after all others and are ordered by a hash of the text; equal ones are one
document.  Everything is DataFrame functions.  A text and its lines must fit in the memory of one
task, since a row is not cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelode.llm.common import Scratch

#: Stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent hashes decided by broadcast, hashes the sketch tracks, least lines of such a hash.
HOT, TRACKED, HOT_LINES = 1000, 20_000, 64
#: What tells documents and rows apart: no id, id (or hash of the text), hash of the text.
OWNER = ["nameless", "who", "twin"]


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def owners(docs: DataFrame, id_column: str, text_column: str, *others: str) -> DataFrame:
    """nameless, who, twin, text, and ``others`` as carry_0, carry_1, ..."""
    doc, twin = F.col(id_column).cast("long"), F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    return docs.select(
        doc.isNull().alias("nameless"), F.coalesce(doc, twin).alias("who"), twin.alias("twin"), F.col(text_column).alias("text"),
        *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(others)),
    )


def hashed_lines(docs: DataFrame, id_column: str, text_column: str, least: int) -> DataFrame:
    """a, b (hash halves), owner and position of every line whose key has ``least`` code points."""
    lines = owners(docs, id_column, text_column).select(*OWNER, F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select(*OWNER, "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= least)
    key = lowered(F.col("key"))
    return keys.select(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"), *OWNER, "pos")


def frequent(lines: DataFrame, hot: int) -> list[int]:
    """First halves of the hashes that hold more than one line in ``hot``, ``hot`` at most."""
    row = lines.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(a, {hot}, {max(hot, TRACKED)})").alias("top")).first()
    least = max(HOT_LINES, row["n"] // hot)
    return [x["item"] for x in row["top"] or () if x["item"] is not None and x["count"] > least]


def repeated_lines(lines: DataFrame, hot: int = HOT) -> DataFrame:
    """Owner and position of the lines whose hash a smaller document holds too."""
    values = frequent(lines, hot)
    is_hot = F.col("a").isin(values) if values else F.lit(False)
    columns = [*OWNER, "pos"]

    named = F.min(F.when(~F.col("nameless"), F.col("who"))).alias("named")
    unnamed = F.min(F.when(F.col("nameless"), F.col("who"))).alias("unnamed")
    firsts = lines.where(is_hot).groupBy("a", "b").agg(named, unnamed)  # one row per frequent hash
    later = F.when(F.col("nameless"), F.col("named").isNotNull() | (F.col("who") > F.col("unnamed"))).otherwise(F.col("who") > F.col("named"))
    by_broadcast = lines.where(is_hot).join(F.broadcast(firsts), ["a", "b"]).where(later).select(*columns)

    inside = Window.partitionBy("a", "b").orderBy("nameless", "who", "twin", "pos").rowsBetween(Window.unboundedPreceding, 0)
    streamed = (
        lines.where(~is_hot).repartitionByRange("a", "b")
        .select(*columns, F.first("nameless").over(inside).alias("first_nameless"), F.first("who").over(inside).alias("first_who"))
        .where((F.col("nameless") != F.col("first_nameless")) | (F.col("who") != F.col("first_who")))
        .select(*columns)
    )
    return streamed.unionByName(by_broadcast)


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 10, hot: int = HOT) -> DataFrame:
    """nameless, who, twin, ``keep`` and ``n_dropped`` of each document that loses lines.

    ``keep`` is a sparse bitmap, ``array<struct<word, bits>>``: bit ``i`` of word ``w`` says whether
    line ``64 * w + i`` stays.  Words that are not listed stay whole.  Null texts are one empty line;
    an empty table gives no rows; columns beside id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(hashed_lines(docs, id_column, text_column, least), "lines")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    words = repeated_lines(lines, hot).groupBy(*OWNER, F.floor(F.col("pos") / 64).alias("word")).agg(F.bit_or(bit).alias("gone"))
    bitmaps = words.groupBy(*OWNER).agg(
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
    )
    bitmaps = scratch.save(bitmaps, "bitmaps")
    scratch.drop("lines")
    return bitmaps


def kept_texts(
    docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, ``carry``, ``n_lines``, ``n_dropped`` and ``kept``, the lines that stay."""
    # A word for every 64 lines up to the last listed one, so that a line finds its word at once.
    gap = lambda w, i: F.when(i == 0, w["word"]).otherwise(w["word"] - F.get("keep", i - 1)["word"] - 1).cast("int")
    filled = F.transform("keep", lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(w, i)), F.array(w["bits"])))
    dense = bitmaps.select(*OWNER, "n_dropped", F.flatten(filled).alias("dense"))
    rows = owners(docs, id_column, text_column, id_column, *carry).join(dense, OWNER, "left")
    stays = lambda _, i: F.coalesce(F.getbit(F.get("dense", F.floor(i / 64).cast("int")), i % 64), F.lit(1)) == 1
    lines = lines_of(F.col("text"))
    left = F.when(F.col("dense").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return rows.select(
        *(F.col(f"carry_{i}").alias(c) for i, c in enumerate((id_column, *carry))),
        F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), left.alias("kept"),
    )


def deduplicate(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 10, carry: tuple[str, ...] = (), hot: int = HOT,
) -> DataFrame:
    """Lines whose key (stripped of ASCII blanks, A-Z lower-cased, ``least`` code points or more) a
    smaller document holds too are dropped; the first document keeps all of its own.

    Returns what ``kept_texts`` does.  Repeated rows get the same result each.
    """
    return kept_texts(docs, keep_bitmaps(docs, id_column, text_column, least, hot), id_column, text_column, carry)

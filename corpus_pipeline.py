"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes what it returns as Parquet in the
shared checkpoint folder and hands the rows read back to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.llm import decontaminate, jaccard, quality, suffixdedup
from treelode.llm.common import Scratch, table
from treelode.llm.queries import packed


ROW_KEY = "row_key"


def row_key(docs: DataFrame) -> Column:
    """With the id, what tells rows apart that differ in any column, nulls included."""
    return F.xxhash64(*(F.col(c).isNull() for c in docs.columns), *(F.col(c) for c in docs.columns))


def rows_with(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents whose id, null included, and row key are among ``chosen``, and its other
    columns; ``chosen`` holds a pair once."""
    wanted = chosen.withColumnsRenamed({"doc_id": "wanted", ROW_KEY: "wanted_key"})
    same = docs["doc_id"].eqNullSafe(wanted["wanted"]) & (row_key(docs) == wanted["wanted_key"])
    return docs.join(wanted, same).drop("wanted", "wanted_key")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality operator keeps."""
    keyed = docs.withColumn(ROW_KEY, row_key(docs))
    kept = quality.assess(keyed, table(spark, sf_dir, "labels"), carry=(ROW_KEY,)).where("keep")
    return rows_with(docs, kept.select("doc_id", ROW_KEY).distinct())


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest id, null ids last, repeated rows being one; and
    every row that is linked with nothing because it has no words."""
    rows = jaccard.grouped(docs, row_key(docs)).withColumnRenamed("key", ROW_KEY)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW_KEY)).alias("first")
    heads = rows.where("component is not null").groupBy("component").agg(first).select("first.doc_id", f"first.{ROW_KEY}", F.lit(True).alias("head"))
    alone = rows.where("component is null").select("doc_id", ROW_KEY, F.lit(False).alias("head")).distinct()
    chosen = Scratch(spark, "heads").save(heads.unionByName(alone), "chosen")
    kept = rows_with(docs, chosen)
    # Only rows that are the same in all columns can still share an id and a row key with a head.
    held = kept.where("head").select("doc_id", row_key(docs).alias(ROW_KEY))
    if held.groupBy("doc_id", ROW_KEY).count().where("count > 1").isEmpty():
        return kept.drop("head")
    once = kept.where("head").withColumn(ROW_KEY, row_key(docs)).dropDuplicates(["doc_id", ROW_KEY]).drop(ROW_KEY)
    return once.unionByName(kept.where("not head")).drop("head")


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that an earlier 100-byte string covers."""
    return suffixdedup.deduplicated_documents(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; what op1_packing returns, over the documents that are left."""
    return packed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_passage_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            scratch.drop(f"stage-{number - 1}")
    return docs

"""A corpus prepared for training: good documents, one of each group of near copies, without test items, masked and packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeglass.llm import decontaminate, near_dedup, packing, pii, quality
from tomeglass.session import cut_lineage, ship_package


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts by their texts; a missing text counts as an empty one."""
    ship_package(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the least doc_id: shingles of five words, similarity of 0.8 or more.

    Rows are numbered and judged one by one by their texts: repeated rows are copies, rows that share a doc_id are not for
    that reason, a row without doc_id stays only if no row of its group has one, and texts without words have no copies.
    """
    ship_package(spark)
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = numbered.select(F.col(row).alias("doc_id"), "text")
    groups = near_dedup.near_duplicates(texts, near_dedup.Method(shingle=5, percent=80)).select(F.col("doc_id").alias(row), "component_id")
    ids = cut_lineage(numbered.select(row, "doc_id").join(groups, row))
    least = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("least"))
    dropped = ids.join(least.select(F.col(f"least.{row}").alias(row)), row, "left_anti")
    return numbered.join(dropped.select(row), row, "left_anti").select(docs.columns)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of the benchmark, whatever their doc_id; a missing text holds none."""
    ship_package(spark)
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data and secrets in the texts masked and ``n_chars``, if there is one, brought up to date.

    A missing text stays missing, with as many characters as before.
    """
    ship_package(spark)
    hidden = pii.mask_pii(docs)
    if "n_chars" not in docs.columns:
        return hidden
    n_chars = F.coalesce(F.char_length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return hidden.withColumn("n_chars", n_chars)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their ids, placed in sequences of at most 1024 tokens; a missing text is packed as an empty one."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_test_items),
    ("pii", masked),
    ("packing", packed),
]

# A fitted classifier, sketches and a tokenizer cannot be stated in SQL; a test compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

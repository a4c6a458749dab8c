"""Text files whose line number is the record key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeglass.functions import text as tx
from tomeglass.functions import vectors as vx
from tomeglass.functions.joins import BROADCAST_ROWS

# Positions and the header word of the wide corpus file.
TITLE_AT = 1
ABSTRACT_AT = 5
VECTOR_AT = 12
HEADER_WORD = "vector_bert"


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(line_no, line), numbered from 0 in file order without gaps.

    A folder counts through its files by the number in their part name, which may have more digits than the usual five,
    and by name where there is none.

    ``keep`` is a condition on ``line``; lines failing it are not counted. Rows are numbered inside each file split
    by the scan itself. Only one row per split is gathered to add the lengths of the splits before it.
    """
    files = spark.read.text(path)
    lines = files.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    if keep is not None:
        lines = lines.where(keep)
    lines = lines.withColumn("seq", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    before = Window.orderBy(*part_order(F.col("file")), "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "start", "first_seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    # A file has at most one split more than it fills read partitions, so their number is known without a job.
    most_splits = len(files.inputFiles()) + files.rdd.getNumPartitions()
    if most_splits <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return lines.join(offsets, ["file", "start"]).select(
        (F.col("offset") + F.col("seq") - F.col("first_seq")).alias("line_no"), "line"
    )


def part_order(file: Column) -> list[Column]:
    """Folder, number of the part, name: ``part-100000`` follows ``part-99999``."""
    number = F.regexp_extract(file, r"part-(\d+)[^/]*$", 1)
    return [F.regexp_extract(file, r"^(.*/)?", 0), F.when(number != "", number.cast("bigint")), file]


def line_aligned(spark: SparkSession, paths: Mapping[str, str], index: DataFrame) -> DataFrame:
    """Join text files by line number for the lines listed in ``index(doc_id, line_no)``.

    One column per entry of ``paths``. A file that ends early gives NULL. Every join uses the same key, so each
    file is shuffled once.
    """
    rows = index.select("doc_id", "line_no")
    for name, path in paths.items():
        rows = rows.join(numbered_lines(spark, path).withColumnRenamed("line", name), "line_no", "left")
    return rows


def corpus_from_lines(spark: SparkSession, paths: Mapping[str, str], index: DataFrame) -> DataFrame:
    """The document table from the files ``text``, ``title``, ``uri``, ``year`` and ``university``."""
    raw = line_aligned(spark, paths, index)
    return raw.select(
        "doc_id",
        tx.title_or_default(F.col("title")).alias("title"),
        tx.abstract_after_title(F.col("text"), F.col("title")).alias("abstract"),
        "uri",
        F.col("year").alias("year_raw"),
        tx.parse_year(F.col("year")).alias("year"),
        tx.none_to_null(F.col("university")).alias("university"),
    )


def wide_tsv(
    spark: SparkSession, path: str, title_at: int = TITLE_AT, abstract_at: int = ABSTRACT_AT, vector_at: int = VECTOR_AT
) -> DataFrame:
    """(doc_id, title, abstract, embedding) by position; doc_id counts the lines from 0 without the header.

    A line with too few cells keeps its number and has NULLs for what it lacks; ``short_lines`` lists such lines.
    """
    cells = F.split("line", "\t")
    return numbered_lines(spark, path, keep=_is_data(vector_at)).select(
        F.col("line_no").alias("doc_id"),
        F.get(cells, F.lit(title_at)).alias("title"),
        F.get(cells, F.lit(abstract_at)).alias("abstract"),
        vx.parse_vector(F.get(cells, F.lit(vector_at))).alias("embedding"),
    )


def short_lines(spark: SparkSession, path: str, vector_at: int = VECTOR_AT) -> DataFrame:
    """(doc_id, cells) of the lines of a wide TSV that end before the vector's cell."""
    cells = F.size(F.split("line", "\t"))
    lines = numbered_lines(spark, path, keep=_is_data(vector_at))
    return lines.select(F.col("line_no").alias("doc_id"), cells.alias("cells")).where(F.col("cells") <= vector_at)


def _is_data(vector_at: int) -> Column:
    """Not the header; a line without that cell is data."""
    return ~F.get(F.split("line", "\t"), F.lit(vector_at)).eqNullSafe(F.lit(HEADER_WORD))

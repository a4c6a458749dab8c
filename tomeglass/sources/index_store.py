"""The text index on disk: postings bucketed by document, with the small statistics beside them."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeglass.operators.lexical import TextIndex, by_document, field_stats, postings, term_counts, term_grams, token_arrays


# Text of a bucket. Its postings, several times that, are sorted by one task and read by one task.
BUCKET_BYTES = 32 << 20


def _table(path: str, buckets: int) -> str:
    return "postings_" + hashlib.md5(f"{path}#{buckets}".encode()).hexdigest()


def write_postings(rows: DataFrame, path: str, buckets: int) -> None:
    """Overwrite ``path`` with postings hashed by document into ``buckets`` and sorted by term inside each file.

    ``rows`` are those of texts that ``by_document`` has hashed into as many partitions, so that a task has the rows of one bucket and
    postings, which are larger than their texts, are not shuffled. Others are stored as well, in more files.
    A search then reads only the row groups of its terms, adds up each document's score where the document lies, and
    keeps its best hits per bucket before anything is shuffled. A frequent term is spread evenly over the buckets.
    """
    (
        rows.write.mode("overwrite")
        .bucketBy(buckets, "doc_id")
        .sortBy("field", "term")
        .format("parquet")
        .option("path", path)
        .saveAsTable(_table(path, buckets))
    )


def read_postings(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The postings with their bucketing; a catalogue entry is made where this catalogue has none for the path."""
    name, location = _table(path, buckets), path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (doc_id BIGINT, field STRING, term STRING, tf BIGINT, dl INT, positions ARRAY<INT>) USING parquet "
        f"CLUSTERED BY (doc_id) SORTED BY (field, term) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)


def buckets_for(documents: DataFrame, fields: Sequence[str]) -> int:
    """Buckets by the size of the text: one per ``BUCKET_BYTES``, but enough to keep all cores busy."""
    size = documents.agg(F.sum(sum((F.octet_length(F.coalesce(f, F.lit(""))) for f in fields), F.lit(0)))).first()[0] or 0
    return max(documents.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))


def write_index(documents: DataFrame, fields: list[str], path: str, buckets: int | None = None) -> TextIndex:
    """Build the index of ``fields`` once and return it read back from ``path``."""
    spark = documents.sparkSession
    buckets = buckets or buckets_for(documents, fields)
    arrays = token_arrays(by_document(documents, fields, buckets), fields)
    write_postings(postings(arrays), f"{path}/postings", buckets)
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").json(f"{path}/layout")
    stored = read_postings(spark, f"{path}/postings", buckets)
    term_counts(stored).sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/term_stats")
    grams = term_grams(spark.read.parquet(f"{path}/term_stats"))
    grams.repartition("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
    field_stats(stored, documents.count()).write.mode("overwrite").parquet(f"{path}/field_stats")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> TextIndex:
    buckets = spark.read.schema("buckets int").json(f"{path}/layout").first()["buckets"]
    return TextIndex(
        postings=read_postings(spark, f"{path}/postings", buckets),
        term_stats=spark.read.parquet(f"{path}/term_stats"),
        field_stats=spark.read.parquet(f"{path}/field_stats"),
        grams=spark.read.parquet(f"{path}/grams"),
    )

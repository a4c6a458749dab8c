"""Topic models as partitioned tables: ``topics``, ``topic_doc`` and ``topic_word`` below one root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("topics", "topic_doc", "topic_word")


@dataclass(frozen=True)
class TopicModel:
    """topics(topic_id, words), topic_doc(topic_id, doc_id, weight), topic_word(topic_id, term, weight)."""

    topics: DataFrame
    topic_doc: DataFrame
    topic_word: DataFrame


def split_name(name: str) -> tuple[str, int]:
    """``LDA_50`` to ("LDA", 50)."""
    family, _, k = name.rpartition("_")
    return family, int(k)


def write_model(model: TopicModel, root: str, name: str) -> None:
    """Write one model below ``root``. Writing the same name again replaces it and leaves the others alone.

    Rows are sorted by topic inside each file, so that a condition on the topic skips row groups.
    """
    family, k = split_name(name)
    for table in TABLES:
        path = f"{root}/{table}/model={family}/k={k}"
        getattr(model, table).sortWithinPartitions("topic_id").write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, root: str, name: str) -> TopicModel:
    """Pick one model of the catalogue; the condition prunes to its folder."""
    family, k = split_name(name)

    def table(which: str) -> DataFrame:
        all_models = spark.read.parquet(f"{root}/{which}")
        return all_models.where((F.col("model") == family) & (F.col("k") == k)).drop("model", "k")

    return TopicModel(*(table(which) for which in TABLES))


def matrix_to_long(matrix: DataFrame, key: str, values: str, position: str, offset: str | None = None) -> DataFrame:
    """Dense rows to (key, position, weight).

    A row may hold a whole record (a document's topic weights) or one block of a long one (a slice of a topic's
    document weights); ``offset`` then names the column with the block's first position.
    """
    if offset is None:
        long = matrix.select(key, F.lit(0).alias("_first"), F.posexplode(values).alias("_at", "weight"))
    else:
        long = matrix.select(key, F.col(offset).alias("_first"), F.posexplode(values).alias("_at", "weight"))
    return long.select(key, (F.col("_first") + F.col("_at")).cast("bigint").alias(position), "weight")


def model_from_matrices(
    topics: DataFrame, topic_doc: DataFrame, topic_word: DataFrame, documents: DataFrame, vocabulary: DataFrame, offset: str | None = None
) -> TopicModel:
    """A finished model as other tools hand it over: word lists and two dense matrices that count positions.

    ``topics(topic_id, words)``; ``topic_doc`` and ``topic_word(topic_id, weights)``, one row per topic or, with ``offset``,
    per block of a topic; ``documents(position, doc_id)`` and ``vocabulary(position, term)`` say what a position means. A
    position without document or term is left out.
    """
    docs = matrix_to_long(topic_doc, "topic_id", "weights", "position", offset).join(documents.select("position", "doc_id"), "position")
    words = matrix_to_long(topic_word, "topic_id", "weights", "position", offset).join(vocabulary.select("position", "term"), "position")
    return TopicModel(topics.select("topic_id", "words"), docs.select("topic_id", "doc_id", "weight"), words.select("topic_id", "term", "weight"))

"""Topics of a model: sizes, ranking, heaviest documents, equal and similar topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeglass.functions import text as tx
from tomeglass.operators.ranking import best_per_group

# Fixed values.
THRESHOLD = 0.3
TOP_DOCUMENTS = 10
TOP_TOPICS = 3
SIMILAR_TOPICS = 3


def topic_sizes(topic_doc: DataFrame, threshold: float = THRESHOLD, topics: DataFrame | None = None) -> DataFrame:
    """(topic_id, n_docs): documents with more than ``threshold`` of the topic.

    A topic without any is kept with 0. With ``topics`` given the threshold reaches the scan, and topics without any
    row at all are kept too, as when no zero weights are stored.
    """
    heavy = F.col("weight") > threshold
    if topics is None:
        return topic_doc.groupBy("topic_id").agg(F.count_if(heavy).alias("n_docs"))
    sizes = topic_doc.where(heavy).groupBy("topic_id").agg(F.count("*").alias("n_docs"))
    return topics.select("topic_id").join(sizes, "topic_id", "left").fillna(0, ["n_docs"])


def topics_ranked(sizes: DataFrame, topics: DataFrame) -> DataFrame:
    """(rank, topic_id, n_docs, label), largest topic first. One row per topic is left to sort."""
    order = Window.orderBy(F.desc("n_docs"), "topic_id")
    return sizes.join(topics, "topic_id").select(
        F.row_number().over(order).alias("rank"), "topic_id", "n_docs", tx.topic_label(F.col("words")).alias("label")
    )


def topic_size_series(sizes: DataFrame) -> DataFrame:
    """Chart points (x, n_docs): sizes from the largest, x from 0."""
    order = Window.orderBy(F.desc("n_docs"), "topic_id")
    return sizes.select((F.row_number().over(order) - 1).alias("x"), "n_docs")


def topic_labels(topics: DataFrame) -> DataFrame:
    """The three ways a topic's words are written: as a list entry, as a link and as a heading."""
    words = F.col("words")
    return topics.select(
        "topic_id",
        tx.topic_label(words).alias("label"),
        tx.topic_label(words, ",").alias("link"),
        F.concat(F.lit("'"), tx.topic_label(words, "', '"), F.lit("'")).alias("heading"),
    )


def top_docs(topic_doc: DataFrame, k: int = TOP_DOCUMENTS) -> DataFrame:
    """(topic_id, rank, doc_id, weight): the heaviest documents of each topic, whatever their weight."""
    best = best_per_group(topic_doc, ["topic_id"], [F.desc("weight"), F.asc("doc_id")], k)
    return best.select("topic_id", "rank", "doc_id", "weight")


def top_topics(topic_doc: DataFrame, k: int = TOP_TOPICS) -> DataFrame:
    """(doc_id, rank, topic_id, weight): the heaviest topics of each document."""
    best = best_per_group(topic_doc, ["doc_id"], [F.desc("weight"), F.asc("topic_id")], k)
    return best.select("doc_id", "rank", "topic_id", "weight")


def first_duplicate(topics: DataFrame) -> DataFrame:
    """(topic_id, canonical_id): the first topic with the same word list."""
    first = topics.groupBy("words").agg(F.min("topic_id").alias("canonical_id"))
    return topics.join(first, "words").select("topic_id", "canonical_id")


def similar_topics(topic_word: DataFrame, k: int = SIMILAR_TOPICS, digits: int = 9) -> DataFrame:
    """(topic_id, rank, similar_id, d2): nearest topics by squared distance of their word weights, without itself.

    The squared distance is a sum over terms, so every partition adds up the share of its own terms and hands on one
    number per pair of topics. A model has some hundred topics at most; its vocabulary may be of any size, and no
    vector as wide as the vocabulary is ever built.
    """
    numbers = topic_word.select("topic_id").distinct().orderBy("topic_id").toArrow()["topic_id"].to_numpy()
    by_term = topic_word.groupBy("term").agg(
        F.collect_list("topic_id").alias("ids"), F.collect_list("weight").alias("weights")
    )

    def partial_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((len(numbers), len(numbers)))
        for batch in batches:
            ids, weights = batch.column("ids"), batch.column("weights")
            term = np.repeat(np.arange(batch.num_rows), ids.value_lengths().to_numpy(zero_copy_only=False))
            dense = np.zeros((batch.num_rows, len(numbers)))
            dense[term, np.searchsorted(numbers, ids.flatten().to_numpy())] = weights.flatten().to_numpy()
            products += dense.T @ dense
        squares = np.diag(products)
        d2 = squares[:, None] + squares[None, :] - 2 * products
        a, b = np.nonzero(~np.eye(len(numbers), dtype=bool))
        ids = numbers.astype(np.int64)
        yield pa.RecordBatch.from_pydict({"topic_id": ids[a], "similar_id": ids[b], "part": d2[a, b]})

    parts = by_term.select("ids", "weights").mapInArrow(partial_distances, "topic_id bigint, similar_id bigint, part double")
    d2 = F.greatest(F.round(F.sum("part"), digits), F.lit(0.0)).alias("d2")
    distances = parts.groupBy("topic_id", "similar_id").agg(d2)
    best = best_per_group(distances, ["topic_id"], [F.asc("d2"), F.asc("similar_id")], k)
    return best.select("topic_id", "rank", "similar_id", "d2")

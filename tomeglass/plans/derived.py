"""Corpus, topic model and queries derived from the given tables.

The given tables hold no topic model and no bibliographic data. These stand-ins are computed from whole tables and
serve to check arithmetic; they say nothing about the quality of topics or hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeglass.functions import text as tx
from tomeglass.functions.joins import broadcast_within
from tomeglass.operators import nearest as nn
from tomeglass.operators.graph import NeighbourGraph, build_graph
from tomeglass.operators.knn import train_cells
from tomeglass.operators.learning import embed_hashed, heaviest_words
from tomeglass.operators.lexical import TextIndex
from tomeglass.operators.quantised import VectorIndex, write_vector_index
from tomeglass.session import cut_lineage, fresh_path
from tomeglass.sources.index_store import write_index
from tomeglass.sources.models import TopicModel, matrix_to_long, read_model, write_model

FIELDS = ("title", "abstract")
DIM = 64

# Sharpness of the two stand-in models: how fast a topic's weight falls with the distance from its centre.
SHARPNESS = {"LDA_10": 32, "CTM_10": 16}


@dataclass(frozen=True)
class Corpus:
    """The derived tables of one data folder."""

    spark: SparkSession
    folder: str

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        """(doc_id, text, title, abstract, uri, year_raw, year, university)."""
        title = tx.first_line(F.col("text"))
        raw = F.when(F.col("doc_id") % 17 == 0, F.lit("None")).otherwise(
            F.concat((1995 + F.col("doc_id") % 23).cast("string"), F.lit(".0"))
        )
        return self.given("documents").select(
            "doc_id",
            "text",
            title.alias("title"),
            tx.abstract_after_title(F.col("text"), title).alias("abstract"),
            F.concat(F.lit("https://corpus.example.org/"), F.col("doc_id").cast("string")).alias("uri"),
            raw.alias("year_raw"),
            tx.parse_year(raw).alias("year"),
            F.col("source").alias("university"),
        )

    @property
    def vectors(self) -> DataFrame:
        return self.given("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")

    @property
    def centres(self) -> DataFrame:
        """(query_id, embedding): the mean vector of each label, which serves as a query vector."""
        as_vector = array_to_vector(F.col("embedding").cast("array<double>"))
        means = self.given("embeddings").groupBy("label").agg(Summarizer.mean(as_vector).alias("mean"))
        rounded = F.transform(vector_to_array("mean"), lambda x: F.round(x, 6))
        return means.select(F.col("label").cast("bigint").alias("query_id"), rounded.alias("embedding"))

    def weights(self, name: str = "LDA_10") -> DataFrame:
        """(doc_id, weights): dense topic weights from the distances to the centres; one topic per label."""
        rows = self.centres.orderBy("query_id").toArrow()
        middle = nn.as_matrix(rows["embedding"], DIM)
        sharpness = SHARPNESS[name]

        def soften(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d2 = nn.squared_distances(nn.as_matrix(batch.column("embedding"), DIM), middle)
                share = np.exp(-sharpness * d2)
                share = np.round(share / share.sum(axis=1, keepdims=True), 6)
                flat = pa.array(share.ravel())
                at = pa.array(np.arange(0, share.size + 1, share.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id"), "weights": pa.ListArray.from_arrays(at, flat)}
                )

        return self.vectors.mapInArrow(soften, "doc_id bigint, weights array<double>")

    def topic_doc(self, name: str = "LDA_10") -> DataFrame:
        """(topic_id, doc_id, weight), every pair."""
        long = matrix_to_long(self.weights(name), "doc_id", "weights", "topic_id")
        return long.select("topic_id", "doc_id", "weight")

    @cached_property
    def index(self) -> TextIndex:
        """The text index of titles and abstracts, written once per corpus."""
        return write_index(self.documents, list(FIELDS), fresh_path(self.spark, "index"))

    @cached_property
    def text_index(self) -> TextIndex:
        """The text index of whole texts as one field."""
        return write_index(self.documents, ["text"], fresh_path(self.spark, "text-index"))

    @cached_property
    def text_vectors(self) -> DataFrame:
        """(doc_id, embedding) of whole texts, written once like the index."""
        return cut_lineage(embed_hashed(self.documents))

    @cached_property
    def codes(self) -> VectorIndex:
        """Codes of all vectors around sixteen k-means cells, written once like the index."""
        return write_vector_index(self.vectors, fresh_path(self.spark, "codes"), DIM, train_cells(self.vectors, 16, DIM))

    @cached_property
    def codes_by_label(self) -> VectorIndex:
        """Codes of all vectors around the centres of their labels, written once."""
        centres = nn.as_matrix(self.centres.orderBy("query_id").toArrow()["embedding"], DIM)
        return write_vector_index(self.vectors, fresh_path(self.spark, "codes"), DIM, centres)

    @cached_property
    def graph(self) -> NeighbourGraph:
        """The neighbour graph of all vectors, written once."""
        return build_graph(self.vectors, DIM)

    @property
    def topic_word(self) -> DataFrame:
        """(topic_id, term, weight): share of a term among the words of a topic's documents.

        A document belongs to the topic of its vector's label, and without a vector to the last digit of its source.
        """
        labels = self.given("embeddings").select(F.col("vec_id").alias("doc_id"), "label")
        by_source = F.regexp_extract("university", r"(\d)$", 1).cast("int")
        topic = self.documents.join(labels, "doc_id", "left").select(
            "doc_id", F.coalesce("label", by_source).cast("bigint").alias("topic_id")
        )
        # Postings lie hashed by document, so only the narrow side moves and no side needs sorting.
        labelled = self.index.postings.join(topic.hint("shuffle_hash"), "doc_id")
        used = cut_lineage(labelled.groupBy("topic_id", "term").agg(F.sum("tf").alias("n")))
        totals = used.groupBy("topic_id").agg(F.sum("n").alias("total"))
        return used.join(broadcast_within(totals), "topic_id").select(
            "topic_id", "term", F.round(F.col("n") / F.col("total"), 9).alias("weight")
        )

    @cached_property
    def model_root(self) -> str:
        root = fresh_path(self.spark, "models")
        self.write_models(root)
        return root

    def write_models(self, root: str) -> None:
        """Both stand-in models, written as partitioned tables."""
        topic_word = self.topic_word
        for name in SHARPNESS:
            write_model(TopicModel(heaviest_words(topic_word), self.topic_doc(name), topic_word), root, name)

    def model(self, name: str = "LDA_10") -> TopicModel:
        return read_model(self.spark, self.model_root, name)

    @property
    def passages(self) -> DataFrame:
        """(query_id, text): every passage of the benchmark as a query."""
        return self.given("benchmark").select(F.col("item_id").alias("query_id"), "text")

    def one_query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "query_id bigint, text string")

    @property
    def facet_requests(self) -> DataFrame:
        """One request per topic and university that occur together."""
        pairs = self.model().topic_doc.join(self.documents, "doc_id").select("topic_id", "university").distinct()
        return pairs.select(
            F.concat_ws("/", F.col("topic_id").cast("string"), "university").alias("request_id"),
            "topic_id",
            F.lit(0.05).alias("threshold"),
            F.lit(1998).alias("year_from"),
            F.lit(2012).alias("year_to"),
            "university",
        )


_corpora: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, folder: str) -> Corpus:
    """One corpus per application and folder, so that its index and model tables are written once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _corpora:
        _corpora[key] = Corpus(spark, folder)
    return _corpora[key]

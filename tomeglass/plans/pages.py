"""What a corpus browser shows, page by page, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeglass.functions import text as tx
from tomeglass.operators import documents as docs
from tomeglass.operators import lexical as lex
from tomeglass.operators import topics as tp
from tomeglass.operators.knn import HITS, knn
from tomeglass.operators.learning import DIMENSION
from tomeglass.sources.models import TopicModel

# The search methods offered.
METHODS = ("BM25", "TF-IDF", "Vector Search")


@dataclass(frozen=True)
class ModelPage:
    topics: DataFrame
    chart: DataFrame


@dataclass(frozen=True)
class TopicPage:
    heading: DataFrame
    documents: DataFrame
    similar: DataFrame


@dataclass(frozen=True)
class FacetPage:
    documents: DataFrame
    counts: DataFrame
    chart: DataFrame


@dataclass(frozen=True)
class DocumentPage:
    detail: DataFrame
    topics: DataFrame
    similar: DataFrame


def model_page(model: TopicModel, threshold: float = tp.THRESHOLD) -> ModelPage:
    """All topics of a model, largest first, and the chart of their sizes."""
    sizes = tp.topic_sizes(model.topic_doc, threshold, model.topics)
    return ModelPage(tp.topics_ranked(sizes, model.topics), tp.topic_size_series(sizes))


def topic_page(model: TopicModel, documents: DataFrame, topic_id: int) -> TopicPage:
    """One topic: its words, heaviest documents and most similar topics."""
    heading = tp.topic_labels(model.topics.where(F.col("topic_id") == topic_id))
    heaviest = tp.top_docs(model.topic_doc.where(F.col("topic_id") == topic_id))
    similar = tp.similar_topics(model.topic_word).where(F.col("topic_id") == topic_id)
    links = tp.topic_labels(model.topics).select(F.col("topic_id").alias("similar_id"), "link")
    return TopicPage(heading, docs.with_documents(heaviest, documents), similar.join(links, "similar_id"))


def facet_page(model: TopicModel, documents: DataFrame, requests: DataFrame) -> FacetPage:
    """Documents of topics within facets, how many there are, and the chart by year, for a batch of requests."""
    found = docs.faceted_batch(model.topic_doc, documents, requests)
    return FacetPage(docs.with_documents(found, documents), docs.faceted_counts(found, requests), docs.year_histogram(found, requests))


def document_page(model: TopicModel, weights: DataFrame, documents: DataFrame, wanted: DataFrame) -> DocumentPage:
    """Documents in full, their heaviest topics and most similar documents, for those in ``wanted(doc_id)``."""
    detail = docs.doc_detail(documents, wanted)
    shares = model.topic_doc.join(wanted, "doc_id", "left_semi")
    first = tp.first_duplicate(model.topics)
    named = tp.top_topics(shares).join(first, "topic_id").join(tp.topic_labels(model.topics), "topic_id")
    titles = documents.select(
        F.col("doc_id").alias("similar_id"), tx.title_or_default(F.col("title")).alias("title")
    )
    near = docs.similar_documents(weights, wanted=wanted).join(titles, "similar_id", "left")
    return DocumentPage(detail, named.select("doc_id", "rank", "canonical_id", "link", "weight"), near)


def search_page(
    queries: DataFrame,
    documents: DataFrame,
    method: str,
    index: lex.TextIndex | None = None,
    vectors: DataFrame | None = None,
    encode=None,
    dim: int = DIMENSION,
    page: int = 1,
) -> DataFrame:
    """Hits with title and abstract for ``queries(query_id, text)`` by one of ``METHODS``.

    "TF-IDF" ranks by BM25 with the usual parameters; for real TF-IDF call ``search`` with ``tf_idf()``. A vector
    search needs ``encode``, which turns (doc_id, text) into (doc_id, embedding) of ``dim`` values. ``page`` counts from 1.
    """
    if method == "BM25":
        hits = lex.search(index, queries)
    elif method == "TF-IDF":
        hits = lex.search(index, queries, scoring=lex.bm25(lex.DEFAULT_K1, lex.DEFAULT_B))
    elif method == "Vector Search":
        texts = queries.select(F.col("query_id").alias("doc_id"), tx.query_or_default(F.col("text")).alias("text"))
        near = knn(vectors, encode(texts).withColumnRenamed("doc_id", "query_id"), dim, page * HITS)
        hits = near.where(F.col("rank") > (page - 1) * HITS)
    else:
        raise ValueError(f"method must be one of {METHODS}")
    return docs.with_documents(hits, documents)

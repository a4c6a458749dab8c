"""Documents: details, topic membership, facets, year histograms, similar documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeglass.functions import text as tx
from tomeglass.functions.joins import BROADCAST_ROWS, is_within, join_lookup, join_requests
from tomeglass.operators.knn import knn
from tomeglass.operators.ranking import best_per_group
from tomeglass.operators.topics import THRESHOLD
from tomeglass.session import cut_lineage

# Fixed value.
SIMILAR_DOCUMENTS = 5


def doc_detail(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Title, abstract, uri, year and university of the documents listed in ``wanted(doc_id)``."""
    ids = wanted.select("doc_id")
    ids = F.broadcast(ids) if is_within(ids, BROADCAST_ROWS) else ids
    return documents.join(ids, "doc_id", "left_semi").select(
        "doc_id", tx.title_or_default(F.col("title")).alias("title"), "abstract", "uri", "year", "university"
    )


def topic_members(topic_doc: DataFrame, threshold: float = THRESHOLD, topic_id: int | None = None) -> DataFrame:
    """Rows with more than ``threshold`` of their topic; both conditions reach the scan."""
    members = topic_doc.where(F.col("weight") > threshold)
    return members if topic_id is None else members.where(F.col("topic_id") == topic_id)


def with_documents(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Add title and abstract to hits, topic members or whatever else has a doc_id.

    The rows are settled first, so that no text moves for rows that drop out later. Few rows are broadcast to the
    documents. Of many, the most frequent documents are broadcast to the rows, and the others joined by shuffle.
    """
    rows = cut_lineage(rows)
    shown = documents.select("doc_id", tx.title_or_default(F.col("title")).alias("title"), "abstract")
    if is_within(rows, BROADCAST_ROWS):
        return shown.join(F.broadcast(rows), "doc_id")
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    return join_lookup(rows, shown, ["doc_id"], counts, hot_keys=100)


def _bound(limit: Column | int | str | None, test) -> Column:
    """``test`` where there is a limit; one that is None or NULL does not filter."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return limit.isNull() | F.coalesce(test(limit), F.lit(False))


def in_years(year_from: Column | int | None, year_to: Column | int | None) -> Column:
    """Year within the bounds. Documents without a readable year pass only where neither bound is given."""
    year = F.col("year")
    return _bound(year_from, lambda y: year >= y) & _bound(year_to, lambda y: year <= y)


def in_facets(
    year_from: Column | int | None, year_to: Column | int | None, university: Column | str | None
) -> Column:
    """Year within the bounds and university equal after trimming."""
    return in_years(year_from, year_to) & _bound(university, lambda name: F.trim("university") == F.trim(name))


def faceted(
    topic_doc: DataFrame,
    documents: DataFrame,
    topic_id: int,
    threshold: float = THRESHOLD,
    year_from: int | None = None,
    year_to: int | None = None,
    university: str | None = None,
) -> DataFrame:
    """(doc_id, year) of one topic's members within the facets. All conditions reach the scans, and no text moves;
    ``with_documents`` adds it to what is found."""
    members = topic_members(topic_doc, threshold, topic_id).select("doc_id")
    chosen = documents.where(in_facets(year_from, year_to, university)).select("doc_id", "year")
    return members.join(chosen, "doc_id")


def faceted_batch(topic_doc: DataFrame, documents: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, doc_id, year) for ``requests(request_id, topic_id, threshold, year_from, year_to, university)``.

    Members meet their document's year and university first. Requests that name a university are then joined on topic and
    university, the others on the topic alone, so that a row is not repeated for every request of its topic.
    """
    requests = cut_lineage(requests)
    lowest = requests.agg(F.min("threshold")).first()[0]
    heavy = topic_doc.where(F.col("weight") > F.lit(lowest))
    facts = documents.select("doc_id", "year", F.trim("university").alias("name"))
    members = heavy.join(facts, "doc_id").select("topic_id", "doc_id", "weight", "year", "name")
    asked = requests.withColumn("name", F.trim("university")).select("request_id", "topic_id", "threshold", "year_from", "year_to", "name")
    named = join_requests(members, asked.where("name is not null"), ["topic_id", "name"], spread_by="doc_id")
    unnamed = join_requests(members.drop("name"), asked.where("name is null").drop("name"), ["topic_id"], spread_by="doc_id")
    found = named.drop("name").unionByName(unnamed).where(F.col("weight") > F.col("threshold"))
    return found.where(in_years(F.col("year_from"), F.col("year_to"))).select("request_id", "doc_id", "year")


def faceted_counts(found: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, n_docs); a request without documents counts 0."""
    counts = found.groupBy("request_id").agg(F.count("*").alias("n_docs"))
    return requests.select("request_id").join(counts, "request_id", "left").fillna(0, ["n_docs"])


def year_histogram(found: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, year, n_docs) for every year within a request's bounds; years without documents count 0.

    Bounds the wrong way round span no year.
    """
    counts = found.groupBy("request_id", "year").agg(F.count("*").alias("n_docs"))
    spans = requests.where(F.col("year_from") <= F.col("year_to"))
    spine = spans.select("request_id", F.explode(F.sequence("year_from", "year_to")).alias("year"))
    return spine.join(counts, ["request_id", "year"], "left").fillna(0, ["n_docs"])


def facet_values(documents: DataFrame, column: str = "university") -> DataFrame:
    """The values a facet offers, trimmed, with their number of documents."""
    return (
        documents.select(F.trim(column).alias(column))
        .where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n_docs"))
    )


def similar_documents(
    weights: DataFrame, k: int = SIMILAR_DOCUMENTS, wanted: DataFrame | None = None, **search
) -> DataFrame:
    """(doc_id, rank, similar_id, d2): nearest documents by squared distance of ``weights(doc_id, weights)``,
    the document itself left out by id.

    For all documents, or for those in ``wanted(doc_id)``. Of all documents, those with equal weights are searched
    for once, so a large group of copies costs no more than one document; of such a group only the k + 1 lowest ids
    can be anybody's neighbour.
    """
    if wanted is not None:
        return _similar_to(weights, wanted, k, **search)
    reach = k + 1
    keyed = weights.select("doc_id", "weights", F.xxhash64("weights").alias("hash"))
    on = ["hash", "weights"]
    lowest = best_per_group(keyed, on, [F.asc("doc_id")], reach)
    ids = lowest.groupBy(*on).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    sizes = keyed.groupBy(*on).agg(F.count("*").alias("n"))
    groups = cut_lineage(ids.join(sizes, on).withColumn("group_id", F.col("ids")[0]))

    points = groups.select(F.col("group_id").alias("doc_id"), F.col("weights").alias("embedding"))
    topics = _topics(groups)
    near = cut_lineage(knn(points, points.withColumnRenamed("doc_id", "query_id"), topics, reach, **search))
    members = groups.select(F.col("group_id").alias("doc_id"), "ids")
    # One group may be near to very many.
    hubs = near.groupBy("doc_id").agg(F.count("*").alias("n"))
    candidates = join_lookup(near, members, ["doc_id"], hubs).select("query_id", "d2", F.explode("ids").alias("similar_id"))
    best = best_per_group(candidates, ["query_id"], [F.asc("d2"), F.asc("similar_id")], reach)
    lists = best.groupBy(F.col("query_id").alias("group_id")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "similar_id", "d2"))).alias("near")
    )
    lookup = groups.join(lists, "group_id").select(*on, "near")

    others = F.filter("near", lambda n: n["similar_id"] != F.col("doc_id"))
    found = join_lookup(keyed, lookup, on, groups).select("doc_id", F.slice(others, 1, k).alias("near"))
    return found.select("doc_id", F.posexplode("near").alias("at", "n")).select(
        "doc_id", (F.col("at") + 1).alias("rank"), "n.similar_id", "n.d2"
    )


def _topics(weights: DataFrame) -> int:
    """All weights have as many values as the model has topics; ``knn`` checks that."""
    row = weights.where(F.col("weights").isNotNull()).select(F.size("weights").alias("n")).first()
    return 0 if row is None else row["n"]


def _similar_to(weights: DataFrame, wanted: DataFrame, k: int, **search) -> DataFrame:
    points = weights.select("doc_id", F.col("weights").alias("embedding"))
    asked = points.join(wanted.select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    near = knn(points, asked, _topics(weights), k, exclude_self=True, **search)
    return near.select(F.col("query_id").alias("doc_id"), "rank", F.col("doc_id").alias("similar_id"), "d2")

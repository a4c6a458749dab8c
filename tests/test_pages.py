import pytest
from pyspark.sql import functions as F

from tomeglass.plans import pages

from tests.conftest import rows


def test_model_page(tiny):
    page = pages.model_page(tiny.model())
    sizes = [r["n_docs"] for r in page.topics.orderBy("rank").collect()]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == 10
    assert [r["n_docs"] for r in page.chart.orderBy("x").collect()] == sizes
    strict = pages.model_page(tiny.model(), 0.9).topics.agg(F.sum("n_docs")).first()[0]
    assert strict < sum(sizes)


def test_topic_page(tiny):
    page = pages.topic_page(tiny.model(), tiny.documents, 3)
    assert page.heading.count() == 1
    assert page.similar.count() == 3 and page.similar.where("similar_id = 3").count() == 0
    heaviest = tiny.model().topic_doc.where("topic_id = 3").orderBy(F.desc("weight"), "doc_id").limit(10)
    known = heaviest.join(tiny.documents, "doc_id", "left_semi").select("doc_id")
    assert rows(page.documents.select("doc_id")) == rows(known)


def test_facet_page(spark, tiny):
    requests = spark.createDataFrame(
        [(1, 3, 0.05, 1995, 2017, None), (2, 3, 0.05, 1995, 2017, "src7")],
        "request_id int, topic_id long, threshold double, year_from int, year_to int, university string",
    )
    page = pages.facet_page(tiny.model(), tiny.documents, requests)
    counts = dict(rows(page.counts))
    assert counts[1] == page.documents.where("request_id = 1").count() > counts[2]
    assert dict(rows(page.chart.groupBy("request_id").agg(F.sum("n_docs")))) == counts


def test_document_page(spark, tiny):
    wanted = spark.createDataFrame([(4,), (17,)], "doc_id long")
    page = pages.document_page(tiny.model(), tiny.weights(), tiny.documents, wanted)
    assert page.detail.count() == 2
    assert rows(page.topics.groupBy("doc_id").count()) == [(17, 3), (4, 3)]
    assert rows(page.similar.groupBy("doc_id").count()) == [(17, 5), (4, 5)]
    assert page.similar.where("doc_id = similar_id").count() == 0


@pytest.mark.parametrize("method", ["BM25", "TF-IDF"])
def test_search_page(tiny, method):
    hits = pages.search_page(tiny.passages, tiny.documents, method, index=tiny.index)
    assert hits.columns == ["doc_id", "title", "abstract", "query_id", "rank", "score"]
    assert hits.groupBy("query_id").count().where("count > 10").count() == 0


def test_unknown_method(tiny):
    with pytest.raises(ValueError, match="Vector Search"):
        pages.search_page(tiny.passages, tiny.documents, "Boolean")

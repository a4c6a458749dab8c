import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeglass.functions import joins
from tomeglass.operators import documents as docs

from tests.conftest import rows

REQUEST = "request_id int, topic_id long, threshold double, year_from int, year_to int, university string"


@pytest.fixture(scope="module")
def documents(spark):
    data = [
        (0, "T0", "a0", "u", 2000, "MIT"),
        (1, "", "a1", "u", 2001, " MIT "),
        (2, "T2", "a2", "u", None, "MIT"),
        (3, "T3", "a3", "u", 2002, "VT"),
        (4, None, "a4", "u", 2002, None),
        (5, "T5", "a5", "u", 2002, "None"),
    ]
    return spark.createDataFrame(data, "doc_id long, title string, abstract string, uri string, year int, university string")


@pytest.fixture(scope="module")
def topic_doc(spark):
    data = [(0, d, 0.5) for d in range(6)] + [(1, d, 0.1 * d) for d in range(6)]
    return spark.createDataFrame(data, "topic_id long, doc_id long, weight double")


CASES = [
    ((0, 0.3, 2000, 2002, "MIT"), [0, 1]),
    ((0, 0.3, 2000, 2002, " MIT"), [0, 1]),
    ((0, 0.5, 2000, 2002, "MIT"), []),
    ((0, 0.3, 2000, 2002, None), [0, 1, 3, 4, 5]),
    ((0, 0.3, None, None, "MIT"), [0, 1, 2]),
    ((0, 0.3, None, None, None), [0, 1, 2, 3, 4, 5]),
    ((0, 0.3, 2001, None, None), [1, 3, 4, 5]),
    ((0, 0.3, 2002, 2000, None), []),
    ((0, 0.3, 2000, 2002, "None"), [5]),
    ((1, 0.25, 2000, 2002, None), [3, 4, 5]),
    ((7, 0.3, 2000, 2002, None), []),
]


@pytest.mark.parametrize("request_,want", CASES)
def test_facets(topic_doc, documents, request_, want):
    found = docs.faceted(topic_doc, documents, *request_)
    assert [r[0] for r in rows(found.select("doc_id"))] == want


@pytest.mark.parametrize("large", [False, True])
def test_a_batch_of_requests_gives_the_same(spark, topic_doc, documents, large, request):
    if large:
        request.getfixturevalue("no_broadcast")
    requests = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], REQUEST)
    found = docs.faceted_batch(topic_doc, documents, requests)
    by_request = {i: sorted(r["doc_id"] for r in found.collect() if r["request_id"] == i) for i in range(len(CASES))}
    assert by_request == {i: want for i, (_, want) in enumerate(CASES)}

    counts = dict(rows(docs.faceted_counts(found, requests)))
    assert counts == {i: len(want) for i, (_, want) in enumerate(CASES)}

    histogram = docs.year_histogram(found, requests).collect()
    spans = {i: c[0][2:4] for i, c in enumerate(CASES) if None not in c[0][2:4]}
    for i, (first, last) in spans.items():
        mine = sorted((r["year"], r["n_docs"]) for r in histogram if r["request_id"] == i)
        assert [y for y, _ in mine] == list(range(first, last + 1))
        assert sum(n for _, n in mine) == counts[i]
    assert {r["request_id"] for r in histogram} == {i for i, (first, last) in spans.items() if first <= last}


@pytest.mark.parametrize("large", [False, True])
def test_details_and_texts(documents, topic_doc, large, request):
    if large:
        request.getfixturevalue("no_broadcast")
    wanted = topic_doc.where("weight > 0.35 AND topic_id = 1").select("doc_id")
    assert rows(docs.doc_detail(documents, wanted)) == [
        (4, "No Title", "a4", "u", 2002, None), (5, "T5", "a5", "u", 2002, "None")
    ]
    shown = docs.with_documents(docs.topic_members(topic_doc), documents).select("topic_id", "doc_id", "title", "abstract")
    assert rows(shown)[:3] == [(0, 0, "T0", "a0"), (0, 1, "No Title", "a1"), (0, 2, "T2", "a2")]
    assert shown.count() == topic_doc.where("weight > 0.3").count()


def test_facet_values(documents):
    assert rows(docs.facet_values(documents)) == [("MIT", 3), ("None", 1), ("VT", 1)]


def brute_force(ids, weights, k):
    out = []
    for i, w in sorted(zip(ids, weights), key=lambda p: p[0]):
        d2 = np.round(((weights - w) ** 2).sum(axis=1), 6)
        near = sorted((float(d), int(j)) for d, j in zip(d2, ids) if j != i)[:k]
        out += [(int(i), r + 1, j, pytest.approx(d, abs=2e-6)) for r, (d, j) in enumerate(near)]
    return out


@pytest.mark.parametrize("search", [{}, {"broadcast_bytes": 0, "block_rows": 16, "pivots": 5}])
def test_similar_documents_with_many_copies(spark, search):
    rng = np.random.default_rng(11)
    weights = np.round(rng.dirichlet(np.ones(4) * 0.3, 240), 2)
    weights[:80] = [1, 0, 0, 0]
    weights[80:83] = [0, 1, 0, 0]
    ids = rng.permutation(1000)[:240]
    frame = spark.createDataFrame([(int(i), w.tolist()) for i, w in zip(ids, weights)], "doc_id long, weights array<double>")
    want = brute_force(ids, weights, 5)
    assert rows(docs.similar_documents(frame, **search), "doc_id", "rank") == want
    some = frame.where("doc_id < 300").select("doc_id")
    got = rows(docs.similar_documents(frame, wanted=some, **search), "doc_id", "rank")
    assert got == [w for w in want if w[0] < 300]


def test_hot_key_of_a_lookup_is_joined_without_a_shuffle(spark):
    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("v"))
    lookup = spark.range(9000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x"))
    counts = big.groupBy("key").agg(F.count("*").alias("n"))
    got = joins.join_lookup(big, lookup, ["key"], counts, hot_keys=5)
    assert got.count() == 9000
    assert got.where("x <> 2 * key").count() == 0


def test_salted_join_is_the_plain_join(spark, no_broadcast):
    big = spark.range(3000).select((F.col("id") % 2).alias("key"), F.col("id").alias("v"))
    asked = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2, "d")], "key long, r string")
    salted = joins.join_requests(big, asked, ["key"], spread_by="v", salts=7)
    assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()
    assert rows(salted) == rows(big.join(asked, "key"))


def test_requests_do_not_multiply_the_members(spark):
    """One request per topic and university: after the join there are no more rows than are kept."""
    topic_doc = spark.range(400).select((F.col("id") % 2).alias("topic_id"), F.col("id").alias("doc_id"), F.lit(0.5).alias("weight"))
    documents = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(2000).alias("year"), F.concat(F.lit(" u"), F.col("id") % 20).alias("university"))
    pairs = [(f"{t}/{u}", t, 0.1, 1990, 2010, f"u{u} ") for t in range(2) for u in range(20)] + [("all", 0, 0.1, None, None, None)]
    requests = spark.createDataFrame(pairs, "request_id string, topic_id long, threshold double, year_from int, year_to int, university string")
    found = docs.faceted_batch(topic_doc, documents, requests)
    assert found.count() == 400 + 200
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, ((topic_id") == 1 and "Cartesian" not in plan

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeglass.operators import documents as docs
from tomeglass.operators import topics as tp
from tomeglass.operators.ranking import best_overall, best_per_group

from tests.conftest import rows


@pytest.fixture(scope="module")
def topic_doc(spark):
    weights = {0: [0.5, 0.3, 0.3000001, 0.9], 1: [0.5, 0.7, 0.6, 0.1], 2: [0.0, 0.0, 0.1, 0.0]}
    data = [(t, d, w) for t, ws in weights.items() for d, w in enumerate(ws)]
    return spark.createDataFrame(data, "topic_id long, doc_id long, weight double")


@pytest.fixture(scope="module")
def topics(spark):
    data = [(0, ["a", "b"]), (1, ["c"]), (2, ["a", "b"]), (3, ["d"])]
    return spark.createDataFrame(data, "topic_id long, words array<string>")


def test_threshold_is_strict_and_empty_topics_stay(topic_doc, topics):
    assert rows(tp.topic_sizes(topic_doc)) == [(0, 3), (1, 3), (2, 0)]
    assert rows(tp.topic_sizes(topic_doc, 0.5, topics)) == [(0, 1), (1, 2), (2, 0), (3, 0)]
    assert rows(docs.topic_members(topic_doc, 0.3, topic_id=0).select("doc_id")) == [(0,), (2,), (3,)]


def test_ranking_and_chart(topic_doc, topics):
    sizes = tp.topic_sizes(topic_doc, 0.3, topics)
    assert rows(tp.topics_ranked(sizes, topics), "rank") == [
        (1, 0, 3, "a b"), (2, 1, 3, "c"), (3, 2, 0, "a b"), (4, 3, 0, "d")
    ]
    assert rows(tp.topic_size_series(sizes), "x") == [(0, 3), (1, 3), (2, 0), (3, 0)]


def test_labels(topics):
    assert rows(tp.topic_labels(topics).where("topic_id = 0")) == [(0, "a b", "a,b", "'a', 'b'")]


def test_top_documents_and_topics(topic_doc):
    assert rows(tp.top_docs(topic_doc, 2), "topic_id", "rank") == [
        (0, 1, 3, 0.9), (0, 2, 0, 0.5), (1, 1, 1, 0.7), (1, 2, 2, 0.6), (2, 1, 2, 0.1), (2, 2, 0, 0.0)
    ]
    assert rows(tp.top_topics(topic_doc, 1), "doc_id") == [(0, 1, 0, 0.5), (1, 1, 1, 0.7), (2, 1, 1, 0.6), (3, 1, 0, 0.9)]


def test_equal_word_lists_lead_to_the_first_topic(topics):
    assert rows(tp.first_duplicate(topics)) == [(0, 0), (1, 1), (2, 0), (3, 3)]


def test_similar_topics_are_brute_force(spark):
    rng = np.random.default_rng(4)
    dense = rng.random((6, 50)) * (rng.random((6, 50)) < 0.3)
    dense[4] = dense[1]
    # Topic numbers need not be contiguous, and topic 9 shares no word with any other.
    numbers = [0, 2, 3, 5, 7, 9]
    dense[5] = 0
    data = [(numbers[t], f"w{w}", float(dense[t, w])) for t in range(6) for w in range(50) if dense[t, w]]
    data.append((9, "alone", 0.25))
    full = np.hstack([dense, np.zeros((6, 1))])
    full[5, 50] = 0.25
    got = rows(tp.similar_topics(spark.createDataFrame(data, "topic_id long, term string, weight double")), "topic_id", "rank")
    want = []
    for a in range(6):
        near = sorted((round(float(((full[a] - full[b]) ** 2).sum()), 9), numbers[b]) for b in range(6) if b != a)
        want += [(numbers[a], i + 1, b, pytest.approx(d, abs=2e-9)) for i, (d, b) in enumerate(near[:3])]
    assert got == want


def test_best_of_a_hot_group_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id").alias("v"))
    best = best_per_group(df, ["g"], [F.desc("v")], 2)
    assert rows(best, "g", "rank") == [(0, 998, 1), (0, 997, 2), (1, 999, 1), (1, 996, 2)]
    assert "WindowGroupLimit [g#" in best._jdf.queryExecution().executedPlan().toString()


def test_best_overall(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 5).alias("v"))
    best = best_overall(df, [F.desc("v"), F.asc("id")], 3)
    assert [tuple(r) for r in best.orderBy("rank").collect()] == [(4, 4, 1), (9, 4, 2), (14, 4, 3)]
    assert "TakeOrderedAndProject" in best._jdf.queryExecution().executedPlan().toString()

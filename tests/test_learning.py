import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tomeglass.operators import learning as ml
from tomeglass.operators import topics as tp
from tomeglass.operators.knn import knn
from tomeglass.plans import pages

from tests.conftest import rows


@pytest.fixture(scope="module")
def texts(spark):
    fruit, metal = "apple pear plum grape", "iron copper zinc tin"
    data = [(i, " ".join([fruit if i % 2 else metal] * 5)) for i in range(40)] + [(40, ""), (41, None)]
    return spark.createDataFrame(data, "doc_id long, text string")


def test_topic_model_separates_two_vocabularies(spark, texts):
    model = ml.fit_topic_model(texts, k=2, iterations=20)
    assert model.topic_doc.count() == 42 * 2
    totals = model.topic_doc.where("doc_id < 40").groupBy("doc_id").agg(F.sum("weight").alias("w"))
    assert totals.where(F.abs(F.col("w") - 1) > 1e-6).count() == 0
    assert model.topic_word.count() == 2 * 8
    sizes = dict(rows(tp.topic_sizes(model.topic_doc.where("doc_id < 40"), 0.6)))
    assert sorted(sizes.values()) == [20, 20]
    heaviest = {r["topic_id"]: set(r["words"][:4]) for r in model.topics.collect()}
    assert {frozenset(w) for w in heaviest.values()} == {
        frozenset(["apple", "pear", "plum", "grape"]), frozenset(["iron", "copper", "zinc", "tin"])
    }


def test_no_word_is_lost(spark):
    """More words than any usual limit, most of them in one document only, and every document counts."""
    data = [(i, " ".join(f"w{i}x{j}" for j in range(700)) + " shared") for i in range(100)]
    model = ml.fit_topic_model(spark.createDataFrame(data, "doc_id long, text string"), k=2, iterations=1)
    assert model.topic_word.count() == 2 * 70_001
    assert model.topic_doc.count() == 200
    limited = ml.fit_topic_model(spark.createDataFrame(data, "doc_id long, text string"), k=2, iterations=1, vocabulary=3)
    assert {r.term for r in limited.topic_word.collect()} == {"shared", "w0x0", "w0x1"}
    frequent = ml.fit_topic_model(spark.createDataFrame(data, "doc_id long, text string"), k=2, iterations=1, min_docs=2)
    assert frequent.topic_word.count() == 2 and frequent.topic_doc.count() == 200


def likelihood(topic_doc, topic_word, counts):
    """Logarithm of the likelihood of all words under the shares of a model."""
    theta, beta = {}, {}
    for r in topic_doc.collect():
        theta.setdefault(r.doc_id, {})[r.topic_id] = r.weight
    for r in topic_word.collect():
        beta.setdefault(r.term, {})[r.topic_id] = r.weight
    return sum(n * np.log(sum(theta[d][t] * w for t, w in beta[word].items())) for (d, word), n in counts.items())


def test_the_fit_is_as_likely_as_that_of_the_library(spark):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(1)
    topics = rng.dirichlet(np.full(120, 0.05), 4)
    data = []
    for i in range(150):
        share = rng.dirichlet(np.full(4, 0.3))
        data.append((i, " ".join(f"w{rng.choice(120, p=topics[rng.choice(4, p=share)])}" for _ in range(60))))
    documents = spark.createDataFrame(data, "doc_id long, text string")
    counts = {}
    for i, text in data:
        for word in text.split():
            counts[i, word] = counts.get((i, word), 0) + 1
    own = ml.fit_topic_model(documents, k=4, iterations=12, block_entries=1000)

    words = documents.select("doc_id", F.split("text", " ").alias("words"))
    vectors = CountVectorizer(inputCol="words", outputCol="features").fit(words)
    lda = LDA(k=4, seed=3, maxIter=25, optimizer="online", subsamplingRate=1.0, learningOffset=1.0).fit(vectors.transform(words))
    matrix = lda.topicsMatrix().toArray()
    matrix = matrix / matrix.sum(axis=0)
    topic_word = spark.createDataFrame([(w, t, float(matrix[j, t])) for j, w in enumerate(vectors.vocabulary) for t in range(4)], "term string, topic_id int, weight double")
    shares = lda.transform(vectors.transform(words)).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic_id", "weight"))
    theirs = likelihood(shares, topic_word, counts)
    assert likelihood(own.topic_doc, own.topic_word, counts) > 1.01 * theirs  # both are negative


def test_blocks_do_not_change_the_model(spark, texts):
    few, many = (ml.fit_topic_model(texts, k=2, iterations=3, block_entries=n) for n in (3, 500_000))
    assert [(t, d, round(w, 6)) for t, d, w in rows(few.topic_doc)] == [(t, d, round(w, 6)) for t, d, w in rows(many.topic_doc)]
    assert [(t, w, round(x, 6)) for t, w, x in rows(few.topic_word)] == [(t, w, round(x, 6)) for t, w, x in rows(many.topic_word)]


def test_nothing_to_fit(spark):
    for data in ([], [(1, ""), (2, None)]):
        model = ml.fit_topic_model(spark.createDataFrame(data, "doc_id long, text string"), k=3, iterations=2)
        assert model.topic_word.count() == 0 and {r.weight for r in model.topic_doc.collect()} <= {0.0} and model.topic_doc.count() == 3 * len(data)


def test_digamma():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.0, 10.0, 1e6])
    known = [-1000.5755719318, -10.4237549404, -1.9635100260, -0.5772156649, 0.4227843351, 2.2517525891, 13.8155100580]
    assert np.allclose(ml.digamma(x), known, atol=1e-8)


def test_inference_reaches_its_fixed_point():
    """At the end a document's weights are the prior and its words, dealt to topics by both sides."""
    rng = np.random.default_rng(2)
    beta = rng.random((30, 3))
    doc, term, n = np.repeat(np.arange(5), 12), np.concatenate([rng.choice(30, 12, replace=False) for _ in range(5)]), rng.integers(1, 5, 60).astype(float)
    gamma, added = ml.infer_topics(doc, term, n, beta, 5, 0.2, steps=2000, close=1e-12)
    theta = np.exp(ml.digamma(gamma) - ml.digamma(gamma.sum(axis=1, keepdims=True)))
    dealt = theta[doc] * beta[term]
    dealt *= (n / dealt.sum(axis=1))[:, None]
    assert np.allclose(gamma, 0.2 + np.stack([np.bincount(doc, dealt[:, t]) for t in range(3)], axis=1))
    assert np.allclose(added, np.stack([np.bincount(term, dealt[:, t], 30) for t in range(3)], axis=1))


def test_two_fits_agree(spark, texts):
    first, second = (ml.fit_topic_model(texts, k=2, iterations=5).topics for _ in range(2))
    assert rows(first) == rows(second)


def test_hashed_vectors(spark, texts):
    got = {r["doc_id"]: np.array(r["embedding"]) for r in ml.embed_hashed(texts).collect()}
    assert len(got) == 42 and all(len(v) == 768 for v in got.values())
    assert np.linalg.norm(got[0]) == pytest.approx(1) and np.linalg.norm(got[40]) == 0
    assert np.allclose(got[0], got[2]) and not np.allclose(got[0], got[1])


def load_lengths():
    """A stand-in for a sentence encoder."""

    def encode(texts: pd.Series) -> np.ndarray:
        return np.stack([texts.str.len(), texts.str.count("a")], axis=1)

    return encode


def test_caller_encoder_is_fed_whole_batches(spark, texts):
    got = ml.embed(texts.repartition(3), load_lengths)
    assert got.count() == 42
    assert rows(got.where("doc_id >= 40")) == [(40, [0.0, 0.0]), (41, [0.0, 0.0])]


def test_vector_search_by_text(spark, texts):
    documents = texts.select("doc_id", F.lit("t").alias("title"), F.col("text").alias("abstract"))
    queries = spark.createDataFrame([(0, "zinc iron"), (1, "plum")], "query_id long, text string")
    hits = pages.search_page(queries, documents, "Vector Search", vectors=ml.embed_hashed(texts), encode=ml.embed_hashed)
    assert hits.count() == 20
    more = pages.search_page(queries, documents, "Vector Search", vectors=ml.embed_hashed(texts), encode=ml.embed_hashed, page=2)
    assert {r["rank"] for r in more.collect()} == set(range(11, 21))
    assert {r["doc_id"] % 2 for r in hits.where("query_id = 0").collect()} == {0}
    assert {r["doc_id"] % 2 for r in hits.where("query_id = 1").collect()} == {1}


def test_documents_are_inferred_some_at_a_time(monkeypatch):
    """All entries of a block were gathered anew in every step. However many are taken together, the numbers are the same."""
    rng = np.random.default_rng(5)
    lengths = np.array([3, 0, 40, 1, 0, 200, 7, 0])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    term, n, beta = rng.integers(0, 30, len(doc)), rng.integers(1, 4, len(doc)).astype(float), rng.random((30, 3))
    found = []
    for entries in (1, 45, 10_000):
        monkeypatch.setattr(ml, "CACHED_ENTRIES", entries)
        found.append(ml.infer_topics(doc, term, n, beta, len(lengths), 0.2))
    for gamma, added in found[1:]:
        assert np.array_equal(gamma, found[0][0]) and np.array_equal(added, found[0][1])


def test_words_go_to_a_block_as_texts_once(spark):
    """Every pass sent all words of all documents as texts; documents hold numbers of the words of their block now."""
    data = [(1, "b a b"), (2, "a c"), (2, "c"), (None, "a"), (5, ""), (6, None)]
    blocks = ml.word_blocks(spark.createDataFrame(data, "doc_id long, text string"), block_entries=2)
    words = {(r.block, r.place): r for r in blocks.words.collect()}
    found = []
    for r in blocks.documents.collect():
        places, counts = (np.frombuffer(x, np.int32) for x in (r.places, r.counts))
        found.append((r.doc_id, sorted((words[r.block, p].term, n) for p, n in zip(places, counts))))
    assert sorted(found, key=str) == sorted([(1, [("a", 1), ("b", 2)]), (2, [("a", 1), ("c", 1)]), (2, [("c", 1)]), (None, [("a", 1)])], key=str)
    assert dict(rows(blocks.per_term())) == {"a": 3, "b": 1, "c": 2}

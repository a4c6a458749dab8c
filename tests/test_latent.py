import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeglass.operators import latent as lt
from tomeglass.session import cut_lineage

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    topics = rng.dirichlet(np.full(60, 0.1), 6)
    data = [(i, " ".join(rng.choice(WORDS, rng.integers(3, 40), p=topics[i % 6]))) for i in range(120)]
    return data + [(200, ""), (201, None)]


def dense(texts, idf=None):
    """The matrix of documents and words that the operator never builds."""
    counts = np.array([[text.split().count(w) for w in WORDS] for _, text in texts if text], float)
    if idf is None:
        idf = np.log(1 + len(counts) / np.maximum((counts > 0).sum(axis=0), 1))
    weight = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return weight / np.linalg.norm(weight, axis=1, keepdims=True), idf


@pytest.mark.parametrize("block_entries", [200, 500_000])
def test_singular_vectors_of_a_dense_decomposition(spark, texts, block_entries):
    documents = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    model = lt.fit_latent(documents, k=6, passes=8, block_entries=block_entries)
    matrix, idf = dense(texts)
    u, values, v = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(model.values, values[:6], rtol=1e-4)
    rows = {r.term: r for r in model.words.collect()}
    used = [i for i, w in enumerate(WORDS) if w in rows]
    ours = np.zeros((60, 6))
    ours[used] = [rows[WORDS[i]]["row"] for i in used]
    assert np.allclose([rows[WORDS[i]].idf for i in used], idf[used])
    # The sine of the greatest angle between both spaces.
    cosines = np.linalg.svd(v[:6] @ ours)[1]
    assert np.sqrt(max(0, 1 - cosines.min() ** 2)) < 1e-3
    found = {r.doc_id: r.embedding for r in lt.embed_latent(documents, model, block_entries=block_entries).collect()}
    assert len(found) == 122 and found[200] == found[201] == [0.0] * 6
    assert np.allclose([found[i] for i, t in texts if t], matrix @ ours)


def test_queries_in_the_space_of_the_documents(spark, texts):
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    model = lt.fit_latent(documents, k=4, passes=2)
    queries = [(0, texts[3][1]), (1, "unknown words only"), (2, f"w1 unknown {texts[0][1]}")]
    found = {r.doc_id: r.embedding for r in lt.embed_latent(spark.createDataFrame(queries, "doc_id long, text string"), model).collect()}
    same = {r.doc_id: r.embedding for r in lt.embed_latent(documents.where("doc_id = 3"), model).collect()}
    assert np.allclose(found[0], same[3]) and found[1] == [0.0] * 4 and any(found[2])


def test_fits_agree_and_words_may_be_limited(spark, texts):
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    a, b = (lt.fit_latent(documents, k=3, passes=2, min_docs=40) for _ in range(2))
    assert np.allclose(a.values, b.values) and 0 < a.words.count() < 60
    assert documents.select(F.explode(F.array_distinct(F.split("text", " "))).alias("w")).where("w <> ''").groupBy("w").count().where("count >= 40").count() == a.words.count()
    none = lt.fit_latent(documents.limit(0), k=3, passes=1)
    assert none.words.count() == 0 and not none.values.any() and lt.embed_latent(documents.limit(0), none).count() == 0


def test_a_pass_writes_the_rows_of_words_once(spark, texts, monkeypatch):
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    written = []
    monkeypatch.setattr(lt, "cut_lineage", lambda df: written.append(df.columns) or cut_lineage(df))
    fits = [lt.fit_latent(documents, k=3, passes=passes) for passes in (1, 3)]
    assert written.count(["term", "row"]) == 1 + 1 + 1 + 3 and sum("row" in c for c in written) == 1 + 1 + 1 + 3 + len(fits)


def test_rows_of_passes_that_are_over_are_deleted(spark, texts, monkeypatch):
    """The rows of all passes stayed on the disk until the end of the application."""
    written = []
    monkeypatch.setattr(lt, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    model = lt.fit_latent(spark.createDataFrame(texts, "doc_id long, text string"), k=3, passes=3)
    passes = [df.inputFiles() for df in written if df.columns == ["term", "row"]]
    kept = [all(os.path.exists(f.removeprefix("file:")) or os.path.exists(f.removeprefix("file://")) for f in files) for files in passes]
    assert kept == [False, False, False, True] and model.words.count() > 0

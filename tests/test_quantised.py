import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_knn import brute_force, clustered, collected, frame, same
from tomeglass.operators import knn as kn
from tomeglass.operators import nearest as nn
from tomeglass.operators import quantised as qz
from tomeglass.session import fresh_path
from tests.conftest import rows

PLANS = {"scan": {}, "blocks": {"broadcast_bytes": 0, "block_rows": 64}}


def built(spark, ids, vectors, **how):
    points = frame(spark, "doc_id", ids, vectors)
    return points, qz.write_vector_index(points, fresh_path(spark, "codes"), vectors.shape[1], **how)


def recall(got, want):
    return np.mean([len({i for _, i in got.get(q, [])} & {i for _, i in rows}) / len(rows) for q, rows in want.items()])


@pytest.fixture(scope="module")
def cloud(spark):
    """Vectors without any clusters."""
    rng = np.random.default_rng(1)
    ids, vectors = rng.permutation(3000)[:1500], rng.normal(size=(1500, 24))
    return ids, vectors, *built(spark, ids, vectors)


@pytest.mark.parametrize("plan", PLANS)
def test_neighbours_of_a_cloud(spark, cloud, plan):
    ids, vectors, points, index = cloud
    asked = points.withColumnRenamed("doc_id", "query_id")
    found = qz.search(index, asked, 10, exclude_self=True, **PLANS[plan])
    want = brute_force(ids, vectors, ids, vectors, 10, exclude_self=True)
    got = collected(found.hits)
    assert recall(got, want) > 0.999
    quality = kn.recall_and_share(found, kn.knn(points, asked, 24, exclude_self=True), points, asked).first()
    assert quality.recall > 0.999 and quality.candidate_share == 1
    # 24 bytes of a code and some of the vectors instead of 96 bytes.
    assert found.bytes_share(index) < 0.5


@pytest.mark.parametrize(("plan", "exclude", "cells"), [("scan", True, 1), ("blocks", False, 3)])
def test_copies_and_hot_cells(spark, plan, exclude, cells):
    ids, vectors = clustered(4)
    points, index = built(spark, ids, vectors, centres=np.array([vectors[0], vectors[250], vectors[-1]][:cells]))
    assert index.codes.count() == len(np.unique(vectors, axis=0)) and index.copies.count() == len(vectors) - len(np.unique(vectors, axis=0))
    found = qz.search(index, points.withColumnRenamed("doc_id", "query_id"), 7, exclude_self=exclude, **PLANS[plan])
    same(collected(found.hits), brute_force(ids, vectors, ids, vectors, 7, exclude_self=exclude))


def test_a_wider_code_loses_little_and_less_with_a_smaller_chance(spark):
    rng = np.random.default_rng(4)
    ids, vectors = np.arange(1200), rng.normal(size=(1200, 96))
    points, index = built(spark, ids, vectors, width=4)
    asked = points.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    some = ids % 5 == 0
    want = brute_force(ids, vectors, ids[some], vectors[some], 10)
    found = {miss: qz.search(index, asked, 10, miss=miss) for miss in (0.2, 1e-6)}
    assert 0.8 < recall(collected(found[0.2].hits), want) <= recall(collected(found[1e-6].hits), want)
    assert recall(collected(found[1e-6].hits), want) > 0.99
    assert found[0.2].compared.count() < found[1e-6].compared.count()


@pytest.mark.parametrize("plan", PLANS)
def test_visits_are_confined_to_the_nearest_cells(spark, plan):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 6)) * 20
    vectors = np.vstack([m + rng.normal(size=(40, 6)) for m in middles])
    ids = np.arange(len(vectors))
    points, index = built(spark, ids, vectors, centres=middles)
    assert qz.probes_for(index, 0.95) == 1
    asked = points.withColumnRenamed("doc_id", "query_id")
    found = qz.search(index, asked, 5, probe=1, **PLANS[plan])
    same(collected(found.hits), brute_force(ids, vectors, ids, vectors, 5))
    share = found.work.agg(F.sum(F.col("n") * F.col("visits"))).first()[0] / len(ids) ** 2
    assert share == pytest.approx(1 / 12, abs=0.01)


def test_probes_hold_the_wanted_share(spark):
    rng = np.random.default_rng(3)
    ids, vectors = np.arange(600), rng.normal(size=(600, 8))
    points, index = built(spark, ids, vectors, centres=vectors[:10])
    probe = qz.probes_for(index, 0.9, sample=600)
    assert 1 < probe < 10
    asked = points.withColumnRenamed("doc_id", "query_id")
    want = brute_force(ids, vectors, ids, vectors, 10, exclude_self=True)
    reached = [recall(collected(qz.search(index, asked, 10, probe=p, exclude_self=True).hits), want) for p in (probe - 1, probe)]
    assert reached[0] < 0.9 <= reached[1]


def test_an_index_read_again(spark, cloud):
    ids, vectors, points, _ = cloud
    path = fresh_path(spark, "codes")
    index = qz.write_vector_index(points, path, 24, centres=vectors[:3])
    again = qz.read_vector_index(spark, path, points)
    assert np.array_equal(again.quantiser.levels, index.quantiser.levels) and np.array_equal(again.sizes, index.sizes)
    asked = frame(spark, "query_id", range(5), vectors[:5] + 0.1)
    assert collected(qz.search(again, asked).hits) == collected(qz.search(index, asked).hits) == brute_force(ids, vectors, range(5), vectors[:5] + 0.1, 10)


def test_codes_far_from_the_origin(spark):
    ids, vectors = clustered(9, n=300)
    vectors = vectors + 1e5
    points, index = built(spark, ids, vectors)
    found = qz.search(index, points.withColumnRenamed("doc_id", "query_id"), 6)
    assert collected(found.hits) == brute_force(ids, vectors, ids, vectors, 6)


@pytest.mark.parametrize("plan", PLANS)
def test_odd_tables(spark, plan):
    vectors = spark.createDataFrame([(0, [1.0, 1.0, 9.0]), (1, [1.0, 1.0, 0.0]), (2, None)], "doc_id long, embedding array<double>")
    index = qz.write_vector_index(vectors, fresh_path(spark, "codes"), 3)
    asked = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 1.0, 9.0]), (2, None)], "query_id long, embedding array<double>")
    assert collected(qz.search(index, asked, **PLANS[plan]).hits) == {0: [(0.0, 1), (81.0, 0)], 1: [(0.0, 0), (81.0, 1)]}
    assert qz.search(index, asked.limit(0), **PLANS[plan]).hits.count() == 0
    with pytest.raises(Exception, match="longer than 3"):
        qz.search(index, spark.createDataFrame([(0, [1.0] * 4)], "query_id long, embedding array<double>"), **PLANS[plan]).hits.collect()
    with pytest.raises(Exception, match="see dim_violations"):
        qz.write_vector_index(vectors, fresh_path(spark, "codes"), 2)
    none = qz.write_vector_index(vectors.limit(0), fresh_path(spark, "codes"), 3)
    assert qz.search(none, asked, **PLANS[plan]).hits.count() == 0 and qz.probes_for(none, 0.9) == 1


def test_levels_move_towards_the_vectors(spark):
    rng = np.random.default_rng(6)
    ids, vectors = np.arange(2000), rng.normal(size=(2000, 6))
    points = frame(spark, "doc_id", ids, vectors)
    error = [np.mean(qz.train(points, 6, np.zeros((1, 6)), steps=steps).encode(vectors)[2] ** 2) for steps in (0, 1, 4)]
    assert error[0] > error[1] > error[2]


def test_many_queries_are_not_scanned_by_the_few_tasks_that_read_codes(spark, monkeypatch):
    """More than 16,384 queries met all codes in as many tasks as read them, one for a short file."""
    rng = np.random.default_rng(11)
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rng.normal(size=(300, 20)))], "doc_id long, embedding array<double>")
    index = qz.write_vector_index(points, fresh_path(spark, "many"), 20)
    queries = points.withColumnRenamed("doc_id", "query_id")
    scanned = qz.search(index, queries, exclude_self=True).hits
    monkeypatch.setattr(kn, "SCANNED", 20)
    monkeypatch.setattr(qz, "_scan", None)
    by_blocks = qz.search(index, queries, exclude_self=True, block_rows=64).hits
    exact = kn.knn(points, queries, 20, exclude_self=True)
    assert rows(by_blocks) == rows(scanned) == rows(exact)


@pytest.mark.parametrize("far", [0.0, 1e4, 1e25])
def test_pairs_that_may_lie_within_a_limit(far):
    """What is left out in single precision is beyond the limit in double precision, near the origin and far from it."""
    rng = np.random.default_rng(12)
    queries, vectors = rng.normal(size=(30, 20)) + far, rng.normal(size=(70, 20)) + far
    limit, factor, more = rng.random(30) * 60, 0.5 + rng.random(70), rng.random(70)
    d2 = nn.squared_distances(queries, vectors) if far > 1e9 else ((queries[:, None] - vectors[None]) ** 2).sum(axis=2)
    found = set(zip(*(x.tolist() for x in nn.may_lie_within(queries, vectors, limit, factor, more))))
    within = set(zip(*(x.tolist() for x in np.nonzero(d2 * factor <= limit[:, None] + more))))
    assert within <= found and (far or len(found) < 1.01 * len(within) < 2000)

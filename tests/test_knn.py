import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomeglass.operators import knn as kn
from tomeglass.operators.nearest import Nearest


def brute_force(ids, vectors, query_ids, queries, k, exclude_self=False, digits=6):
    out = {}
    for q, query in zip(query_ids, queries):
        d2 = np.round(((vectors - query) ** 2).sum(axis=1), digits)
        pairs = sorted((d, i) for d, i in zip(d2, ids) if not (exclude_self and i == q))[:k]
        out[int(q)] = [(float(d), int(i)) for d, i in pairs]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["d2"], r["doc_id"]))
        assert r["rank"] == len(out[r["query_id"]])
        assert r["score"] == pytest.approx(1 / (1 + r["d2"]), abs=1e-6)
    return out


def frame(spark, key, ids, vectors):
    data = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(data, f"{key} long, embedding array<double>").repartition(5)


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]], abs=2e-6)


@settings(max_examples=60, deadline=None)
@given(
    n=st.integers(1, 40),
    m=st.integers(1, 8),
    k=st.integers(1, 6),
    step=st.integers(1, 40),
    exclude=st.booleans(),
    seed=st.integers(0, 10_000),
)
def test_running_best_is_brute_force_in_any_batches(n, m, k, step, exclude, seed):
    rng = np.random.default_rng(seed)
    # Few distinct values, so that ties and equal vectors are common.
    vectors, queries = rng.integers(0, 3, (n, 2)).astype(float), rng.integers(0, 3, (m, 2)).astype(float)
    ids = rng.permutation(100)[:n]
    query_ids = rng.permutation(100)[:m]
    best = Nearest(query_ids, queries, k, 6, exclude)
    for at in range(0, n, step):
        best.add(ids[at : at + step], vectors[at : at + step])
    columns = best.columns()
    want = brute_force(ids, vectors, query_ids, queries, k, exclude)
    for q in query_ids:
        mine = columns["query_id"] == q
        assert list(zip(columns["cost"][mine], columns["doc_id"][mine])) == want[int(q)]


def clustered(seed, n=600, dim=4):
    """A third of all vectors are copies of one, another third lie close together."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dim))
    vectors[: n // 3] = vectors[0]
    vectors[n // 3 : 2 * n // 3] = 5 + 0.01 * rng.normal(size=(n // 3, dim))
    return rng.permutation(n * 3)[:n], np.round(vectors, 3)


PLANS = {"scan": {}, "cells": {"broadcast_bytes": 0, "block_rows": 64, "pivots": 12}}


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("exclude", [False, True])
def test_both_plans_are_brute_force_under_skew(spark, plan, exclude):
    ids, vectors = clustered(1)
    got = kn.knn(
        frame(spark, "doc_id", ids, vectors), frame(spark, "query_id", ids, vectors), 4, 7, exclude_self=exclude, **PLANS[plan]
    )
    same(collected(got), brute_force(ids, vectors, ids, vectors, 7, exclude))


@pytest.mark.parametrize("plan", PLANS)
def test_queries_apart_from_the_vectors(spark, plan):
    ids, vectors = clustered(2)
    rng = np.random.default_rng(3)
    queries = np.vstack([rng.normal(size=(30, 4)) * 4, np.full((20, 4), 5.0)])
    got = kn.knn(frame(spark, "doc_id", ids, vectors), frame(spark, "query_id", range(50), queries), 4, 5, **PLANS[plan])
    same(collected(got), brute_force(ids, vectors, range(50), queries, 5))


@pytest.mark.parametrize("plan", PLANS)
def test_fewer_vectors_than_neighbours_asked_for(spark, plan):
    vectors = np.array([[0.0, 0], [1, 0], [1, 0]])
    got = kn.knn(frame(spark, "doc_id", [4, 9, 2], vectors), frame(spark, "query_id", [4], vectors[:1]), 2, 10, **PLANS[plan])
    assert collected(got) == {4: [(0.0, 4), (1.0, 2), (1.0, 9)]}


def test_a_copy_does_not_replace_the_vector_itself(spark):
    vectors = np.array([[1.0, 1], [1, 1], [2, 2]])
    everything = frame(spark, "doc_id", [0, 1, 2], vectors)
    got = kn.knn(everything, everything.withColumnRenamed("doc_id", "query_id"), 2, 1, exclude_self=True)
    assert collected(got) == {0: [(0.0, 1)], 1: [(0.0, 0)], 2: [(2.0, 0)]}


def test_no_queries(spark):
    vectors = frame(spark, "doc_id", [0], np.array([[1.0, 1]]))
    none = frame(spark, "query_id", [0], np.array([[1.0, 1]])).where("false")
    assert kn.knn(vectors, none, 2).collect() == []


def test_dimension_is_declared(spark):
    """A short query is filled up with zeros, and the first query row decides nothing."""
    vectors = spark.createDataFrame([(0, [1.0, 1.0, 9.0]), (1, [1.0, 1.0, 0.0]), (2, None)], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 1.0, 9.0]), (2, None)], "query_id long, embedding array<double>")
    for plan in PLANS.values():
        assert collected(kn.knn(vectors, queries, 3, **plan)) == {0: [(0.0, 1), (81.0, 0)], 1: [(0.0, 0), (81.0, 1)]}
    with pytest.raises(Exception, match="see dim_violations"):
        kn.knn(vectors, queries.where("query_id <> 1"), 2).collect()
    with pytest.raises(Exception, match="longer than 2"):
        kn.knn(vectors.limit(0), queries, 2).collect()
    assert sorted(map(tuple, kn.dim_violations(vectors, 3).collect())) == [(2, 0)]


@pytest.mark.parametrize("plan", PLANS)
def test_digits_survive_far_from_the_origin(spark, plan):
    ids, vectors = clustered(4, n=300)
    vectors = vectors + 1e5
    got = kn.knn(frame(spark, "doc_id", ids, vectors), frame(spark, "query_id", ids, vectors), 4, 6, **PLANS[plan])
    assert collected(got) == brute_force(ids, vectors, ids, vectors, 6)


def test_cells_leave_out_most_of_well_separated_data(spark):
    rng = np.random.default_rng(5)
    vectors = np.vstack([10 * c + rng.normal(size=(40, 3)) for c in range(10)])
    ids = np.arange(400)
    points = frame(spark, "doc_id", ids, vectors)
    dim, k = 3, 5
    kept = kn._lowest_copies(points, k)
    centres = vectors[::40]
    assigned = kn.assign_cells(kept, centres, dim)
    cells = kn._describe(assigned, centres, k)
    visits = kn.BoundedRoute(cells, k, 6)(vectors)
    assert visits.sum() < 0.3 * visits.size
    assert cells.n.sum() == 400


def test_hot_cell_is_cut_into_bounded_blocks(spark):
    ids, vectors = clustered(6)
    points = frame(spark, "doc_id", ids, vectors)
    centres = np.array([vectors[0], vectors[250], vectors[-1]])
    assigned = kn.assign_cells(points, centres, 4)
    cells = kn._describe(assigned, centres, 1)
    assert cells.n.max() >= 200
    everything = points.withColumnRenamed("doc_id", "query_id")
    hits, work = kn._by_blocks(assigned, everything, cells, kn.ProbeRoute(cells, 3), 5, 4, 6, False, 32)
    same(collected(kn._ranked(hits, 5, 6)), brute_force(ids, vectors, ids, vectors, 5))
    assert work.agg(F.sum(F.col("n") * F.col("visits"))).first()[0] == 600 * 600


def test_approximate_search_reports_both_numbers(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(500, 8))
    points = frame(spark, "doc_id", range(500), vectors)
    queries = points.withColumnRenamed("doc_id", "query_id")
    exact = kn.knn(points, queries, 8, 10)
    centres = kn.train_cells(points, 8, 8)
    quality = {}
    for probe in (1, 4, 8):
        approx = kn.knn_approx(points, queries, centres, probe)
        quality[probe] = tuple(kn.recall_and_share(approx, exact, points, queries).first())
    assert quality[8] == (1.0, 1.0)
    assert quality[1][0] < quality[4][0] <= 1 and quality[1][1] < quality[4][1] < 1
    assert quality[4][0] > quality[4][1]


def test_a_query_is_sent_once_to_each_band(spark):
    """It was sent once for every block of every cell that it visits."""
    rng = np.random.default_rng(11)
    ids, vectors = np.arange(600), rng.normal(size=(600, 4))
    points = frame(spark, "doc_id", ids, vectors)
    centres = vectors[:12]
    assigned = kn.assign_cells(points, centres, 4)
    cells = kn._describe(assigned, centres, 1)

    def arrived(left, right):
        return pa.Table.from_pydict({"rows": [left.num_rows], "asking": [right.num_rows]})

    for band_rows, bands in ((10_000, 1), (200, 6)):
        sent, work = kn.blocks_of_cells(
            assigned, points.withColumnRenamed("doc_id", "query_id"), cells.n, kn.ProbeRoute(cells, 12), 4, ["doc_id"], arrived, "rows bigint, asking bigint", band_rows
        )
        rows_sent, asked = sent.agg(F.sum("rows"), F.sum("asking")).first()
        assert rows_sent == 600 and 600 <= asked <= 600 * bands
        assert work.agg(F.sum(F.col("n") * F.col("visits"))).first()[0] == 600 * 600


@pytest.mark.parametrize("band_rows", [40, 150])
def test_bands_and_cells_cut_into_several(spark, monkeypatch, band_rows):
    ids, vectors = clustered(7)
    for name in ("BAND_ROWS", "LEAST_ROWS"):
        monkeypatch.setattr(kn, name, band_rows)
    monkeypatch.setattr(kn.blocks_of_cells, "__defaults__", (band_rows,))
    points = frame(spark, "doc_id", ids, vectors)
    got = kn.knn(points, points.withColumnRenamed("doc_id", "query_id"), 4, 7, exclude_self=True, broadcast_bytes=0, block_rows=16, pivots=12)
    same(collected(got), brute_force(ids, vectors, ids, vectors, 7, True))


def test_own_cells_bound_the_neighbours_and_leave_cells_out(spark, monkeypatch):
    monkeypatch.setattr(kn, "BOUND_ROWS", 16)  # several lots a cell
    rng = np.random.default_rng(8)
    points = np.round(rng.normal(size=(1500, 3)), 3)
    points[:40] = points[0]
    ids = np.arange(1500)
    vectors = frame(spark, "doc_id", ids, points).repartition(3)
    asked = frame(spark, "query_id", ids, points).repartition(3)
    assigned = kn.assign_cells(vectors, points[-64:], 3)
    cells = kn._describe(assigned, points[-64:], 6)
    bounded = kn._bounded(assigned, asked, cells, 5, 3, 6, True).collect()
    d2 = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    last = np.sort(d2, axis=1)[:, 4]
    assert sorted(r["query_id"] for r in bounded) == list(range(1500)) and all(r["bound"] >= last[r["query_id"]] for r in bounded)
    known = np.array([r["bound"] for r in sorted(bounded, key=lambda r: r["query_id"])])
    route = kn.BoundedRoute(cells, 6, 6)
    assert route(points, known).sum() < 0.7 * route(points).sum()
    # More queries than are scanned for go by cells, with the same hits.
    scanned = collected(kn.knn(vectors, asked, 3, 5, exclude_self=True))
    monkeypatch.setattr(kn, "SCANNED", 100)
    assert collected(kn.knn(vectors, asked, 3, 5, exclude_self=True)) == scanned

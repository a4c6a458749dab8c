import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_knn import brute_force, collected, frame
from tests.test_quantised import recall
from tomeglass.operators import graph as gr


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    ids, vectors = rng.permutation(2000)[:700], np.round(rng.normal(size=(700, 16)), 4)
    vectors[600:640] = vectors[0]
    points = frame(spark, "doc_id", ids, vectors)
    return ids, vectors, points, gr.build_graph(points, 16, gr.Settings(degree=16, block_rows=64))


def test_edges_are_true_distances_and_nearly_all_neighbours(spark, cloud):
    ids, vectors, _, graph = cloud
    place = {int(i): v for i, v in zip(ids, vectors)}
    edges = graph.edges.collect()
    kept = {r.doc_id for r in graph.nodes.collect()}
    assert len(kept) == 660 and {r.doc_id for r in edges} == kept
    copies = {(r.doc_id, r.copy_id) for r in graph.copies.collect()}
    same = sorted(int(i) for i in [ids[0], *ids[600:640]])
    assert copies == {(same[0], i) for i in same[1:]}
    lists = {}
    for r in sorted(edges, key=lambda r: r["rank"]):
        assert r.d2 == pytest.approx(((place[r.doc_id] - place[r.neighbour]) ** 2).sum(), abs=1e-6) and r.doc_id != r.neighbour
        lists.setdefault(r.doc_id, []).append((r.d2, r.neighbour))
    assert max(map(len, lists.values())) == 16 and all(row == sorted(row) for row in lists.values())
    nodes = np.array(sorted(kept))
    matrix = np.array([place[i] for i in nodes])
    want = brute_force(nodes, matrix, nodes, matrix, 10, exclude_self=True)
    assert recall({q: row[:10] for q, row in lists.items()}, want) > 0.95
    assert graph.changes[0] > 5 * graph.changes[-1] and len(graph.changes) <= 8


def test_a_walk_finds_the_neighbours(spark, cloud):
    ids, vectors, points, graph = cloud
    rng = np.random.default_rng(2)
    queries = np.vstack([vectors[:3], rng.normal(size=(27, 16))])
    got = collected(gr.search_graph(graph, frame(spark, "query_id", range(30), queries), 16, how=gr.Walk(beam=48)))
    want = brute_force(ids, vectors, range(30), queries, 10)
    assert got.keys() == want.keys() and recall(got, want) > 0.95
    assert [i for _, i in got[0]] == [i for _, i in want[0]]  # eleven copies lie nearest


def test_odd_graphs(spark):
    schema = "doc_id long, embedding array<double>"
    asked = spark.createDataFrame([(7, [1.0])], "query_id long, embedding array<double>")
    none = gr.build_graph(spark.createDataFrame([], schema), 2)
    assert none.edges.count() == 0 and gr.search_graph(none, asked, 2).count() == 0
    one = gr.build_graph(spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0, 0.0]), (2, None)], schema), 2)
    assert one.edges.count() == 0
    assert [(r.doc_id, r.d2) for r in gr.search_graph(one, asked, 2).collect()] == [(1, 0.0), (3, 0.0)]
    assert gr.search_graph(one, asked.limit(0), 2).count() == 0
    with pytest.raises(Exception, match="see dim_violations"):
        gr.build_graph(spark.createDataFrame([(1, [1.0])], schema), 2)

"""Every registered query against its SQL in a second engine, and the shape of its plan."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import TINY
from tomeglass.plans.oracles import ORACLES
from tomeglass.plans.registry import QUERIES

# The registered queries of this package; those of its subpackages have tests of their own.
NAMES = sorted(QUERIES)
TABLES = sorted(name.removesuffix(".parquet") for name in os.listdir(TINY))

# Queries that another engine cannot state.
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{TINY}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(cells, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, TINY)
    relation = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in relation.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, relation.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_no_query_pairs_everything_with_everything(spark, name):
    plan = entry.queries()[name](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "topic_id", "n_docs", "label"] and df.count() == 10


def test_approximate_hits_are_true_distances(spark, tiny):
    approx = entry.queries()["knn_approx"](spark, TINY)
    assert approx.where("rank = 1").count() == tiny.vectors.count()
    exact = entry.queries()["knn_batch"](spark, TINY).select("query_id", "rank", "d2")
    nearer = approx.join(exact.withColumnRenamed("d2", "best"), ["query_id", "rank"]).where("d2 < best")
    assert nearer.count() == 0
    recall, share = entry.queries()["knn_approx_quality"](spark, TINY).first()
    assert 0 < share < 1 and recall > share and recall >= 0.9

import pytest
from pyspark.sql import functions as F

from tomeglass.functions import vectors as vx
from tomeglass.operators.knn import dim_violations


def one(spark, text, expr):
    df = spark.createDataFrame([(text,)], "v string")
    return df.select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("text", ["[1, -2.5, 3e-2]", "(1,-2.5,0.03)", "{ 1, -2.5 ,0.03 }", "⟨1,-2.5,0.03⟩"])
def test_all_kinds_of_brackets(spark, text):
    assert one(spark, text, vx.parse_vector) == pytest.approx([1, -2.5, 0.03])


def test_empty_vector(spark):
    assert one(spark, "[]", vx.parse_vector) == []


def test_unreadable_vector_is_an_error(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, "[1, x]", vx.parse_vector)


def test_query_vector_is_padded_and_checked(spark):
    assert one(spark, "1 2.5", lambda c: vx.parse_query_vector(c, 4)) == [1, 2.5, 0, 0]
    assert one(spark, "1 2 3 4", lambda c: vx.parse_query_vector(c, 4)) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="longer than 4"):
        one(spark, "1 2 3 4 5", lambda c: vx.parse_query_vector(c, 4))


def test_score(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0])], "a array<float>, b array<float>")
    assert df.select(vx.l2_score(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 / 5)


def test_dimension(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0])], "doc_id long, embedding array<float>")
    assert sorted(map(tuple, dim_violations(df, 2).collect())) == [(1, 1), (3, 3)]
    assert df.where("doc_id = 2").select(vx.of_dimension(F.col("embedding"), 2)).first()[0] == [1, 2]
    with pytest.raises(Exception, match="not of dimension 2"):
        df.select(vx.of_dimension(F.col("embedding"), 2)).collect()
    assert [r[0] for r in df.where("doc_id < 3").orderBy("doc_id").select(vx.filled_up(F.col("embedding"), 2)).collect()] == [[1, 0], [1, 2]]
    with pytest.raises(Exception, match="longer than 2"):
        df.select(vx.filled_up(F.col("embedding"), 2)).collect()

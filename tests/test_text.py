from pyspark.sql import functions as F

from tomeglass.functions import text as tx


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v")).alias("x")).collect()]


def test_years(spark):
    raw = ["2003.0", "2003", "None", "", " ", "abc", None, "1999.5.1", " 2001 "]
    assert column(spark, raw, tx.parse_year) == [2003, 2003, None, None, None, None, None, 1999, 2001]


def test_title_fallback(spark):
    assert column(spark, ["A title", "", "  ", None], tx.title_or_default) == ["A title", "No Title", "No Title", "No Title"]


def test_abstract_follows_the_title_and_one_separator(spark):
    df = spark.createDataFrame(
        [(0, "My title\nBody\nmore", "My title"), (1, "Only title", "Only title"), (2, "\nBody", ""), (3, "All of it", None)],
        "i int, t string, title string",
    )
    got = df.orderBy("i").select(tx.abstract_after_title(F.col("t"), F.col("title"))).collect()
    assert [r[0] for r in got] == ["Body\nmore", "", "Body", "All of it"]


def test_tokens(spark):
    got = column(spark, ["The cat's  HAT, naïve_1 -- Über!", "", None, "don’t 3 x2"], tx.tokens)
    assert got == [["the", "cat's", "hat", "naïve_1", "über"], [], [], ["don’t", "3", "x2"]]


def test_query_default(spark):
    assert column(spark, ["", "  ", None, "x"], tx.query_or_default) == ["machine learning"] * 3 + ["x"]


def test_labels_and_missing_values(spark):
    df = spark.createDataFrame([(["a", "b"],)], "w array<string>")
    assert tuple(df.select(tx.topic_label(F.col("w")), tx.topic_label(F.col("w"), ",")).first()) == ("a b", "a,b")
    assert column(spark, ["None", " ", "MIT"], tx.none_to_null) == [None, None, "MIT"]

import pytest
from pyspark.sql import functions as F

from tomeglass import session
from tomeglass.operators import lexical as lex
from tomeglass.sources import index_store, lines, models


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_are_contiguous_over_splits_and_files(spark, tmp_path, small_splits):
    texts = []
    for part, n in (("a", 3000), ("b", 10), ("c", 5000)):
        these = [f"{part}{i}" if i % 7 else "" for i in range(n)]
        (tmp_path / part).write_text("".join(t + "\n" for t in these))
        texts += these
    numbered = lines.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    assert [tuple(r) for r in numbered.orderBy("line_no").collect()] == list(enumerate(texts))


def test_corpus_from_lines(spark, tmp_path):
    files = {
        "text": ["Title A abstract a", "Title B", "", "abstract d", "past the titles"],
        "title": ["Title A", "Title B", "", " "],
        "uri": ["u0", "u1", "u2", "u3"],
        "year": ["2003.0", "None", "", "1999"],
        "university": ["MIT", "None", " VT ", "X"],
    }
    for name, content in files.items():
        (tmp_path / name).write_text("".join(line + "\n" for line in content))
    # The model kept lines 4, 2, 1 and 0, in this order.
    index = spark.createDataFrame([(0, 4), (1, 2), (2, 1), (3, 0)], "doc_id long, line_no long")
    got = lines.corpus_from_lines(spark, {n: str(tmp_path / n) for n in files}, index).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [
        (0, "No Title", "past the titles", None, None, None, None),
        (1, "No Title", "", "u2", "", None, " VT "),
        (2, "Title B", "", "u1", "None", None, None),
        (3, "Title A", "abstract a", "u0", "2003.0", 2003, "MIT"),
    ]


def test_wide_tsv_drops_the_header_and_keeps_quotes(spark, tmp_path):
    def line(title, abstract, vector):
        cells = [""] * 13
        cells[1], cells[5], cells[12] = title, abstract, vector
        return "\t".join(cells)

    path = tmp_path / "wide.tsv"
    path.write_text("\n".join([line("title", "abstract", "vector_bert"), line('A "quoted', "x\\", "[1, 2]"), line("B", "", "(3, 4)")]))
    got = lines.wide_tsv(spark, str(path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, 'A "quoted', "x\\", [1, 2]), (1, "B", "", [3, 4])]


def test_short_lines_keep_their_number(spark, tmp_path):
    path = tmp_path / "wide.tsv"
    head = "\t".join([*(f"c{i}" for i in range(12)), "vector_bert"])
    full = "\t".join(["0", "A", "", "", "", "text", *[""] * 6, "[1, 2]"])
    path.write_text(f"{head}\n{full}\nonly\ttwo\n\n{full}\n")
    got = lines.wide_tsv(spark, str(path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, "A", "text", [1, 2]), (1, "two", None, None), (2, None, None, None), (3, "A", "text", [1, 2])]
    assert sorted(map(tuple, lines.short_lines(spark, str(path)).collect())) == [(1, 2), (2, 1)]


def test_parts_are_ordered_by_number(spark, tmp_path):
    names = ["part-99999-x", "part-100000-x", "part-00002-x"]
    for i, name in enumerate(names):
        (tmp_path / name).write_text(f"{i}a\n{i}b\n")
    got = lines.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [(0, "2a"), (1, "2b"), (2, "0a"), (3, "0b"), (4, "1a"), (5, "1b")]


def make_model(spark, word, weight):
    topics = spark.createDataFrame([(0, [word])], "topic_id long, words array<string>")
    topic_doc = spark.createDataFrame([(0, 7, weight)], "topic_id long, doc_id long, weight double")
    topic_word = spark.createDataFrame([(0, word, weight)], "topic_id long, term string, weight double")
    return models.TopicModel(topics, topic_doc, topic_word)


def test_models_are_picked_by_name_and_replaced_alone(spark, tmp_path):
    root = str(tmp_path / "models")
    models.write_model(make_model(spark, "a", 0.1), root, "LDA_10")
    models.write_model(make_model(spark, "b", 0.2), root, "LDA_25")
    models.write_model(make_model(spark, "c", 0.3), root, "CTM_10")
    models.write_model(make_model(spark, "d", 0.4), root, "LDA_10")
    picked = {n: models.read_model(spark, root, n) for n in ("LDA_10", "LDA_25", "CTM_10")}
    assert {n: m.topics.first()["words"] for n, m in picked.items()} == {"LDA_10": ["d"], "LDA_25": ["b"], "CTM_10": ["c"]}
    assert [tuple(r) for r in picked["LDA_10"].topic_doc.collect()] == [(0, 7, 0.4)]
    assert picked["LDA_10"].topic_doc.columns == ["topic_id", "doc_id", "weight"]
    plan = picked["LDA_10"].topic_doc._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan


def test_dense_rows_and_blocks(spark):
    whole = spark.createDataFrame([(5, [0.1, 0.9])], "doc_id long, w array<double>")
    assert [tuple(r) for r in models.matrix_to_long(whole, "doc_id", "w", "topic_id").collect()] == [(5, 0, 0.1), (5, 1, 0.9)]
    blocks = spark.createDataFrame([(0, 0, [0.1, 0.2]), (0, 2, [0.3])], "topic_id long, first long, w array<double>")
    got = models.matrix_to_long(blocks, "topic_id", "w", "doc_id", offset="first").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0.1), (0, 1, 0.2), (0, 2, 0.3)]


def test_index_is_written_once_and_read_back(spark, tmp_path):
    documents = spark.createDataFrame([(i, f"w{i % 3} the the", "") for i in range(50)], "doc_id long, title string, abstract string")
    path = str(tmp_path / "index")
    for _ in range(2):
        index = index_store.write_index(documents, ["title", "abstract"], path, buckets=4)
    assert index.postings.count() == 100
    assert index.postings.agg(F.sum("tf")).first()[0] == 150
    assert [tuple(r) for r in index.field_stats.select("field", "n_docs", "n_all", "avg_dl").collect()] == [("title", 50, 50, 3.0)]
    again = index_store.read_index(spark, path)
    assert sorted(map(tuple, again.term_stats.collect())) == [("title", "the", 50), ("title", "w0", 17), ("title", "w1", 17), ("title", "w2", 16)]
    assert lex.term_stats(again).count() == 4


def test_shared_folder_follows_the_setting(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return "/shared/checkpoints/" if key == "spark.checkpoint.dir" else default

    class Context:
        applicationId = "app-1"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return "/shared/checkpoints/app"

    class Named:
        conf, sparkContext = Conf(), Context()

    assert session.shared_dir(Named()) == "/shared/checkpoints"
    assert session.fresh_path(Named(), "x").startswith("/shared/checkpoints/tomeglass/app-1/x-")


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_clean_up_deletes_what_this_application_wrote(spark, tmp_path, monkeypatch):
    own = str(tmp_path / "shared" / "tomeglass" / "app")
    monkeypatch.setattr(session, "_own_dir", lambda _: own)
    documents = spark.createDataFrame([(1, "a b")], "doc_id long, title string")
    index_store.write_index(documents, ["title"], f"{own}/index", buckets=2)
    kept = index_store.write_index(documents, ["title"], str(tmp_path / "kept"), buckets=2)
    session.cut_lineage(documents)
    entries = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("postings_")}
    before = entries()
    session.clean_up(spark)
    assert not (tmp_path / "shared" / "tomeglass" / "app").exists() and len(before) - len(entries()) == 1
    assert kept.postings.count() == 2


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_postings_are_not_shuffled_after_their_texts(spark, tmp_path, monkeypatch, kind):
    """They were hashed into the same buckets once more. A task writes one bucket, whatever the type of the ids."""
    documents = spark.range(200).select(F.col("id").cast(kind).alias("doc_id"), F.concat(F.lit("a b b w"), "id").alias("text"))
    rows = lex.postings(lex.token_arrays(lex.by_document(documents, ["text"], 4), ["text"]))
    monkeypatch.setattr(type(rows), "repartition", lambda *_: pytest.fail("shuffled again"))
    index_store.write_postings(rows, f"{tmp_path}/p", 4)
    assert len(list(tmp_path.glob("p/part-*.parquet"))) == 4
    stored = index_store.read_postings(spark, f"{tmp_path}/p", 4)
    assert stored.count() == 600 and stored.agg(F.sum("tf")).first()[0] == 800
    found = stored.groupBy("doc_id").count()
    assert found.count() == 200 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]

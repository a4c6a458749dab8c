import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeglass.functions import joins
from tomeglass.operators import documents as docs
from tomeglass.operators import lexical as lex
from tomeglass.operators import nearest
from tomeglass.operators.nearest import HighestScores
from tomeglass.sources.index_store import write_index

SCHEMA = "doc_id long, title string, abstract string"


def index_of(spark, records, tmp_path, buckets=4):
    return write_index(spark.createDataFrame(records, SCHEMA), ["title", "abstract"], str(tmp_path / "ix"), buckets)


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def words(text):
    return re.findall(r"\w+", text.lower())


def brute_force(records, query, fields, k1=1.0, b=0.65, k=10, classic=False):
    scores = Counter()
    wanted = Counter(words(query))
    for field in fields:
        texts = {r[0]: words(r[1 if field == "title" else 2]) for r in records}
        filled = [t for t in texts.values() if t]
        avg = sum(map(len, filled)) / len(filled) if filled else 0
        for term, qtf in wanted.items():
            df = sum(term in t for t in filled)
            for doc, text in texts.items():
                tf = text.count(term)
                if not tf:
                    continue
                if classic:
                    scores[doc] += tf * (math.log(len(records) / (df + 1)) + 1)
                else:
                    idf = math.log(1 + (len(filled) - df + 0.5) / (df + 0.5))
                    scores[doc] += qtf * idf * tf / (tf + k1 * (1 - b + b * len(text) / avg))
    ranked = sorted(((round(s, 6), d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))
    return [(i + 1, d, pytest.approx(s, abs=2e-6)) for i, (s, d) in enumerate(ranked[:k])]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]

    def text(n):
        # "the" stands in every text that has any word.
        return " ".join(["the"] * (n > 0) + [vocabulary[int(rng.random() ** 3 * 40)] for _ in range(n)])

    return [(i, text(rng.randrange(0, 7)), text(rng.choice([0, 5, 40]))) for i in range(300)]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    return index_of(spark, corpus, tmp_path_factory.mktemp("lex"))


def test_postings_are_counted_without_a_shuffle(spark, corpus):
    documents = spark.createDataFrame(corpus, SCHEMA)
    found = lex.postings(lex.token_arrays(documents, ["title", "abstract"]))
    assert "Exchange" not in explained(found) and "Aggregate" not in explained(found)
    want = {
        (r[0], field, term, tf, len(words(text)))
        for r in corpus
        for field, text in (("title", r[1]), ("abstract", r[2]))
        for term, tf in Counter(words(text)).items()
    }
    got = [tuple(r) for r in found.select("doc_id", "field", "term", "tf", "dl").collect()]
    assert len(got) == len(want) and set(got) == want


TEXTS = ["the w0 w0 w3", "w39 w38 nothing", "unknown words", "the"]


def hits(df):
    return [(r["rank"], r["doc_id"], r["score"]) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("fields", [["title"], ["title", "abstract"]])
@pytest.mark.parametrize("params", [(1.0, 0.65), (1.2, 0.75)])
def test_bm25_is_brute_force(spark, corpus, index, fields, params):
    found = lex.search(index, queries(spark, *TEXTS), fields=fields, scoring=lex.bm25(*params))
    for i, text in enumerate(TEXTS):
        assert hits(found.where(F.col("query_id") == i)) == brute_force(corpus, text, fields, *params)


def test_tf_idf_counts_a_repeated_query_word_once(spark, corpus, index):
    found = lex.search(index, queries(spark, *TEXTS), fields=["abstract"], scoring=lex.tf_idf())
    for i, text in enumerate(TEXTS):
        assert hits(found.where(F.col("query_id") == i)) == brute_force(corpus, text, ["abstract"], classic=True)


@pytest.mark.parametrize("make", [lex.bm25, lex.tf_idf])
def test_all_plans_give_the_same_hits(spark, index, make, monkeypatch):
    scoring = make()
    texts = TEXTS * 5 + ["w5 w6 the", "w7"]

    def found(batch):
        ids = spark.createDataFrame([(i, texts[i]) for i in batch], "query_id long, text string")
        df = lex.search(index, ids, fields=["title", "abstract"], scoring=scoring)
        plan = df._jdf.queryExecution().executedPlan().toString()
        return sorted(map(tuple, df.collect())), plan

    shared, shared_plan = found(range(len(texts)))
    assert "MapInArrow" in shared_plan and "FlatMapCoGroupsInArrow" not in shared_plan

    alone = [found([i]) for i in range(len(texts))]
    assert all("InArrow" not in plan for _, plan in alone)
    assert same_hits(shared, sorted(sum((h for h, _ in alone), [])))

    monkeypatch.setattr(lex, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(lex, "BLOCK_ENTRIES", 700)
    blocks, blocks_plan = found(range(len(texts)))
    assert "FlatMapCoGroupsInArrow" in blocks_plan and "_salt" in blocks_plan
    assert same_hits(blocks, shared)


def test_long_queries_are_scored_in_small_tiles(monkeypatch):
    monkeypatch.setattr(nearest, "CELLS", 3)
    best = HighestScores(np.arange(3), np.array([0, 0, 1, 2]), np.array([5, 6, 5, 7]), np.array([1.0, 1, 2, 1]), 2, 6)
    best.add(np.array([10, 11, 12]), np.array([0, 0, 1, 2]), np.array([5, 6, 5, 8]), np.array([1.0, 0.5, 2.0, 9.0]))
    assert list(zip(*best.columns().values())) == [(0, 11, -2.0), (0, 10, -1.5), (1, 11, -4.0), (1, 10, -2.0)]


def same_hits(a, b):
    return [h[:3] for h in a] == [h[:3] for h in b] and [h[3] for h in a] == pytest.approx([h[3] for h in b], abs=2e-6)


def test_only_titles_match_by_default(spark, tmp_path):
    index = index_of(spark, [(0, "apple", "pear"), (1, "pear", "apple"), (2, "", "apple")], tmp_path)
    assert [h[1] for h in hits(lex.search(index, queries(spark, "apple")))] == [0]
    both = lex.search(index, queries(spark, "apple"), fields=["title", "abstract"])
    assert sorted(h[1] for h in hits(both)) == [0, 1, 2]


def test_equal_scores_rank_by_id(spark, tmp_path):
    index = index_of(spark, [(i, "same words here", "") for i in (9, 3, 7, 1)], tmp_path)
    assert [h[:2] for h in hits(lex.search(index, queries(spark, "words"), k=3))] == [(1, 1), (2, 3), (3, 7)]


def test_empty_query_stands_for_the_default(spark, tmp_path):
    index = index_of(spark, [(0, "Machine shops", ""), (1, "deep learning", ""), (2, "poetry", "")], tmp_path)
    found = lex.search(index, queries(spark, "", "  ", "machine learning")).collect()
    by_query = {q: sorted((r["doc_id"], r["score"]) for r in found if r["query_id"] == q) for q in range(3)}
    assert by_query[0] == by_query[1] == by_query[2] and [d for d, _ in by_query[0]] == [0, 1]


def test_pages_continue_each_other(spark, index):
    one = queries(spark, "the w1")
    whole = hits(lex.search(index, one, k=30))
    pages = [hits(lex.search_page(index, one, page=p, size=12)) for p in (1, 2, 3)]
    assert pages[0] + pages[1] + pages[2][:6] == whole and pages[1][0][0] == 13


@pytest.mark.parametrize("large", [False, True])
def test_hits_get_title_and_abstract(spark, corpus, index, large, request):
    if large:
        request.getfixturevalue("no_broadcast")
    documents = spark.createDataFrame(corpus, SCHEMA)
    found = lex.search(index, queries(spark, "the w1", "w2"))
    shown = docs.with_documents(found, documents)
    by_id = {r[0]: r for r in corpus}
    got = shown.collect()
    assert len(got) == found.count()
    assert all((r["title"], r["abstract"]) == by_id[r["doc_id"]][1:] for r in got)


def test_search_shuffles_only_the_best_hits(spark, index):
    """Scores add up where the document lies: one exchange between the postings and the result."""
    found = lex.search(index, queries(spark, "the w1"), fields=["title", "abstract"])
    assert_one_shuffle(found)
    assert "PushedFilters: [In(field" in explained(found) and "In(term, [the,w1])" in explained(found)
    batch = lex.search(index, queries(spark, "the w1", "the w2"), fields=["title", "abstract"])
    assert "MapInArrow" in explained(batch)
    assert_one_shuffle(batch)


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_one_shuffle(found):
    plan = found._jdf.queryExecution().executedPlan().toString()
    above_scan = plan[: plan.index("Bucketed: true")]
    assert above_scan.count("Exchange hashpartitioning") == 1
    assert above_scan.index("Exchange hashpartitioning(query_id") < above_scan.index("WindowGroupLimit", above_scan.index("Exchange hashpartitioning"))


def test_all_plans_agree_when_weights_have_any_sign(spark, monkeypatch, tmp_path):
    """A score that is not positive is still a score: the plan, which depends on the batch, decides no hit."""
    documents = spark.createDataFrame([(i, f"a{' b' * (i % 3)} w{i}") for i in range(30)], "doc_id long, title string")
    index = write_index(documents, ["title"], str(tmp_path / "index"), buckets=3)
    falling = lex.Scoring(F.col("tf") * (F.col("df") - 40).cast("double") / 10, repeats=True)
    queries = spark.createDataFrame([(0, "a b"), (1, "b w3")], "query_id long, text string")
    apart = [lex.search(index, queries.where(f"query_id = {i}"), scoring=falling) for i in range(2)]
    own = sorted(tuple(r) for df in apart for r in df.collect())
    assert len(own) == 20 and any(r[3] <= 0 for r in own)
    assert sorted(map(tuple, lex.search(index, queries, scoring=falling).collect())) == own
    monkeypatch.setattr(lex, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, lex.search(index, queries, scoring=falling).collect())) == own


@pytest.mark.parametrize("plan", ["own words", "shared words", "blocks"])
def test_pages_behind_a_hit(spark, index, monkeypatch, plan):
    """Ten pages of seven, each behind the last hit before it, are the ranked hits; a query without a last hit begins anew."""
    asked = queries(spark, "the w1") if plan == "own words" else queries(spark, "the w1", "w2 the", "w0 w1 w2")
    fields = ["title", "abstract"]
    whole = sorted((r.query_id, r["rank"], r.doc_id) for r in lex.search(index, asked, k=70, fields=fields).collect())
    if plan == "blocks":
        monkeypatch.setattr(lex, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(lex, "BLOCK_ENTRIES", 700)
    found, last = [], None
    for page in range(10):
        rows = lex.search(index, asked, k=7, fields=fields, after=last).collect()
        found += [(r.query_id, r["rank"] + 7 * page, r.doc_id) for r in rows]
        last = spark.createDataFrame([(r.query_id, r.score, r.doc_id) for r in rows if r["rank"] == 7], "query_id long, score double, doc_id long")
        if last.count() < asked.count():
            break
    assert sorted(found) == [r for r in whole if r[1] <= 7 * (page + 1)] and page > 3
    first = lex.search(index, asked, k=7, fields=fields, after=last.limit(0)).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in first) == [r for r in whole if r[1] <= 7]

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tomeglass.functions import joins
from tomeglass.operators import lexical as lex
from tomeglass.operators import matching as mt
from tomeglass.operators.matching import All, Any, Not, Pattern, Phrase, Prefix, Similar, Word
from tomeglass.sources.index_store import write_index

FIELDS = ("title", "abstract")
SYLLABLES = ["ab", "ba", "cab", "ad", "be", "é", "x"]


def words(text):
    return re.findall(r"\w+", (text or "").lower())


@pytest.fixture(scope="module")
def records():
    rng = random.Random(5)
    vocabulary = sorted({"".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(60)})

    def text(n):
        return " ".join(rng.choice(vocabulary[: 1 + int(rng.random() ** 2 * len(vocabulary))]) for _ in range(n))

    rows = [(i, text(rng.randrange(0, 6)), text(rng.choice([0, 4, 60]))) for i in range(250)]
    return rows + [(900, None, "ab ba ab"), (901, "ab ab ab", None), (902, "", "")]


@pytest.fixture(scope="module")
def index(spark, records, tmp_path_factory):
    documents = spark.createDataFrame(records, "doc_id long, title string, abstract string")
    return write_index(documents, list(FIELDS), str(tmp_path_factory.mktemp("matching") / "ix"), 4)


@pytest.fixture(scope="module")
def brute(records):
    return Brute(records)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


class Brute:
    """Every condition on every document."""

    def __init__(self, records):
        self.texts = {f: {r[0]: t for r in records if (t := words(r[1 + i]))} for i, f in enumerate(FIELDS)}
        self.ids = [r[0] for r in records]
        self.df = {f: Counter(w for t in texts.values() for w in set(t)) for f, texts in self.texts.items()}
        self.avg = {f: sum(map(len, t.values())) / len(t) for f, t in self.texts.items()}

    def weight(self, field, term, tf, doc):
        n, df = len(self.texts[field]), self.df[field][term]
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * tf / (tf + 1.0 * (1 - 0.65 + 0.65 * len(self.texts[field][doc]) / self.avg[field]))

    def leaf(self, leaf, doc):
        total, hit = 0.0, False
        for field in [leaf.field] if leaf.field else FIELDS:
            text = self.texts[field].get(doc, [])
            if isinstance(leaf, (Prefix, Pattern)):
                shape = re.escape(leaf.text.lower()) + ".*" if isinstance(leaf, Prefix) else re.escape(leaf.text.lower()).replace(r"\*", ".*").replace(r"\?", ".")
                if any(re.fullmatch(shape, w) for w in text):
                    total, hit = total + leaf.boost, True
            elif isinstance(leaf, Similar):
                word = leaf.text.lower()
                for term in set(text):
                    factor = 1 - edits(word, term) / min(len(word), len(term))
                    if edits(word, term) <= leaf.edits and factor > 0:
                        total, hit = total + leaf.boost * factor * self.weight(field, term, text.count(term), doc), True
            else:
                wanted = words(leaf.text)
                begins = [{i - at for i, w in enumerate(text) if w == term} for at, term in enumerate(wanted)]
                slop = getattr(leaf, "slop", 0)
                tf = sum(all(any(m <= b <= m + slop for b in w) for w in begins) for m in set().union(*begins)) if wanted else 0
                if tf:
                    total, hit = total + sum(leaf.boost * self.weight(field, term, tf, doc) for term in wanted), True
        return hit, total

    def judge(self, condition, doc, boost=1.0):
        if isinstance(condition, mt.Leaf):
            hit, score = self.leaf(condition, doc)
            return hit, boost * score if hit else 0.0, hit
        parts = [self.judge(p, doc, boost * condition.boost) for p in condition.parts]
        met = any(m for *_, m in parts)
        if isinstance(condition, Not):
            return not any(h for h, *_ in parts), 0.0, met
        hit = (all if isinstance(condition, All) else any)(h for h, *_ in parts)
        return hit, sum(s for _, s, _ in parts) if hit else 0.0, met

    def hits(self, condition, k=10):
        found = [(round(score, 6), doc) for doc in self.ids for hit, score, met in [self.judge(condition, doc)] if hit and met]
        return [(doc, pytest.approx(score, abs=2e-6)) for score, doc in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def check(index, brute, conditions, k=10):
    got = collected(mt.search(index, conditions, k=k, fields=FIELDS))
    for q, condition in conditions.items():
        want = brute.hits(condition, k)
        mine = got.get(q, [])
        # Scores that differ in the last digit may change places.
        assert len(mine) == len(want) and [s for _, s in mine] == [s for _, s in want], (q, mine, want)
        if len({s for _, s in mine}) == len(mine):
            assert [d for d, _ in mine] == [d for d, _ in want], q
    return got


def random_leaf(rng, vocabulary):
    word, boost, field = rng.choice(vocabulary), rng.choice([1.0, 1.0, 2.5]), rng.choice([None, None, "title", "abstract"])
    kind = rng.randrange(6)
    if kind == 0:
        return Prefix(word[: rng.randint(1, 3)], field, boost)
    if kind == 1:
        at = rng.randrange(len(word))
        return Pattern(word[:at] + rng.choice("*?") + word[at + 1 :], field, boost)
    if kind == 2:
        return Similar(word, field, boost, edits=rng.randint(0, 2))
    if kind == 3:
        return Phrase(" ".join(rng.choice(vocabulary[:4]) for _ in range(rng.randint(1, 3))), field, boost, slop=rng.randint(0, 3))
    return Word(word, field, boost)


def random_condition(rng, vocabulary, depth):
    if not depth or rng.random() < 0.3:
        return random_leaf(rng, vocabulary)
    kind = rng.choice([All, Any, Any, Not])
    return kind(*(random_condition(rng, vocabulary, depth - 1) for _ in range(rng.randint(1, 3))), boost=rng.choice([1.0, 0.5]))


@pytest.mark.parametrize("few", [True, False])
def test_a_batch_of_nested_conditions(spark, index, brute, monkeypatch, few):
    if not few:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(mt, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(lex, "PRUNE_TERMS", 1)
        monkeypatch.setattr(mt, "RANGES", 1)
    rng = random.Random(17)
    vocabulary = sorted(brute.df["abstract"], key=lambda w: -brute.df["abstract"][w])
    conditions = {q: random_condition(rng, vocabulary, 3) for q in range(400 if few else 40)}
    got = check(index, brute, conditions)
    assert len(got) > len(conditions) / 2


def test_each_kind_of_leaf(spark, index, brute):
    got = check(
        index,
        brute,
        {
            0: Prefix("a"), 1: Pattern("*b"), 2: Pattern("?b*"), 3: Similar("ab", edits=1), 4: Similar("cabab", edits=2), 5: Phrase("ab ab"),
            6: Phrase("ab ba", slop=3), 7: Word("AB ba"), 8: Prefix("É"), 9: Word("ab", field="title"), 10: Pattern("ab"), 11: Similar("zzzzzz", edits=1),
        },
    )
    assert 11 not in got and got[0] and got[5]


def test_leaves_without_words_and_patterns_of_other_signs(spark, index):
    conditions = {0: Word(""), 1: Prefix(""), 2: Phrase(" . "), 3: Pattern("a.*"), 4: Any(Word(""), Word("ab")), 5: All(Word(""), Word("ab")), 6: Not(Word("ab")), 7: Pattern("a\\E*")}
    assert set(collected(mt.search(index, conditions, fields=FIELDS))) == {4}
    assert mt.search(index, {}, fields=FIELDS).count() == 0


def test_similar_terms_are_all_terms_within_the_distance(spark, index, brute):
    wanted = [("ab", 1), ("ab", 2), ("cabad", 2), ("a", 1), ("xéxé", 2), ("babab", 1), ("ababab", 3), ("q", 2)]
    got = {(r.word, r.edits, r.term, r.distance) for r in mt.similar_terms(index, spark.createDataFrame(wanted, "word string, edits int")).collect()}
    terms = set(brute.df["title"]) | set(brute.df["abstract"])
    assert got == {(w, e, t, edits(w, t)) for w, e in wanted for t in terms if edits(w, t) <= e}


def test_pairs_of_letters_count_repeats(spark):
    row = spark.range(1).select(lex.pairs_of_letters(F.lit("aaa")).alias("a"), lex.pairs_of_letters(F.lit("é")).alias("b")).first()
    assert row.a == ["^a1", "aa1", "aa2", "a$1"] and row.b == ["^é1", "é$1"]


def test_positions_are_places_in_the_text(spark, index, brute):
    for r in index.postings.collect():
        text = brute.texts[r.field][r.doc_id]
        assert r.positions == [i for i, w in enumerate(text) if w == r.term] and r.tf == len(r.positions) and r.dl == len(text)


def test_phrases_read_the_row_groups_of_their_words_only(spark, index):
    leaves, _ = mt.as_tables(spark, {0: Phrase("ab ba")}, FIELDS)
    plan = mt._pruned(index, leaves.select(F.explode(F.split("text", " ")).alias("term")), FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(field, [abstract,title]), In(term, [ab,ba])]" in plan


def test_syntax_without_a_limit_of_words(spark, index, monkeypatch):
    texts = ['+ab -"ab ba"', '"ba ab" cab', 'title:ab +"ab ab"', "-ab x"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    small = collected(lex.search_syntax(index, queries, fields=FIELDS))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(lex, "BROADCAST_ROWS", -1)
    assert collected(lex.search_syntax(index, queries, fields=FIELDS)) == small and len(small) == 4

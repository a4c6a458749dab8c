"""Word languages, role repair and target draws against plain Python, on small tables with every odd case."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tomeglass.llm import conversation_repair as cr
from tomeglass.llm import language_labels as ll
from tomeglass.llm import resampling as rs
from tomeglass.llm import shingles as sh

RNG = random.Random(3)


# Role repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Every way kept per place in the role order: (cost, letters, repaired rows)."""

    def better(ways, place, way):
        if place not in ways or way[:2] < ways[place][:2]:
            ways[place] = way
            return True

    def insert(ways):
        while any([better(ways, NEXT[p, i], (c + 2, a + "I", (*o, f"{ROLES[i]}:"))) for p, (c, a, o) in list(ways.items()) for i in "ua" if (p, i) in NEXT]):
            pass
        return ways

    ways = insert({0: (0, "", ())})
    for role, text, bad, late in rows:
        after = {}
        for place, (c, a, o) in ways.items():
            better(after, place, (c + 3, a + "D", o))
            if not bad and (place, role[:1]) in NEXT:
                better(after, NEXT[place, role[:1]], (c + late, a + "K", (*o, f"{role}:{text}")))
            for i in "ua":
                if not bad and (place, i) in NEXT:
                    better(after, NEXT[place, i], (c + 2 + late, a + "R", (*o, f"{ROLES[i]}:{text}")))
        ways = insert(after)
    return min(ways[p] for p in (0, 3) if p in ways)


def expected_repair(rows):
    """``rows`` of one conversation (turn, role, text) as (gaps, blank, duplicate, truncated, illegal, cost, audit, rows)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, counts, judged = set(), Counter(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(judged)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit), out


def check_repair(spark, rows):
    schema = "conv_id bigint, turn bigint, role string, text string, part int, place string, key string, audit string, seen int"
    found = cr.repair(spark.createDataFrame([(*r, 1, "x", "y", "z", 2) for r in rows], schema))
    groups = defaultdict(list)
    for conv_id, *row in rows:
        groups[conv_id].append(row)
    expected = {c: expected_repair(g) for c, g in groups.items()}
    assert {r.conv_id: tuple(r)[1:] for r in found.reports.collect()} == {c: e[0] for c, e in expected.items()}
    repaired = defaultdict(list)
    for r in found.rows.orderBy("position").collect():
        repaired[r.conv_id].append(f"{r.role}:{r.text}")
    assert repaired == {c: list(e[1]) for c, e in expected.items() if e[1]}
    digests = {r.conv_id: r.sha256 for r in cr.digests(found.rows).collect()}
    assert digests == {c: hashlib.sha256("\n".join(o).encode()).hexdigest() for c, o in repaired.items()}


def random_rows(rng, conv_id, n):
    texts = ["Yes.", "No!", "Why?", "cut", "", " ", None, "One more. ", "two.\n", "é"]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    return [(conv_id, rng.choice([None, i, i, i]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {i}{rng.choice('.!?x')}") for i in range(n)]


def test_repair_equals_plain_python(spark):
    rng = random.Random(11)
    rows = [row for c in [None, *range(150)] for row in random_rows(rng, c, rng.randint(1, 9))]
    rng.shuffle(rows)
    check_repair(spark, rows)


def test_a_long_conversation_is_parsed_in_parts(spark):
    rng = random.Random(12)
    rows = random_rows(rng, 7, 600) + random_rows(rng, 3, 5) + random_rows(rng, 9, 5) + [(5, i, "other", f"t{i}.") for i in range(301)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbered = cr._numbered(cr.with_faults(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
        assert numbered.where("conv_id = 7").select("part").distinct().count() > 2
        check_repair(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_repair_of_nothing(spark):
    none = cr.repair(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert none.reports.count() == none.rows.count() == cr.digests(none.rows).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()), max_size=12), st.integers(0, 12))
def test_parts_put_together_equal_one_parse(rows, cut):
    symbols = [cr.Symbol(*r) for r in rows]
    plain = [({"u": "user", "a": "assistant", "s": "system", "x": "x"}[i], "t", bad, int(late)) for i, bad, late in rows]
    parts = [p for p in (symbols[:cut], symbols[cut:]) if p]
    if not parts:
        return
    listed = []
    for part in parts:
        entries = [(cr.BEGINS, cr.BOTTOM, True), *((i, node, False) for i, node in enumerate(cr.STACKS))]
        listed.append([{"entry": e, "end": cr.STACKS.index(end), "cost": c, "letters": a} for e, node, b in entries for end, c, a in cr.parse(node, part, b)])
    cost, _, letters = cr.joined(listed)
    assert (cost, "".join(letters)) == cheapest(plain)[:2]


def test_damage_follows_the_crc(spark):
    rows = [(c, t, "assistant", "Well. So!") for c in (1, 2, None) for t in (*range(40), None)]
    found = Counter(tuple(r) for r in cr.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect())
    expected = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            expected[c, t, "user" if kind == 4 else role, {1: "", 2: "Well So"}.get(kind, text)] += 2 if kind == 3 else 1
    assert found == expected


# Target draws


@given(st.binary(max_size=40), st.binary(max_size=3000))
def test_crc_of_joined_texts(a, b):
    crc = [np.array([zlib.crc32(x)], np.uint32) for x in (a, b, a + b)]
    assert rs.appended(crc[0], crc[1], np.array([len(b)]))[0] == crc[2][0]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_buckets(text, order, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbé \n\x00\x85\xa0.İ字９")), min_size=1, max_size=6))
def test_scans_equal_plain_words(texts):
    import pyarrow as pa

    for order in (1, 2, 3):
        how = rs.Draw(order=order, buckets=97)
        slices = list(sh.text_slices(pa.array(texts)))
        assert len(slices) == 1
        buckets, first = rs.run_buckets(rs.scan(slices[0]), how)
        for i, text in enumerate(texts):
            assert sorted(buckets[first[i] : first[i + 1]]) == sorted(word_buckets(text, order, 97)[1])


def expected_draw(docs, target, how):
    measured = [(i, *word_buckets(t, how.order, how.buckets)) for i, t in docs]
    s, t = Counter(b for _, _, f in measured for b in f), Counter(b for x in target for b in word_buckets(x, how.order, how.buckets)[1])
    s_all, t_all = s.total() + how.buckets, t.total() + how.buckets
    rows = []
    for i, n, f in measured:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= how.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = [(*r, k) for k, r in enumerate(able[: how.percent * len(able) // 100], 1)]
    return Counter(drawn) + (Counter((*r, None) for r in rows) - Counter((*r[:-1], None) for r in drawn))


DRAW_SCHEMA = "doc_id bigint, text string, score string, weight string, above string, bucket string, n_words int"


@pytest.mark.parametrize("how", [rs.Draw(), rs.Draw(order=3, buckets=50, percent=60, least_words=2), rs.Draw(order=1, percent=100, least_words=0)])
def test_draw_equals_plain_python(spark, how):
    words = ["Alpha", "beta", "g4mma", "délta", "字", "x" * 300]
    docs = [(i, " ".join(RNG.choice(words) for _ in range(RNG.randint(0, 60)))) for i in range(80)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (4, "beta"), (None, docs[5][1]), (None, None), (90, None), (91, ""), (92, "beta " * 30_000), (93, ". ,\n")]
    target = ["beta g4mma beta", "Délta; x", None, ""]
    rows = spark.createDataFrame([(*d, "a", "b", "c", "d", 1) for d in docs], DRAW_SCHEMA).repartition(3)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    assert Counter(tuple(r) for r in rs.resample(rows, wanted, how).collect()) == expected_draw(docs, target, how)


def test_draw_from_and_towards_nothing(spark):
    none = spark.createDataFrame([], DRAW_SCHEMA)
    assert rs.resample(none, none).count() == 0
    docs = [(i, "one two three " * 10) for i in range(8)]
    found = rs.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), none)
    assert Counter(tuple(r) for r in found.collect()) == expected_draw(docs, [], rs.Draw())


# Word languages


def random_chains(rng, n_words, lengths, L):
    scores = rng.normal(0, 2, (n_words, L))
    word = rng.integers(0, n_words, sum(lengths))
    return scores, word, np.concatenate([[0], np.cumsum(lengths)]), rng.normal(0, 1, (L, L))


def all_marginals(scores, word, first, transitions):
    out = np.zeros((len(word), scores.shape[1]))
    for at, share in ll.marginals(scores, word, first, transitions):
        out[at] = share
    return out


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(1)
    scores, word, first, transitions = random_chains(rng, 5, [0, 1, 6, 0, 3], 3)
    expected = np.zeros((len(word), 3))
    for a, b in zip(first, first[1:]):
        for labels in itertools.product(range(3), repeat=int(b - a)):
            weight = math.exp(sum(scores[word[a + i], l] for i, l in enumerate(labels)) + sum(transitions[x, y] for x, y in zip(labels, labels[1:])))
            for i, l in enumerate(labels):
                expected[a + i, l] += weight
    expected /= expected.sum(axis=1, keepdims=True)
    assert np.allclose(all_marginals(scores, word, first, transitions), expected)
    assert np.allclose(ll.expected(scores, word, np.diff(first)[np.diff(first) > 0], transitions)[0], expected)


def test_blocks_equal_one_long_chain(monkeypatch):
    rng = np.random.default_rng(2)
    scores, word, first, transitions = random_chains(rng, 40, [1000, 31, 32, 33, 0, 65, 1, 2500], 4)
    expected = ll.expected(scores, word, np.diff(first)[np.diff(first) > 0], transitions)[0]
    for at_once in (3, ll.BLOCKS_AT_ONCE):
        monkeypatch.setattr(ll, "BLOCKS_AT_ONCE", at_once)
        assert np.allclose(all_marginals(scores, word, first, transitions), expected)


def test_gradient_is_expected_minus_observed():
    rng = np.random.default_rng(3)
    scores, word, first, transitions = random_chains(rng, 6, [4, 3], 3)
    labels = rng.integers(0, 3, len(word))

    def log_likelihood(scores, transitions):
        total = 0.0
        for a, b in zip(first, first[1:]):
            alpha = scores[word[a]]
            for i in range(a + 1, b):
                alpha = np.log(np.exp(alpha[:, None] + transitions).sum(axis=0)) + scores[word[i]]
            own = labels[a:b]
            total += scores[word[a:b], own].sum() + transitions[own[:-1], own[1:]].sum() - np.log(np.exp(alpha).sum())
        return total

    share, pairs = ll.expected(scores, word, np.diff(first), transitions)
    for x, y in itertools.product(range(3), range(3)):
        moved = np.zeros((3, 3))
        moved[x, y] = 1e-5
        slope = (log_likelihood(scores, transitions + moved) - log_likelihood(scores, transitions - moved)) / 2e-5
        observed = sum(((labels[a : b - 1] == x) & (labels[a + 1 : b] == y)).sum() for a, b in zip(first, first[1:]))
        assert abs(slope - (observed - pairs[x, y])) < 1e-6
    for w, k in itertools.product(range(6), range(3)):
        moved = np.zeros((6, 3))
        moved[w, k] = 1e-5
        slope = (log_likelihood(scores + moved, transitions) - log_likelihood(scores - moved, transitions)) / 2e-5
        here = word == w
        assert abs(slope - ((labels[here] == k).sum() - share[here, k].sum())) < 1e-6


def test_features_by_hand():
    words = ["ab", "abc", "x", "ab"]
    found = ll.features(words, {"abc": 2}, 1 << 30)
    per_word = [Counter(found.slots[a:b].tolist()) for a, b in zip(found.first, found.first[1:])]
    # Two-, three- and four-grams with both ends, as many prefixes and suffixes as there are characters up to four, and the constant.
    assert [c.total() for c in per_word] == [3 + 2 + 1 + 2 * 2 + 1, 4 + 3 + 2 + 2 * 3 + 2, 2 + 1 + 0 + 2 + 1, 11]
    assert per_word[0] == per_word[3] and len(per_word[0] & per_word[1]) >= 4
    assert len(ll.features([], {}, 64).slots) == 0


MADE = {"aa": "banana papa mama kala sana tala", "oo": "bonono popo momo kolo sono tolo"}


@pytest.fixture(scope="module")
def learnt(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choice(MADE[lang].split()) for _ in range(30)), lang) for lang in MADE for _ in range(60)]
    rows += [(None, "aa"), ("banana", None), ("", "oo"), ("123", "oo"), (None, None)]
    labelled = spark.createDataFrame([(*r, "c", 1) for r in rows], "text string, lang string, words string, hash int")
    return ll.fit(labelled, ll.Settings(slots=1 << 12, passes=3))


LANG_SCHEMA = "doc_id bigint, text string, words string, score string, lang string"


def test_code_switched_words(spark, learnt):
    text = f"{MADE['aa']} - Popo {MADE['oo']}! 12 {MADE['aa']}"
    docs = spark.createDataFrame([(1, text, "x", "y", "z")], LANG_SCHEMA)
    assert [tuple(r) for r in ll.word_runs(docs, learnt).orderBy("first").collect()] == [(1, "aa", 0, 6), (1, "oo", 6, 7), (1, "aa", 13, 6)]
    (row,) = ll.languages(docs, learnt).collect()
    assert row.lang_pred == "aa" and row.n_words == 19 and row.n_switches == 2 and abs(row.score - 12 / 19) < 0.05


def test_language_edge_cases(spark, learnt):
    docs = [(1, None), (2, ""), (3, "12 345 ... ²"), (4, "MAMA"), (None, "popo"), (None, None), (5, "tolo " * 40_000 + "mama"), (6, "popo" * 25_000), (4, "kolo"), (4, "kolo")]
    rows = ll.languages(spark.createDataFrame([(*d, "x", "y", "z") for d in docs], LANG_SCHEMA).repartition(3), learnt).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert Counter((r.doc_id, r.lang_pred) for r in rows) == Counter(
        {(1, "und"): 1, (2, "und"): 1, (3, "und"): 1, (4, "aa"): 1, (None, "oo"): 1, (None, "und"): 1, (5, "oo"): 1, (6, "oo"): 1, (4, "oo"): 2}
    )
    assert {r.score for r in rows if r.lang_pred == "und"} == {0.0}
    long = next(r for r in rows if r.doc_id == 5)
    assert long.n_words == 40_001 and long.n_switches == 1
    none = spark.createDataFrame([], LANG_SCHEMA)
    assert ll.languages(none, learnt).count() == ll.word_runs(none, learnt).count() == 0


def test_nothing_to_learn_from(spark):
    model = ll.fit(spark.createDataFrame([(None, "aa"), ("12", "aa"), ("mama", None)], "text string, lang string"))
    docs = spark.createDataFrame([(1, "mama popo"), (2, None)], "doc_id bigint, text string")
    assert [tuple(r)[1:3] for r in ll.languages(docs, model).collect()] == [("und", 0.0)] * 2
    assert ll.word_runs(docs, model).count() == 0


def test_the_sample_is_bounded(spark):
    how = ll.Settings(lines=7, line_words=5)
    rows = [(f"{a} " + "mama " * 23, lang) for lang in ("aa", "oo") for a in "bcdefghijkl"]
    found = ll.sample(spark.createDataFrame(rows, "text string, lang string"), how).collect()
    assert Counter(r.lang for r in found) == {"aa": 7, "oo": 7} and max(len(r.words) for r in found) == 5


def test_pieces_are_handed_on_before_a_batch_ends(spark, monkeypatch):
    """All pieces of a batch of documents were held at once."""
    import pyarrow as pa

    import public_tokenizers
    from tomeglass.llm import packing

    monkeypatch.setattr(packing, "HELD_PIECES", 4)
    cuts = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, cut, schema: cuts.append(cut))
    docs = spark.createDataFrame([(0, "x")], "doc_id bigint, text string")
    packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 8, 0)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)) + [None], "text": ["one two three " * 8] * 9 + [None]})
    found = list(cuts[0](iter([batch, batch.slice(0, 0)])))
    assert len(found) > 5 and max(len(b) for b in found) == 4
    whole = pa.Table.from_batches(found)
    assert whole["doc_id"].to_pylist()[-1] is None and sorted({i for i in whole["doc_id"].to_pylist() if i is not None}) == list(range(9))
    assert [len(ids) for ids in whole["ids"].to_pylist()] == whole["length"].to_pylist()

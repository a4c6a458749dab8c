"""Operators on small tables with missing values, empty and long texts, ties, repeated rows and clashing columns."""

import random
import textwrap
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tomeglass.llm import decontaminate, html_blocks, license_rules, line_rules, near_dedup, packing, pii, quality, token_counts, url_filter
from tomeglass.llm import shingles as sh
from tomeglass.llm.components import components

RNG = random.Random(1)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmno") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
PROSE = [" ".join(RNG.choice(VOCABULARY) for _ in range(120)) for _ in range(6)]
LONG = " ".join(RNG.choice(VOCABULARY) for _ in range(60_000))
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LOWER = public_tokenizers.path("word_bpe_49k.json")

# Every operator has to leave these columns alone, whatever it calls its own.
SCHEMA = "doc_id bigint, text string, source string, row string, n string, node string, key string, line string, label string, x string, spans string, token string"
ROWS = [
    (5, PROSE[0], "a"),
    (2, PROSE[0], "a"),
    (2, PROSE[0], "a"),
    (7, PROSE[0] + " more", None),
    (8, "", "a"),
    (9, None, None),
    (None, PROSE[1], "a"),
    (None, None, None),
    (10, " \n\t ", "a"),
    (11, "One", "b"),
    (12, "one", "b"),
    (13, LONG, "b"),
    (14, PROSE[2], "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *"abcdefghi") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in dicts(df) if r["doc_id"] is not None}


def test_near_duplicates(spark, docs, nothing):
    rows = dicts(near_dedup.near_duplicates(docs, near_dedup.Method(shingle=2)))
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in rows}
    assert found[5] == found[7] == (2, False) and found[2] == (2, True)
    assert found[12] == (11, False) and found[11] == (11, True)
    assert found[8] == (8, True) and found[9] == (9, True) and found[10] == (10, True)
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (8, 9, 10)} == {0}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert near_dedup.near_duplicates(nothing).count() == 0


def chain(n, step):
    """Texts each of which is like its neighbours only: they share all but ``step`` of 100 words."""
    words = [f"w{i}" for i in range(100 + step * n)]
    return [" ".join(words[i * step : i * step + 100]) for i in range(n)]


def jaccard(a, b, size):
    cut = lambda t: {tuple(t.split()[i : i + size]) for i in range(len(t.split()) - size + 1)}
    a, b = cut(a), cut(b)
    return len(a & b), len(a | b)


def test_links_of_chains_groups_and_borderline_pairs(spark):
    """Components equal those of all pairs: drifting chains, large groups, and texts around the limit."""
    rng = random.Random(3)
    texts = chain(12, 9) + chain(6, 25)
    base = [f"v{i}" for i in range(150)]
    for share in [0.01] * 40 + [0.04, 0.06, 0.08, 0.1, 0.12, 0.14] * 8:
        texts.append(" ".join(f"u{rng.random()}" if rng.random() < share else w for w in base))
    texts += [texts[3]] * 5
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            inter, union = jaccard(texts[a], texts[b], 2)
            if 100 * inter >= 80 * union:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = by_id(near_dedup.near_duplicates(df, near_dedup.Method(shingle=2)))
    assert [rows[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_memory_of_a_tile_of_near_copies():
    how = near_dedup.Method()
    rng = np.random.default_rng(2)
    sig, fine = rng.integers(0, 1 << 32, how.hashes, np.uint32).tobytes(), rng.integers(0, 256, how.fine, np.uint8).tobytes()
    n = 700
    tile = pa.table(
        {
            "side": np.repeat([0, 1], n),
            "band": np.zeros(2 * n, np.int64),
            "node": pa.array([i.to_bytes(16, "big") for i in range(n)] * 2, pa.binary()),
            "label": pa.array([i.to_bytes(16, "big") for i in range(n)] * 2, pa.binary()),
            "sig": pa.array([sig] * (2 * n), pa.binary()),
            "fine": pa.array([fine] * (2 * n), pa.binary()),
        }
    )
    tracemalloc.start()
    found = set()
    for batch in near_dedup._met(tile, how, None):
        found.update(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n * (n - 1) // 2 and all(a < b for a, b in found)
    # Gathered at once, the last fine values of the pairs of some left nodes alone were 268 MB.
    assert peak < 200e6


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (103, 103), (101, 102), (50, 60), (55, 60)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {r.node: r.label for r in components(df).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 50: 50, 55: 50, 60: 50}
    assert components(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té中1.", max_size=30), max_size=6))
def test_shingles_equal_plain_sets(texts):
    for texts_ in sh.text_slices(pa.array(texts, pa.string())):
        for size in (1, 2, 5):
            found = sh.shingles(sh.words(texts_, sh.plain_words(True)), size)
            for i, t in enumerate(texts):
                words = t.encode().lower().split()
                plain = {tuple(words[j : j + size]) for j in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
                assert len(set(found.hashes[found.first[i] : found.first[i + 1]].tolist())) == len(plain)


def test_minhash_estimates_similarity():
    a = np.random.default_rng(0).integers(0, 1 << 63, 500, np.uint64)
    values = sh.block_minima(np.concatenate([a, a[:400]]), np.array([0, 500]), 2000)
    assert abs((values[0] == values[1]).mean() - 0.8) < 0.03


def test_containment(spark, docs, nothing):
    words = PROSE[2].split()
    half = " ".join(words[20:45]) + " other words here " + " ".join(words[45:70])
    items = [(1, " ".join(words[30:60]).upper()), (2, half), (3, "one"), (4, None), (5, "  "), (6, " ".join(LONG.split()[30_000:30_040])), (7, "never seen at all anywhere"), (None, PROSE[2]), (1, PROSE[1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r["containment"] for r in dicts(decontaminate.contained_items(docs, benchmark))}
    assert {k for k in found if k[1] in (3, 6)} == {(11, 3), (12, 3), (13, 6)}
    assert found[14, 1] == 1 and found[None, 1] == 1 and 0.8 <= found[14, 2] < 1
    assert not {k for k in found if k[1] in (4, 5, 7, None)}
    blocks = decontaminate.contained_items(docs, benchmark, decontaminate.Method(block_items=2))
    assert sorted(map(str, dicts(blocks))) == sorted(map(str, dicts(decontaminate.contained_items(docs, benchmark))))
    assert decontaminate.contained_items(nothing, benchmark).count() == 0
    assert decontaminate.contained_items(docs, benchmark.limit(0)).count() == 0


def test_short_items_inside_long_documents(spark):
    rng = random.Random(3)
    known = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    items = [(i, known(1 + i % 12)) for i in range(600)]
    shuffled = rng.sample(items, len(items))
    texts = [" ".join(f"{known(150)} {t}" for _, t in shuffled[k : k + 50]) for k in range(0, 600, 50)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = dicts(decontaminate.contained_items(documents, spark.createDataFrame(items, "item_id bigint, text string")))
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == sorted((at // 50, i) for at, (i, _) in enumerate(shuffled))
    # Four of five shingles of nine words, the first or the last one changed.
    long = known(9).split()
    near = spark.createDataFrame([(1, " ".join(["x", *long[1:]])), (2, " ".join([*long[:-1], "x"])), (3, " ".join(["x", *long[1:-1], "x"]))], "doc_id bigint, text string")
    assert {r["doc_id"] for r in dicts(decontaminate.contained_items(near, spark.createDataFrame([(1, " ".join(long))], "item_id bigint, text string")))} == {1, 2}


def test_line_rules(spark, docs, nothing):
    rows = dicts(line_rules.clean_lines(docs))
    assert len(rows) == len(ROWS)
    found = by_id(line_rules.clean_lines(docs))
    assert found[9]["n_words"] == found[8]["n_words"] == 0 and found[9]["base_failed"] and not found[9]["kept"]
    assert found[13]["n_words"] == 60_000 and found[13]["word_chars"] == sum(map(len, LONG.split()))
    assert line_rules.clean_lines(nothing).count() == 0


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    banner = "All  our\tbanners say the same thing to everybody who reads them on any page"
    own = [" ".join(RNG.choice(VOCABULARY) for _ in range(70)) for _ in range(40)]
    rows = [(i, f"{own[i]}\n{banner.upper() if i % 2 else banner}", "h") for i in range(40)]
    rows += [(100 + i, "\n".join([banner] * 30 + own[i].split()[: 10 + i]), "h") for i in range(3)]
    rows += [(200 + i, own[0], "h") for i in range(40)]  # copies are no boilerplate
    rows += [(300, f"{own[1]}\n{banner}", None)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, source string")
    found = by_id(line_rules.clean_lines(df, line_rules.Limits(repeated=100)))
    assert all(found[i]["kept"] and len(found[i]["removed"]) == 1 for i in range(40))
    assert not any(found[100 + i]["kept"] or found[100 + i]["base_failed"] for i in range(3))
    assert all(found[200 + i]["kept"] and not found[200 + i]["removed"] for i in range(40)) and not found[300]["removed"]
    judged = line_rules.clean_lines(df.where("doc_id = 1 or doc_id < 40")).select("doc_id", "removed")
    cleaned = df.join(judged, "doc_id").where("doc_id = 1").select(line_rules.without_lines(df.text, judged.removed).alias("t")).first().t
    assert cleaned == own[1]


def test_a_shared_line_that_is_the_longest_of_its_documents(spark):
    notice = " ".join(VOCABULARY[:60])
    rows = [(i, f"{notice}\n{VOCABULARY[i]} {i}", "h") for i in range(40)]
    rows += [(100 + i, f"{notice}\n{PROSE[0]}\nown line {i}", "g") for i in range(40)]
    rows += [(200 + i, f"{PROSE[1]}\ncopied", "c") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = by_id(line_rules.clean_lines(df))
    assert not any(found[i]["kept"] or found[i]["base_failed"] for i in range(40))
    assert all(len(found[100 + i]["removed"]) == 2 for i in range(40))
    assert all(found[200 + i]["kept"] and not found[200 + i]["removed"] for i in range(40))
    # 60 copies are one more document of the host, so 31 of 32 have the notice, not 31 of 91.
    host = spark.createDataFrame([*rows[:31], *[(300 + i, PROSE[2], "h") for i in range(60)]], df.schema)
    assert len(line_rules.frequent_lines(host, line_rules.Limits(share=0.5)).collect()) == 1


def test_personal_data(spark, docs, nothing):
    assert len(dicts(pii.find_pii(docs))) == len(ROWS) and pii.find_pii(nothing).count() == 0
    text = "é call a.b@c.de or (375) 555-4393, account DE89 3704 0044 0532 0130 00 ok, 4111 1111 1111 1111 or 4111 1111 1111 1112, ssn 123-45-6789"
    assert pii.masked(text) == "é call <EMAIL> or <LOCAL_PHONE>, account <IBAN> ok, <CARD> or 4111 1111 1111 1112, ssn <SSN>"
    assert pii.masked("order 123-45-6789, DE88370400440532013000, 375 555-4393") == "order 123-45-6789, DE88370400440532013000, 375 555-4393"
    assert pii.masked("1.2.3.4.5 256.1.1.1 0.0.0.000") == "<IP>.5 256.1.1.1 <IP>"
    assert pii.base_spans("x" * 300_000) == [] and pii.base_spans("9" * 300_000) == [] and pii.base_spans("@" * 300_000) == []
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and sorted(map(str, dicts(masked))) == sorted(map(str, dicts(docs)))


@pytest.mark.parametrize("word", pii.AGAINST)
def test_words_against_a_kind_do_not_outweigh_a_checksum(word):
    assert pii.masked(f"{word} 7: DE89 3704 0044 0532 0130 00") == f"{word} 7: <IBAN>"
    assert pii.masked(f"{word} DE88370400440532013000, 123-45-6789") == f"{word} DE88370400440532013000, 123-45-6789"


def test_spans_agree_with_plain_patterns():
    import re

    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("12.5@a-_+ ()0\n") for _ in range(rng.randint(0, 40)))
        assert list(pii._emails(text)) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]
        assert [m.span() for m in pii._CARD.finditer(text)] == [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]


def test_token_counts(spark, docs, nothing):
    tokenizer = Tokenizer.from_file(LOWER)
    odd = ["a\u00a0B  c<|endoftext|>d 'LL it's 12", "İ Σς ǅ é e\u0301\u0301", "\u2003\x1c\x85x", "中文 字 🙂"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    rows = dicts(token_counts.token_counts(docs.select("doc_id", "text").unionByName(more), LOWER, 50))
    texts = {100 + i: t for i, t in enumerate(odd)} | {i: t or "" for i, t, _ in ROWS if i is not None}
    assert len(rows) == len(ROWS) + len(odd)
    for r in rows:
        if r["doc_id"] is not None:
            n = len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 50)
    assert token_counts.token_counts(nothing, LOWER).count() == 0


def test_rare_tokens_are_joined(spark, docs, monkeypatch):
    whole = sorted(map(str, dicts(token_counts.token_counts(docs, LOWER))))
    monkeypatch.setattr(token_counts, "FREQUENT", 3)
    monkeypatch.setattr(token_counts, "HELD", 10)
    assert sorted(map(str, dicts(token_counts.token_counts(docs, LOWER)))) == whole


def test_encoder_equals_the_library():
    tokenizer, encode = Tokenizer.from_file(BYTES), packing.byte_level_encoder(BYTES)
    rng = random.Random(4)
    letters = list("ab1'.s \n\t") + ["é", "\u00a0", "\u3000", "\x85", "\x1c", "٣", "中", "🙂", "\u0301", "'ll", "<|endoftext|>", "ⅷ", "𝟘"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs, nothing):
    pieces = dicts(packing.pack(docs, BYTES, window=64, group_rows=4))
    encode = packing.byte_level_encoder(BYTES)
    sizes = sorted(len(encode(t or "")) + 1 for _, t, _ in ROWS)
    whole = sorted(p["doc_tokens"] for p in pieces if p["start"] == 0)
    assert whole == sizes and sum(p["length"] for p in pieces) == sum(sizes)
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append(p)
    for some in windows.values():
        some.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in some] == list(np.cumsum([0, *(p["length"] for p in some)])[:-1]) and sum(p["length"] for p in some) <= 64
    made = dicts(packing.sequences(packing.pack(docs, BYTES, window=64, group_rows=4), 64, pad_id=7))
    assert len(made) == len(windows)
    assert all(len(s["ids"]) == 64 or len(s["ids"]) == s["used"] and s["used"] & (s["used"] - 1) == 0 for s in made)
    assert sorted(sum(([*s["ids"][: s["used"]]] for s in made), [])) == sorted(sum((p["ids"] for p in pieces), []))
    assert packing.pack(nothing, BYTES).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_decreasing(lengths):
    lengths = np.array(lengths, np.int64)
    windows, offsets = packing.best_fit(lengths, 40)
    free, placed = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [w for w in range(len(free)) if free[w] >= lengths[i]]
        room = min((free[w] for w in fits), default=None)
        if room is None:
            free.append(40 - lengths[i])
            placed[i] = 40
        else:
            free[next(w for w in fits if free[w] == room)] -= lengths[i]
            placed[i] = room
    assert all(40 - offsets[i] == room for i, room in placed.items())
    assert len(set(windows.tolist())) == len(free)


def test_quality(spark, docs, nothing):
    good = [" ".join(RNG.choice(VOCABULARY) for _ in range(RNG.randint(20, 200))).capitalize() + "." for _ in range(150)]
    rows = [(i, t if i % 3 else " ".join([t.split()[0]] * 80), int(i % 3 > 0)) for i, t in enumerate(good)]
    df = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(1, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    scores = dicts(quality.quality_scores(df, labels))
    assert len(scores) == 151 and all(r["predicted"] == rows[r["doc_id"]][2] for r in scores)
    kept = quality.keep_good(df.withColumn("x", df.doc_id), labels)
    assert kept.columns == ["doc_id", "text", "x"] and {r.doc_id for r in kept.collect()} == {i for i, _, q in rows if q}
    assert len(dicts(quality.quality_scores(docs, labels))) == len(ROWS)
    assert {r["score"] for r in dicts(quality.quality_scores(docs, labels.limit(0)))} == {0.5}
    assert quality.quality_scores(nothing, labels).count() == 0


def test_isotonic_levels():
    x, y, n = np.arange(6.0), np.array([0.0, 0.4, 0.2, 0.2, 0.9, 0.8]), np.ones(6)
    centres, levels = quality.pool_adjacent(x, y, n)
    assert list(np.diff(levels) > 0) == [True] * (len(levels) - 1) and levels[0] == 0 and levels[-1] == pytest.approx(0.85)


def test_licenses(spark, docs, nothing):
    texts = [
        "Prose.\nLicensed under CC BY-NC 4.0.\nMore",
        "Released under the MIT License. All rights reserved.",
        "all  RIGHTS reserved",
        "It is not licensed under the Apache License, Version 2.0, they say.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = by_id(license_rules.find_licenses(df))
    assert [found[i]["licenses"] for i in range(5)] == [["CC-BY-NC-4.0"], ["MIT", "All-Rights-Reserved"], ["All-Rights-Reserved"], [], ["BSD-2-Clause"]]
    assert len(dicts(license_rules.find_licenses(docs))) == len(ROWS) and license_rules.find_licenses(nothing).count() == 0


OFFICIAL = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


def test_licence_texts_as_they_are_written(spark):
    texts, expected = [], []
    for name, paragraphs in OFFICIAL.items():
        for prefix in ("", " * ", "# "):
            texts += ["\n".join(prefix + line for p in paragraphs for line in [*textwrap.wrap(p, 72), ""]), f"{prefix}Intro.\r\n" + "\r\n\r\n".join(paragraphs)]
            expected += [[name]] * 2
    for text, name in (("# SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: Apache-2.0\nx", "Apache-2.0"), ("a\nLicense: MIT\nb", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0")):
        texts.append(text)
        expected.append([name])
    texts += ["License:\n\nMIT", "No license: MIT", "all rights\n \nreserved", ". " * 50_000 + "all rights reserved", None]
    expected += [[], [], [], ["All-Rights-Reserved"], []]
    found = by_id(license_rules.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    assert [found[i]["licenses"] for i in range(len(texts))] == expected


def test_every_known_sentence_is_found_wrapped_or_not(spark):
    forms = list(license_rules.IDENTIFIER.items())
    rows = [(2 * i + j, form if j else "\n".join(textwrap.wrap(form, 30))) for i, (form, _) in enumerate(forms) for j in range(2)]
    found = by_id(license_rules.find_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert all(found[2 * i + j]["sentence_ids"] == [name] for i, (_, name) in enumerate(forms) for j in range(2))


RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def test_urls(spark):
    urls = [
        (1, "http://WWW.Example.NET/en/1?q=/x"), (2, "https://example.net"), (3, "https://example.net/"), (4, "x://a.net?b"), (5, None), (6, "no url"),
        (7, "ftp://net/fr"), (8, "http://badexample.com/de/1"), (9, "http://a.example.com/de/1#x"), (None, "http://org/fr/ü"), (9, "http://a.example.com/de/1#x"),
    ]
    df = spark.createDataFrame(urls, "page_id bigint, url string").selectExpr("*", "'x' AS template", "'y' AS segment", "'z' AS names")
    known = spark.createDataFrame([], "page_id bigint, bad int")
    rows = dicts(url_filter.judge_urls(df, known, RULES))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(urls)
    assert found[1] == ("www.example.net", "/en/1", "example.net/en/", "allow") and found[2] == ("example.net", "", None, "allow")
    assert found[3] == ("example.net", "/", "net/", "block") and found[4] == ("a.net", "", None, "allow") and found[7] == ("net", "/fr", "net/", "block")
    assert found[5] == found[6] == ("", "", None, "allow") and found[8][2:] == (None, "allow") and found[9][2:] == ("example.com/de/", "block")
    assert found[None] == ("org", "/fr/ü", "org/fr/", "allow")
    assert url_filter.judge_urls(df.limit(0), known, RULES).count() == 0


def test_templates_follow_the_labels(spark):
    rows, labels = [], []
    for i in range(400):
        part = ("good", "fine", "spam")[i % 3]
        rows.append((i, f"http://h.example/{part}/{i}/page.html"))
        if i % 2:
            labels.append((i, int(part == "spam")))
    rows += [(1000, "http://h.example/spam/" + "/".join(map(str, range(40)))), (1001, "http://h.example/other/1/page.html")]
    df, known = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad int")
    found = {r["page_id"]: r for r in dicts(url_filter.judge_urls(df, known))}
    assert {found[i]["template"] for i in range(400)} == {"/good/*/page.html", "/fine/*/page.html", "/spam/*/page.html"}
    assert all((found[i]["verdict"] == "block") == (i % 3 == 2) for i in range(400)) and found[1001]["template"] == "/*/*/*.html"
    equal = known.selectExpr("page_id", "cast(page_id % 5 = 0 as int) bad")
    merged = dicts(url_filter.judge_urls(df, equal))
    assert {r["template"] for r in merged if r["page_id"] < 400} == {"/+/*/page.html"}


def test_templates_of_deep_paths_and_a_hot_host(spark, monkeypatch):
    """Nine tenths of all rows on one host, names below many wildcards, one very long URL, and tied rules."""
    deep = "/".join(["a", "{0}", "c", "{0}", "e", "f", "{0}", "{1}", "x.html"])
    rows = [(i, "https://hot.example/" + deep.format(i, "good" if i % 2 else "spam")) for i in range(360)]
    rows += [(1000 + i, f"http://h{i}.example/p{i}") for i in range(40)] + [(2000, "http://long.example/" + "s/" * 300 + "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    known = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(0, 360, 3)] + [(1000 + i, 0) for i in range(40)], "page_id bigint, bad int")
    rules = [("example/p1", "block"), ("h1.example/", "allow")]
    for limit in (url_filter.BROADCAST_BYTES, -1):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
        found = {r["page_id"]: r for r in dicts(url_filter.judge_urls(df, known, rules))}
        assert len(found) == len(rows)
        assert {found[i]["template"] for i in range(360)} == {"/a/*/c/*/e/f/*/good/x.html", "/a/*/c/*/e/f/*/spam/x.html"}
        assert all((found[i]["verdict"] == "block") == (i % 2 == 0) for i in range(360))
        assert found[2000]["template"] == "/*" * 301 and found[2000]["verdict"] == "allow"
        assert found[1010]["rule"] == "example/p1" and found[1001]["rule"] == "h1.example/"


def test_secrets_are_random_and_assigned():
    found = lambda text: [(pii.KINDS[k], text[s:e]) for s, k, e, _ in pii.more_spans(text, pii.base_spans(text), pii.Scores())]
    hexes, mixed = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "AKfj83kd0Lm2/xY7+qWe9rTz=="
    assert found(f'token = "{hexes}"') == [("secret", hexes)] == found(f"API_KEY: {hexes}") == found(f"Authorization: Bearer {hexes}")
    assert found(f"password={mixed}!") == [("secret", mixed)]
    # Without a word or a sign before it, of few characters, of letters only, or repeating itself, a run is no secret.
    for text in (f"see {hexes}", f"token {hexes} x", f"build = {hexes}", "token = abc123", "token = abcdefghijklmnopqrstuvwx", "key = " + "ab1" * 20, "key = 1234567890123456789012"):
        assert found(text) == [], text
    assert pii.masked(f'a token = "{hexes}" b') == 'a token = "<SECRET>" b'
    # A card number may stand within it; the whole goes.
    within = "0f4539578763621486aa9c3e7b"
    assert pii.masked(f"secret: {within}.") == "secret: <SECRET>."
    assert [kind for kind, _ in found(f"secret: {within}.")] == ["secret"]


def test_blocks_of_broken_pages():
    cut = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert cut("<p>a &amp; b&nbsp;c<br>d<p>e<script>var t='</p>';</script>f<!-- x --><div>g") == ["a & b c d", "e", "f", "g"] or cut(
        "<p>a &amp; b&nbsp;c<br>d<p>e<script>var t='</p>';</script>f<!-- x --><div>g"
    ) == ["a & b c d", "ef", "g"]
    assert cut("") == [] and cut("plain") == ["plain"] and cut("a < b") == ["a < b"] and cut("x</div>y<div cl") == ["x", "y"]
    assert cut("<title>t</title><style>p{}") == [] and cut("<p title='a>b'>c</p>") == ["c"]


def test_head_without_an_end():
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert texts("<html><head><title>t</title><body><article><p>one</article>") == ["one"]
    assert texts("<head><meta charset=x><script>var a</script><div>two<p>three") == ["two", "three"]
    assert texts("<html><head><title>t</title><noscript>n</noscript><link rel=x>stray</head><body><p>four") == ["four"]
    assert html_blocks.blocks("<html><head><title>t</title><body><p>x")[0].path == ("html", "body", "p")


def test_every_word_digit_and_name_counts():
    block = lambda text, names: html_blocks.vectors(html_blocks.measured([html_blocks.Block(text, ("div", "p"), (names, ()), 0)]))[0]
    plain = block("word " * 400 + "end", ("x",) * 20)
    assert (block("word " * 400 + "© reply", ("x",) * 20)[html_blocks.PATH_WIDTH : html_blocks.PATH_WIDTH + html_blocks.WORD_WIDTH] != plain[html_blocks.PATH_WIDTH : html_blocks.PATH_WIDTH + html_blocks.WORD_WIDTH]).any()
    assert (block("word " * 400 + "end", ("comments",) + ("x",) * 20) != plain).any()
    assert block("word " * 400 + "123456", ("x",) * 20)[-5] > 0 == plain[-5]


def test_outer_names_decide_below_many_classes():
    utility = " ".join(html_blocks.UTILITY[:16])
    prose = html_blocks.Author(77).prose
    inside = lambda low, high: "".join(f'<div class="{utility}"><p>{prose(low, high)}</p></div>' for _ in range(3))
    for name in ("sidebar", "cookie notice", "comments"):
        pages = [f'<body><article><h1>{prose(3, 9)}</h1>{inside(20, 60)}</article><div class="{name}">{inside(10, 30)}</div></body>' for _ in range(20)]
        found = html_blocks.labels(html_blocks.train(), [html_blocks.blocks(p) for p in pages])
        assert np.mean([f == ([True] * 4 + [False] * 3) for f in found]) > 0.95


def test_main_text(spark):
    article = "".join(f"<p>{' '.join(VOCABULARY[i : i + 40]).capitalize()}.</p>" for i in range(0, 200, 40))
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>More</a></li></ul></nav><article><h1>One title</h1>{article}</article><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", page.replace("<article>", "<article>" + article * 200)), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "1 AS blocks")
    found = dicts(html_blocks.main_text(df))
    texts = {r["page_id"]: r["text"] for r in found}
    assert len(found) == 5 and texts[2] == texts[None] == "" and texts[1].startswith("One title\n") and "Home" not in texts[1] and "©" not in texts[1]
    assert texts[1].count("\n") == 5 and texts[3].count("\n") > 990
    assert html_blocks.main_text(df.limit(0)).count() == 0


def test_labeller_on_pages_it_has_not_seen():
    model, author = html_blocks.train(), html_blocks.Author(1234)
    made = [p for p in (author.page() for _ in range(150)) if p[0]]
    guessed = html_blocks.labels(model, [found for found, _ in made])
    assert np.mean(np.concatenate(guessed) == np.concatenate([y for _, y in made])) > 0.99


def changed(change):
    """The given pages with one change each; the article's own blocks are their main text."""
    pages = ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table(columns=["html"]).column("html").to_pylist()
    wanted = [[b.text for b in html_blocks.blocks(p) if "article" in b.path] for p in pages]
    return [html_blocks.blocks(change(p)) for p in pages], wanted


LOOKS = '<article class="css-1ab z9k w-full"><p class="sc-foo lead-9">'
AUTHOR = html_blocks.Author(99)
CHANGES = {
    "none": lambda p: p,
    "look-only classes": lambda p: p.replace("<article>", LOOKS[:-len('<p class="sc-foo lead-9">')]).replace("<p>", '<p class="sc-foo lead-9">'),
    "div with a plain id": lambda p: p.replace("<article>", '<div id="text">').replace("</article>", "</div>"),
    "plain div": lambda p: p.replace("<article>", "<div>").replace("</article>", "</div>"),
    "telling body": lambda p: p.replace("<body>", '<body class="home page-template-default single-post">'),
    "more of a telling body": lambda p: p.replace("<body>", '<body class="blog has-sidebar comments-open archive logged-in">'),
    "telling wrapper": lambda p: p.replace("<body>", '<body><div class="page has-sidebar">').replace("</body>", "</div></body>"),
    "side bar inside": lambda p: p.replace("</article>", f'<aside class="related"><p>{AUTHOR.prose(5, 20)}</p></aside></article>'),
    "side bar in the middle": lambda p: p.replace("</h1>", f'</h1><div class="relatedPosts"><ul><li><a href="/x">{AUTHOR.prose(3, 9)}</a></li></ul></div>', 1),
    "thread of replies": lambda p: p.replace("</article>", f'</article><div id="disqus_thread"><div class="reply">{AUTHOR.prose(5, 30)}</div><div class="reply"><p>{AUTHOR.prose(5, 30)}</p></div></div>'),
    "comments inside": lambda p: p.replace("</article>", f'<section id="comments"><div class="comment-body"><p>{AUTHOR.prose(5, 30)}</p></div></section></article>'),
    "form inside": lambda p: p.replace("</article>", f"<form><label>{AUTHOR.prose(1, 4)}</label><p>{AUTHOR.prose(2, 12)}</p></form></article>"),
    "wrapped": lambda p: p.replace("<article>", '<div class="content-area"><main id="main"><div class="wp-block x1"><article>').replace("</article>", "</article></div></main></div>"),
    "notice before": lambda p: p.replace("<article>", f'<div id="CookieConsent" role="dialog"><p>{AUTHOR.prose(5, 30)}</p></div><article>'),
}


@pytest.mark.parametrize("change", CHANGES)
def test_main_text_of_changed_pages(change):
    found, wanted = changed(CHANGES[change])
    main = html_blocks.labels(html_blocks.train(), found)
    got = [[b.text for b, m in zip(f, ms) if m] for f, ms in zip(found, main)]
    assert np.mean([g == w for g, w in zip(got, wanted)]) >= 0.98


def test_a_page_looked_at_in_parts():
    found = [html_blocks.blocks("<div>" + "".join(f"<p>{html_blocks.Author(i).prose(1, 9)}</p><nav>x</nav>" for i in range(n)) + "</div>") for n in (1, 7, 60)]
    model = html_blocks.train()
    pages = [html_blocks.measured(f) for f in found]
    whole = model.page_chances(pages, 1000)
    for at_once in (1, 17, 120):
        parts = model.page_chances(pages, at_once)
        for i, f in enumerate(found):
            assert np.allclose(parts[: len(f), i], whole[: len(f), i], atol=1e-5)


def test_gradients_of_the_labeller():
    how = html_blocks.Settings(cells=3)
    model = html_blocks.Labeller(how)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(4, 2, html_blocks.WIDTH)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = rng.integers(0, 2, (4, 2))

    def loss():
        p = model.chances(x, mask)
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    grads = model.step(x, mask, y)
    for k in model.w:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        kept, step = model.w[k][at], 1e-3
        model.w[k][at] = kept + step
        up = loss()
        model.w[k][at] = kept - step
        down = loss()
        model.w[k][at] = kept
        assert (up - down) / (2 * step) == pytest.approx(grads[k][at], rel=0.02, abs=1e-5)

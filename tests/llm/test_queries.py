"""Every registered text-preparation query against its SQL, or against plain Python where SQL cannot state it."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import TINY
from tests.test_queries import TABLES, table
from tomeglass.llm import near_dedup
from tomeglass.llm.oracles import LLM_ORACLES
from tomeglass.llm.queries import LLM_QUERIES

WITHOUT_SQL = {"op3_fourier_quality", "op5_checked_spans", "op6_block_labels", "op7_piece_counts", "op8_best_fit", "op11_word_languages"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{TINY}/{name}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}


def result(spark, name):
    return entry.queries()[name](spark, TINY)


def test_every_query_has_sql_or_a_reason():
    assert set(LLM_QUERIES) - set(LLM_ORACLES) == WITHOUT_SQL
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", name)[0] for name in LLM_QUERIES}
    assert {"pipeline", *LLM_QUERIES} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = result(spark, name)
    relation = duck.execute(LLM_ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in relation.description], relation.fetchall())


def test_quality_on_documents_held_out(spark, duck):
    rows = {r.doc_id: r for r in result(spark, "op3_fourier_quality").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [(rows[i].predicted, q) for i, q in duck.execute("SELECT doc_id, quality FROM labels").fetchall() if rows[i].held_out]
    assert len(rows) == 200 and np.mean([p == q for p, q in held]) > 0.9


def test_spans_of_the_base_kinds(spark, texts):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def valid(kind, found):
        digits = re.sub(r"[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    for r in result(spark, "op5_checked_spans").collect():
        spans = sorted(
            (m.start(), k, m.end()) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, texts[r.doc_id]) if valid(kind, m[0])
        )
        listed = [f"{list(patterns)[k]}:{s}:{e}" for s, k, e in spans]
        counts = Counter(k for _, k, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(","))


def test_main_text_of_the_given_pages(spark, duck):
    pages = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    right = 0
    for r in result(spark, "op6_block_labels").collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>)", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        right += r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)
    assert right >= 0.98 * len(pages)


def test_token_counts_equal_the_library(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in result(spark, "op7_piece_counts").collect():
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def packed_right(pieces, ids):
    cover, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        cover[p.doc_id].append((p.start, p.length))
        windows[p.sequence_id].append((p.offset, p.length))
    for parts in [*cover.values(), *windows.values()]:
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
    assert all(sum(n for _, n in cover[i]) == len(own) for i, own in ids.items())
    assert all(sum(n for _, n in w) <= 1024 for w in windows.values())
    return sum(map(len, ids.values())) / (1024 * len(windows))


def token_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}


def test_packing_holds_every_id_once(spark, texts):
    assert packed_right(result(spark, "op8_best_fit").collect(), token_ids(texts)) > 0.97


def test_pipeline_stage_by_stage(spark, duck, texts):
    """Each stage against plain Python over what the stage before it kept."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TINY)
        kept[name] = docs = spark.createDataFrame(docs.toPandas(), docs.schema) if name != "packing" else docs
        assert name == "packing" or docs.columns == names
    ids = {name: {r.doc_id for r in kept[name].select("doc_id").collect()} for name in kept}
    good = {i for i, q in duck.execute("SELECT doc_id, quality FROM labels").fetchall() if q}
    assert len(good & ids["quality"]) > 0.95 * len(good)

    def runs(text, size, words):
        found = words(text)
        return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} or ({tuple(found)} if found else set())

    plain = {i: runs(texts[i], 5, lambda t: t.encode().lower().split()) for i in sorted(ids["quality"])}
    root = {i: i for i in plain}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in plain:
        for b in plain:
            both = len(plain[a] & plain[b])
            if a < b and both and 100 * both >= 80 * len(plain[a] | plain[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert ids["near_duplicates"] == {i for i in plain if find(i) == i}

    letters = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    items = [runs(t, 5, letters) for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
    leaked = {i for i in ids["near_duplicates"] for item in items if 100 * len(item & runs(texts[i], 5, letters)) >= 80 * len(item)}
    assert leaked and ids["decontamination"] == ids["near_duplicates"] - leaked
    masked = {r.doc_id: r for r in kept["pii"].collect()}
    assert set(masked) == ids["decontamination"]
    for r in masked.values():
        assert r.n_chars == len(r.text) and not re.search(r"[a-z0-9]@mail|\+1 \(", r.text)
        assert "<" in r.text or r.text == texts[r.doc_id]
    assert packed_right(kept["packing"].collect(), token_ids({i: r.text for i, r in masked.items()})) > 0.9


def test_languages_of_documents_held_out(spark, duck):
    rows = {r.doc_id: r for r in result(spark, "op11_word_languages").collect()}
    given = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert rows.keys() == given.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    assert np.mean([rows[i].lang_pred == lang for i, lang in given.items() if rows[i].held_out]) > 0.97


SECRET = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def test_pipeline_judges_rows_not_ids(spark):
    """Rows that share or lack a doc_id, repeated rows, missing texts, and columns that are called like those of the stages."""
    prose = [" ".join(f"w{(7 * i * (k + 1)) % 1009}" for i in range(60)) for k in range(4)]
    rows = [(1, prose[0]), (1, prose[0]), (2, prose[0]), (2, prose[1]), (None, prose[1]), (None, prose[2]), (None, prose[2]), (3, None), (3, ""), (4, f'x token = "{SECRET}" y')]
    docs = spark.createDataFrame([(*r, "en", "s", 5, "r", "c") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars int, row string, component_id string")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["near_duplicates"](spark, docs, TINY)
    assert kept.columns == docs.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert found == Counter({(1, prose[0]): 1, (2, prose[1]): 1, (None, prose[2]): 1, (3, None): 1, (3, ""): 1, rows[-1]: 1})
    item = spark.read.parquet(f"{TINY}/benchmark.parquet").first().text
    dirty = docs.limit(0).unionByName(spark.createDataFrame([(i, t, "en", "s", 5, "r", "c") for i, t in ((1, "a " + item), (1, prose[0]), (None, item), (None, None))], docs.schema))
    clean = stage["decontamination"](spark, dirty, TINY)
    assert clean.columns == docs.columns and Counter((r.doc_id, r.text) for r in clean.collect()) == Counter([(1, prose[0]), (None, None)])
    masked = {r.text: r.n_chars for r in stage["pii"](spark, docs, TINY).collect()}
    assert masked['x token = "<SECRET>" y'] == 22 and masked[None] == 5 and not any(SECRET in (t or "") for t in masked)
    assert "n_chars" not in stage["pii"](spark, docs.drop("n_chars"), TINY).columns
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, docs.limit(0), TINY).count() == 0, name
        assert run(spark, docs, TINY).count() > 0, name


def test_no_secret_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '[0-9a-f]{40}'")
    assert docs.count() > 5
    left = dict(corpus_pipeline.STAGES)["pii"](spark, docs, TINY).where("text rlike '[0-9a-f]{40}'")
    assert left.count() == 0


def test_bands_hold_a_true_link():
    how = near_dedup.Method()
    assert (1 - 0.8**how.band) ** how.bands < 5e-6
    assert [n for n, _ in how.first_steps()] == [32, 64, 96, 128, 160]
    assert all(m < 0.8 * n for n, m in how.first_steps() + how.fine_steps())

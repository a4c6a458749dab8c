"""SQL that states each registered query on the given tables, for a second engine to check."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from tomeglass.functions.text import TOKEN_PATTERN
from tomeglass.operators.matching import All, Condition, Leaf, Not, Pattern, Prefix, Similar
from tomeglass.plans.conditions import NESTED, PHRASES, WORD_FORMS

_RX = TOKEN_PATTERN.replace("'", "''")


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{_RX}')"


def _model(name: str, sharpness: int) -> str:
    return f"""
{name}_raw AS (
  SELECT c.label AS topic_id, v.doc_id,
         exp(-{sharpness} * pow(list_distance(v.embedding, c.centre), 2)) AS share
  FROM vec v CROSS JOIN centre c),
{name} AS (
  SELECT topic_id, doc_id, round(share / sum(share) OVER (PARTITION BY doc_id), 6) AS weight FROM {name}_raw)"""


_CTE = {
    "meta": r"""
meta AS (
  SELECT doc_id, text, title, substring(text, length(title) + 2) AS abstract,
         'https://corpus.example.org/' || doc_id AS uri, year_raw,
         TRY_CAST(split_part(year_raw, '.', 1) AS INT) AS year, source AS university
  FROM (SELECT *, split_part(text, chr(10), 1) AS title,
               CASE WHEN doc_id % 17 = 0 THEN 'None' ELSE (1995 + doc_id % 23) || '.0' END AS year_raw
        FROM documents))""",
    "vec": """
vec AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS BIGINT) AS label
        FROM embeddings)""",
    "centre": """
centre AS (
  SELECT label, list(mean ORDER BY pos) AS centre
  FROM (SELECT label, pos, round(avg(value), 6) AS mean
        FROM (SELECT label, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS pos FROM vec)
        GROUP BY label, pos)
  GROUP BY label)""",
    "td": _model("td", 32),
    "td16": _model("td16", 16),
    "fields": """
fields AS (SELECT 'title' AS field, doc_id, title AS content FROM meta
           UNION ALL SELECT 'abstract' AS field, doc_id, abstract AS content FROM meta)""",
    "textfield": "\nfields AS (SELECT 'text' AS field, doc_id, text AS content FROM meta)",
    "lens": f"\nlens AS (SELECT field, doc_id, len({_tokens('content')}) AS dl FROM fields)",
    "tok": f"\ntok AS (SELECT field, doc_id, unnest({_tokens('content')}) AS term FROM fields)",
    "post": """
post AS (SELECT field, term, doc_id, count(*) AS tf FROM tok GROUP BY ALL)""",
    "stats": """
stats AS (SELECT field, count(*) FILTER (WHERE dl > 0) AS n_docs, count(*) AS n_all,
                 avg(dl) FILTER (WHERE dl > 0) AS avg_dl
          FROM lens GROUP BY field),
dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL)""",
    "tw": """
used AS (
  SELECT coalesce(e.label, CAST(right(m.university, 1) AS BIGINT)) AS topic_id, p.term, sum(p.tf) AS n
  FROM post p JOIN meta m USING (doc_id) LEFT JOIN vec e USING (doc_id) GROUP BY ALL),
tw AS (SELECT topic_id, term, round(n / sum(n) OVER (PARTITION BY topic_id), 9) AS weight FROM used)""",
    "topics": """
topics AS (
  SELECT topic_id, list(term ORDER BY weight DESC, term) AS words
  FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS r FROM tw)
  WHERE r <= 10 GROUP BY topic_id)""",
    "sizes": "\nsizes AS (SELECT topic_id, count(*) FILTER (WHERE weight > 0.3) AS n_docs FROM td GROUP BY topic_id)",
    "requests": """
requests AS (SELECT DISTINCT topic_id || '/' || university AS request_id, topic_id, university
             FROM td JOIN meta USING (doc_id))""",
    "faceted": """
faceted AS (
  SELECT r.request_id, m.doc_id, CASE WHEN trim(m.title) = '' THEN 'No Title' ELSE m.title END AS title,
         m.abstract, m.year
  FROM requests r JOIN td USING (topic_id) JOIN meta m ON m.doc_id = td.doc_id
  WHERE td.weight > 0.05 AND m.year BETWEEN 1998 AND 2012 AND trim(m.university) = trim(r.university))""",
    "passages": "\nqueries AS (SELECT item_id AS query_id, text FROM benchmark)",
    "literal": "\nqueries AS (SELECT CAST(0 AS BIGINT) AS query_id, 'the the que heit' AS text)",
    "empty": "\nqueries AS (SELECT CAST(0 AS BIGINT) AS query_id, '  ' AS text)",
    "qterms": f"""
qterms AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({_tokens("coalesce(nullif(trim(text), ''), 'the nation')")}) AS term FROM queries)
  GROUP BY ALL)""",
    "neighbours": """
pairs AS (
  SELECT q.doc_id AS query_id, v.doc_id, round(pow(list_distance(q.embedding, v.embedding), 2), 6) AS d2
  FROM vec q JOIN vec v ON q.doc_id <> v.doc_id)""",
}

_CTE["hashed"] = f"""
hashed AS (
  SELECT doc_id, pos, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS value
  FROM (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 768 AS pos, count(*) AS n
        FROM (SELECT doc_id, unnest({_tokens("text")}) AS term FROM documents) GROUP BY ALL))"""

_BM25 = "q.qtf * ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * p.tf / (p.tf + {k1} * (1 - {b} + {b} * l.dl / s.avg_dl))"
_TF_IDF = "p.tf * (ln(s.n_all / (d.df + 1)) + 1)"


def _with(names: str, select: str) -> str:
    return "WITH" + ",".join(_CTE[name] for name in names.split()) + "\n" + select


def _hits(score: str, fields: str = "('title')", last: int = 10, first: int = 1) -> str:
    return f"""
scored AS (
  SELECT q.query_id, p.doc_id, round(sum({score}), 6) AS score
  FROM qterms q JOIN post p USING (term) JOIN dfs d ON d.field = p.field AND d.term = p.term
  JOIN stats s ON s.field = p.field JOIN lens l ON l.field = p.field AND l.doc_id = p.doc_id
  WHERE p.field IN {fields} GROUP BY q.query_id, p.doc_id),
hits AS (
  SELECT query_id, CAST(r AS INT) AS rank, doc_id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM scored)
  WHERE r BETWEEN {first} AND {last})"""


def _search(queries: str, score: str, fields: str = "('title')", text: str = "fields", **ranks: int) -> str:
    parts = f"meta {text} lens tok post stats {queries} qterms"
    return "WITH" + ",".join(_CTE[name] for name in parts.split()) + "," + _hits(score, fields, **ranks)


_MODE = _BM25.format(k1=1.0, b=0.65)
_USUAL = _BM25.format(k1=1.2, b=0.75)
_BOTH = "('title', 'abstract')"
_SHOW = "\nSELECT query_id, rank, doc_id, score FROM hits"
_NO_TITLE = "CASE WHEN title IS NULL OR trim(title) = '' THEN 'No Title' ELSE title END AS title"
_ONE_LINE = "regexp_replace({0}, '[\\r\\n\\t]', ' ', 'g')"


def _ranked(source: str, by: str, order: str, k: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"


_TW = "meta vec fields tok post tw"


_WEIGHT = "ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * p.tf / (p.tf + 1.0 * (1 - 0.65 + 0.65 * l.dl / s.avg_dl))"
# The second engine counts edits in bytes. The words asked for are ASCII, so any other character may stand as one sign.
_EDITS = "levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g'), '{0}')"
_FORM = {"Prefix": "term LIKE '{0}%'", "Pattern": "term LIKE '{0}'", "Similar": _EDITS + " <= {1}"}


def _leaves(condition: Condition, boost: float = 1.0) -> list[tuple[Leaf, float]]:
    if isinstance(condition, Leaf):
        return [(condition, boost * condition.boost)]
    return [leaf for part in condition.parts for leaf in _leaves(part, boost * condition.boost)]


def _form(leaf: Leaf) -> str:
    text = leaf.text.lower().replace("*", "%").replace("?", "_")
    return _FORM[type(leaf).__name__].format(text, getattr(leaf, "edits", 0))


def _leaf(leaf: Leaf, boost: float) -> str:
    """(doc_id, score) of one leaf of a nested condition."""
    fields = f"p.field = '{leaf.field}'" if leaf.field else f"p.field IN {_BOTH}"
    joins = "JOIN dfs d USING (field, term) JOIN stats s USING (field) JOIN lens l USING (field, doc_id)"
    words = leaf.text.lower().split()
    if isinstance(leaf, (Prefix, Pattern)):
        return f"SELECT doc_id, count(DISTINCT field) * {boost} AS score FROM post p WHERE {_form(leaf)} AND {fields} GROUP BY doc_id"
    if isinstance(leaf, Similar):
        less = f"(1 - {_EDITS.format(words[0])} / least(length(term), {len(words[0])}))"
        return f"SELECT doc_id, sum({boost} * {less} * {_WEIGHT}) AS score FROM post p {joins} WHERE {_form(leaf)} AND {less} > 0 AND {fields} GROUP BY doc_id"
    if len(words) == 1:
        return f"SELECT doc_id, sum({boost} * {_WEIGHT}) AS score FROM post p {joins} WHERE term = '{words[0]}' AND {fields} GROUP BY doc_id"
    begins = [f"(SELECT field, doc_id, place - {i} AS b FROM placed WHERE term = '{w}')" for i, w in enumerate(words)]
    near = " ".join(f"SEMI JOIN {x} w{i} ON w{i}.field = m.field AND w{i}.doc_id = m.doc_id AND w{i}.b BETWEEN m.b AND m.b + {getattr(leaf, 'slop', 0)}" for i, x in enumerate(begins))
    listed = ", ".join(f"('{w}')" for w in words)
    return f"""SELECT p.doc_id, sum({boost} * {_WEIGHT}) AS score FROM
        (SELECT m.field, m.doc_id, count(DISTINCT m.b) AS tf FROM ({" UNION ".join(f"FROM {x}" for x in begins)}) m {near} GROUP BY ALL) p
        CROSS JOIN (VALUES {listed}) w(term) JOIN dfs d ON d.field = p.field AND d.term = w.term
        JOIN stats s ON s.field = p.field JOIN lens l ON l.field = p.field AND l.doc_id = p.doc_id WHERE {fields} GROUP BY p.doc_id"""


def _judged(condition: Condition, numbers: Iterator[int]) -> tuple[str, str]:
    """Whether a document with the leaf scores s0, s1, ... is a hit, and what it scores."""
    if isinstance(condition, Leaf):
        i = next(numbers)
        return f"s{i} IS NOT NULL", f"coalesce(s{i}, 0)"
    parts = [_judged(part, numbers) for part in condition.parts]
    hit = (" AND " if isinstance(condition, All) else " OR ").join(f"({h})" for h, _ in parts)
    if isinstance(condition, Not):
        return f"NOT ({hit})", "0"
    return hit, f"CASE WHEN {hit} THEN {' + '.join(s for _, s in parts)} ELSE 0 END"


def _nested(queries: Mapping[int, Condition]) -> str:
    parts = [f"placed AS (SELECT field, doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS place FROM (SELECT field, doc_id, {_tokens('content')} AS t FROM fields))"]
    for q, condition in queries.items():
        leaves = _leaves(condition)
        every = " UNION ALL ".join(f"SELECT doc_id, {i} AS leaf, score FROM ({_leaf(*leaf)})" for i, leaf in enumerate(leaves))
        columns = ", ".join(f"max(score) FILTER (leaf = {i}) AS s{i}" for i in range(len(leaves)))
        hit, score = _judged(condition, iter(range(len(leaves))))
        parts.append(f"q{q} AS (SELECT CAST({q} AS BIGINT) AS query_id, doc_id, round({score}, 6) AS score FROM (SELECT doc_id, {columns} FROM ({every}) GROUP BY doc_id) WHERE {hit})")
    parts.append("kept AS (" + " UNION ALL ".join(f"FROM q{q}" for q in queries) + ")")
    ranked = _ranked("kept", "query_id", "score DESC, doc_id", 10)
    return _with("meta fields lens tok post stats", "," + ",\n".join(parts) + f"\nSELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM {ranked}")


def _expansion(queries: Mapping[int, Condition]) -> str:
    each = [
        f"SELECT CAST({q} AS BIGINT) AS query_id, CAST({i} AS BIGINT) AS leaf, field, term, df FROM dfs WHERE {_form(leaf)} AND field IN "
        + (f"('{leaf.field}')" if leaf.field else _BOTH)
        + (f" AND {_EDITS.format(leaf.text)} < least(length(term), {len(leaf.text)})" if isinstance(leaf, Similar) else "")
        for q, condition in queries.items()
        for i, (leaf, _) in enumerate(_leaves(condition))
    ]
    return _with("meta fields lens tok post stats", "\n" + "\nUNION ALL ".join(each))


# Label centres that a query of the search within given cells visits.
GIVEN_PROBE = 9


ORACLES: dict[str, str] = {
    "corpus_line_aligned": _with(
        "meta",
        f"""SELECT doc_id, {_NO_TITLE}, {_ONE_LINE.format("abstract")} AS abstract, uri, year_raw, CAST(year AS DOUBLE) AS year, university
FROM meta""",
    ),
    "corpus_wide_tsv": _with(
        "meta vec",
        f"""SELECT doc_id, CASE WHEN pos <= 0 THEN title ELSE '' END AS title, CASE WHEN pos <= 0 THEN abstract ELSE '' END AS abstract,
       dim, CAST(pos AS INT) AS pos, value
FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, {_ONE_LINE.format("title")} AS title,
             {_ONE_LINE.format("abstract")} AS abstract, CAST(coalesce(len(embedding), 0) AS INT) AS dim,
             unnest(CASE WHEN len(embedding) > 0 THEN list_transform(embedding, lambda x: round(x, 6)) ELSE [0.0::DOUBLE] END) AS value,
             unnest(CASE WHEN len(embedding) > 0 THEN range(0, len(embedding)) ELSE [-1] END) AS pos
      FROM meta LEFT JOIN vec USING (doc_id))""",
    ),
    "parse_vector_text": _with(
        "vec",
        """SELECT doc_id, CAST(pos - 1 AS INT) AS pos, round(value, 6) AS value
FROM (SELECT doc_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS pos FROM vec)""",
    ),
    "topic_model_select": _with("vec centre td16", "SELECT topic_id, doc_id, weight FROM td16"),
    "topic_model_long": _with("vec centre td", "SELECT topic_id, doc_id, weight FROM td"),
    "postings_write": _with(
        "meta fields tok post",
        """SELECT field, count(*) AS n_postings, count(DISTINCT doc_id) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_tokens
FROM post GROUP BY field""",
    ),
    "doc_detail": _with(
        "meta vec",
        f"""SELECT doc_id, {_NO_TITLE}, abstract, uri, CAST(year AS DOUBLE) AS year, university FROM meta
WHERE doc_id IN (SELECT doc_id FROM vec)""",
    ),
    "abstract_split": _with("meta", "SELECT doc_id, abstract FROM meta"),
    "title_fallback": _with(
        "meta vec", f"SELECT doc_id, {_NO_TITLE} FROM vec FULL JOIN meta USING (doc_id)"
    ),
    "year_parse": _with("meta", "SELECT doc_id, year_raw, CAST(year AS DOUBLE) AS year FROM meta"),
    "topic_words_label": _with(
        f"{_TW} topics",
        """SELECT topic_id, array_to_string(words, ' ') AS label, array_to_string(words, ',') AS link,
       '''' || array_to_string(words, ''', ''') || '''' AS heading FROM topics""",
    ),
    "topic_members": _with("vec centre td", "SELECT topic_id, doc_id, weight FROM td WHERE weight > 0.3"),
    "topic_docs_faceted": _with(
        "meta vec centre td requests faceted", "SELECT request_id, doc_id, title, abstract, year FROM faceted"
    ),
    "topic_docs_faceted_one": _with(
        "meta vec centre td",
        f"""SELECT doc_id, {_NO_TITLE}, abstract, year FROM td JOIN meta USING (doc_id)
WHERE topic_id = 3 AND weight > 0.05 AND year BETWEEN 1995 AND 2015 AND trim(university) = 'src7'""",
    ),
    "l2_score": _with(
        "vec centre",
        """SELECT doc_id, round(1 / (1 + pow(list_distance(embedding, centre), 2)), 6) AS score
FROM vec JOIN centre USING (label)""",
    ),
    "vector_dim_check": _with(
        "vec",
        """SELECT doc_id, CAST(coalesce(len(embedding), 0) AS INT) AS dim
FROM documents FULL JOIN vec USING (doc_id) WHERE coalesce(len(embedding), 0) <> 64""",
    ),
    "hits_enrich": _search("passages", _MODE)
    + f"\nSELECT query_id, rank, doc_id, score, {_NO_TITLE}, abstract FROM hits JOIN meta USING (doc_id)",
    "topic_members_enrich": _with(
        "meta vec centre td",
        f"SELECT topic_id, doc_id, weight, {_NO_TITLE}, abstract FROM td JOIN meta USING (doc_id) WHERE weight > 0.3",
    ),
    "topic_sizes": _with("vec centre td sizes", "SELECT topic_id, n_docs FROM sizes"),
    "faceted_count": _with(
        "meta vec centre td requests faceted",
        """SELECT request_id, count(doc_id) AS n_docs FROM requests LEFT JOIN faceted USING (request_id)
GROUP BY request_id""",
    ),
    "year_histogram": _with(
        "meta vec centre td requests faceted",
        """SELECT r.request_id, CAST(y.year AS INT) AS year, count(f.doc_id) AS n_docs
FROM requests r CROSS JOIN (SELECT unnest(range(1998, 2013)) AS year) y
LEFT JOIN faceted f ON f.request_id = r.request_id AND f.year = y.year GROUP BY ALL""",
    ),
    "topic_size_series": _with(
        "vec centre td sizes",
        "SELECT CAST(row_number() OVER (ORDER BY n_docs DESC, topic_id) - 1 AS INT) AS x, n_docs FROM sizes",
    ),
    "facet_universities": _with(
        "meta", "SELECT trim(university) AS university, count(*) AS n_docs FROM meta GROUP BY 1"
    ),
    "term_stats": _with(
        "meta fields lens tok post stats",
        """SELECT field, term, df, n_docs, round(avg_dl, 6) AS avg_dl FROM dfs JOIN stats USING (field)""",
    ),
    "topics_ranked": _with(
        f"{_TW} topics centre td sizes",
        """SELECT CAST(row_number() OVER (ORDER BY n_docs DESC, topic_id) AS INT) AS rank, topic_id, n_docs,
       array_to_string(words, ' ') AS label FROM sizes JOIN topics USING (topic_id)""",
    ),
    "top_docs_per_topic": _with(
        "vec centre td",
        "SELECT topic_id, CAST(rank AS INT) AS rank, doc_id, weight FROM "
        + _ranked("td", "topic_id", "weight DESC, doc_id", 10),
    ),
    "top_topics_per_doc": _with(
        "vec centre td",
        "SELECT doc_id, CAST(rank AS INT) AS rank, topic_id, weight FROM "
        + _ranked("td", "doc_id", "weight DESC, topic_id", 3),
    ),
    "topic_first_duplicate": _with(
        f"{_TW} topics",
        """SELECT topic_id, min(topic_id) OVER (PARTITION BY words) AS canonical_id
FROM (SELECT topic_id, words FROM topics UNION ALL SELECT topic_id + 10 AS topic_id, words FROM topics)""",
    ),
    "search_page": _search("passages", _MODE, first=11, last=20) + _SHOW,
    "topk_global": _with(
        "vec centre td",
        """SELECT CAST(row_number() OVER (ORDER BY weight DESC, doc_id, topic_id) AS INT) AS rank, topic_id, doc_id, weight
FROM td ORDER BY weight DESC, doc_id, topic_id LIMIT 10""",
    ),
    "tokenize": _with("meta fields tok", "SELECT field, doc_id, term FROM tok"),
    "postings": _with(
        "meta fields lens tok post",
        "SELECT field, term, doc_id, tf, CAST(dl AS INT) AS dl FROM post JOIN lens USING (field, doc_id)",
    ),
    "search_bm25": _search("literal", _MODE) + _SHOW,
    "search_tfidf_mode": _search("literal", _USUAL) + _SHOW,
    "search_tfidf_classic": _search("literal", _TF_IDF, "('text')", "textfield") + _SHOW,
    "search_multifield": _search("literal", _MODE, _BOTH) + _SHOW,
    "search_default_query": _search("empty", _MODE, "('text')", "textfield") + _SHOW,
    "search_after": _search("passages", _MODE, _BOTH, first=11, last=20) + "\nSELECT query_id, CAST(rank - 10 AS INT) AS rank, doc_id, score FROM hits",
    "latent_space": "SELECT unnest(range(0, 8)) AS component, CAST(1 AS DOUBLE) AS words, CAST(1 AS DOUBLE) AS documents",
    "search_batch": _search("passages", _MODE, _BOTH) + _SHOW,
    "vector_knn": _with(
        "vec centre",
        "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, d2, round(1 / (1 + d2), 6) AS score FROM "
        + _ranked(
            """(SELECT c.label AS query_id, v.doc_id, round(pow(list_distance(c.centre, v.embedding), 2), 6) AS d2
      FROM centre c CROSS JOIN vec v)""",
            "query_id",
            "d2, doc_id",
            10,
        ),
    ),
    "knn_batch": _with(
        "vec neighbours",
        "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, d2, round(1 / (1 + d2), 6) AS score FROM "
        + _ranked("pairs", "query_id", "d2, doc_id", 10),
    ),
    "similar_documents": _with(
        "vec centre td",
        """, wide AS (SELECT doc_id, list(weight ORDER BY topic_id) AS w FROM td GROUP BY doc_id),
pairs AS (SELECT a.doc_id, b.doc_id AS similar_id, round(pow(list_distance(a.w, b.w), 2), 6) AS d2
          FROM wide a JOIN wide b ON a.doc_id <> b.doc_id)
SELECT doc_id, CAST(rank AS INT) AS rank, similar_id, d2 FROM """
        + _ranked("pairs", "doc_id", "d2, similar_id", 5),
    ),
    "similar_topics": _with(
        _TW,
        """, ids AS (SELECT DISTINCT topic_id FROM tw), terms AS (SELECT DISTINCT term FROM tw),
dense AS (SELECT topic_id, term, coalesce(weight, 0) AS weight
          FROM ids CROSS JOIN terms LEFT JOIN tw USING (topic_id, term)),
pairs AS (SELECT a.topic_id, b.topic_id AS similar_id, round(sum(pow(a.weight - b.weight, 2)), 9) AS d2
          FROM dense a JOIN dense b ON a.term = b.term AND a.topic_id <> b.topic_id GROUP BY ALL)
SELECT topic_id, CAST(rank AS INT) AS rank, similar_id, d2 FROM """
        + _ranked("pairs", "topic_id", "d2, similar_id", 3),
    ),
    "knn_approx_given_cells": _with(
        "vec centre",
        f""", gaps AS (SELECT v.doc_id, c.label AS cell, round(pow(list_distance(v.embedding, c.centre), 2), 9) AS gap
         FROM vec v CROSS JOIN centre c),
near AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap, cell) AS r FROM gaps),
pairs AS (SELECT q.doc_id AS query_id, n.doc_id, round(pow(list_distance(a.embedding, b.embedding), 2), 6) AS d2
          FROM near q JOIN near n ON q.cell = n.cell AND q.r <= {GIVEN_PROBE} AND n.r = 1 AND q.doc_id <> n.doc_id
          JOIN vec a ON a.doc_id = q.doc_id JOIN vec b ON b.doc_id = n.doc_id)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, d2, round(1 / (1 + d2), 6) AS score FROM """
        + _ranked("pairs", "query_id", "d2, doc_id", 10),
    ),
    "search_syntax": _with(
        "meta fields lens tok post stats",
        """, clauses(query_id, clause, sign, field, words) AS (VALUES
  (0, 0, '+', 'title', ['the']), (0, 0, '+', 'abstract', ['the']), (0, 1, '', 'title', ['of']),
  (0, 2, '-', 'title', ['of', 'the']), (0, 2, '-', 'abstract', ['of', 'the']),
  (1, 0, '', 'title', ['of', 'the']), (1, 0, '', 'abstract', ['of', 'the']), (1, 1, '', 'title', ['heit']), (1, 1, '', 'abstract', ['heit']),
  (2, 0, '+', 'title', ['the', 'the']), (2, 0, '+', 'abstract', ['the', 'the']), (2, 1, '+', 'title', ['in']), (2, 1, '+', 'abstract', ['in']),
  (3, 0, '', 'title', ['the']), (3, 1, '-', 'abstract', ['of']), (3, 2, '', 'title', ['und', 'der']), (3, 2, '', 'abstract', ['und', 'der'])),
bags AS (SELECT field, doc_id, """
        + _tokens("content")
        + """ AS tokens FROM fields),
matched AS (SELECT DISTINCT query_id, clause, sign, doc_id FROM clauses JOIN bags USING (field)
  WHERE CASE len(words) WHEN 1 THEN list_contains(tokens, words[1])
    ELSE len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = words[1] AND tokens[i + 1] = words[2])) > 0 END),
needed AS (SELECT query_id, count(DISTINCT clause) FILTER (WHERE sign = '+') AS needed FROM clauses GROUP BY query_id),
allowed AS (SELECT query_id, doc_id FROM matched JOIN needed USING (query_id) GROUP BY query_id, doc_id, needed
  HAVING count(*) FILTER (WHERE sign = '-') = 0 AND count(*) FILTER (WHERE sign = '+') = needed AND count(*) FILTER (WHERE sign <> '-') > 0),
q AS (SELECT query_id, field, term, count(*) AS qtf FROM (SELECT query_id, field, unnest(words) AS term FROM clauses WHERE sign <> '-') GROUP BY ALL),
scored AS (SELECT q.query_id, p.doc_id, round(sum("""
        + _BM25.format(k1="1.0", b="0.65")
        + """), 6) AS score
  FROM q JOIN post p USING (field, term) JOIN dfs d USING (field, term) JOIN stats s USING (field) JOIN lens l USING (field, doc_id)
  GROUP BY q.query_id, p.doc_id),
kept AS (SELECT * FROM scored JOIN allowed USING (query_id, doc_id))
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, doc_id, score FROM """
        + _ranked("kept", "query_id", "score DESC, doc_id", 10),
    ),
    "topic_word_long": _with(_TW, "SELECT topic_id, term, weight FROM tw WHERE weight > 0"),
    "fit_topic_model": f"""
SELECT 'document' AS kind, doc_id AS id, CAST(10 AS BIGINT) AS n, CAST(1 AS DOUBLE) AS total FROM documents
UNION ALL SELECT 'topic', t.topic_id, w.n, 1 FROM (SELECT unnest(range(0, 10)) AS topic_id) t,
  (SELECT count(DISTINCT term) AS n FROM (SELECT unnest({_tokens("text")}) AS term FROM documents)) w
UNION ALL SELECT 'words shown', topic_id, 10, 0 FROM (SELECT unnest(range(0, 10)) AS topic_id)""",
    "embed_corpus": _with("hashed", "SELECT doc_id, CAST(pos AS INT) AS pos, round(CAST(value AS DOUBLE), 5) AS value FROM hashed"),
    "embed_with_encoder": """
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(value AS DOUBLE) AS value FROM (
  SELECT doc_id, unnest([0, 1, 2]) AS pos,
         unnest([length(text), length(text) - length(replace(text, ' ', '')), length(text) - length(replace(text, 'e', ''))]) AS value
  FROM documents)""",
    "vector_text_search": _with(
        "meta hashed passages",
        f""", asked AS (SELECT query_id AS doc_id, text FROM queries),
words AS (SELECT doc_id, unnest({_tokens("text")}) AS term FROM asked),
counts AS (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 768 AS pos, count(*) AS n FROM words GROUP BY ALL),
wanted AS (SELECT doc_id AS query_id, pos, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS value FROM counts),
dots AS (SELECT query_id, doc_id, sum(CAST(w.value AS DOUBLE) * h.value) AS dot FROM wanted w JOIN hashed h USING (pos) GROUP BY ALL),
lengths AS (SELECT doc_id, sum(CAST(value AS DOUBLE) * value) AS own FROM hashed GROUP BY doc_id),
asks AS (SELECT query_id, sum(CAST(value AS DOUBLE) * value) AS own FROM wanted GROUP BY query_id),
pairs AS (SELECT a.query_id, m.doc_id, round(a.own + coalesce(l.own, 0) - 2 * coalesce(dot, 0), 6) AS d2
          FROM asks a CROSS JOIN meta m LEFT JOIN lengths l ON l.doc_id = m.doc_id
          LEFT JOIN dots ON dots.query_id = a.query_id AND dots.doc_id = m.doc_id),
hits AS (SELECT * FROM """
        + _ranked("pairs", "query_id", "d2, doc_id", 10)
        + f")\nSELECT query_id, CAST(rank AS INT) AS rank, doc_id, round(d2, 4) AS d2, {_NO_TITLE}, abstract FROM hits JOIN meta USING (doc_id)",
    ),
    "knn_approx_quality": _with(
        "vec centre neighbours",
        f""", gaps AS (SELECT v.doc_id, c.label AS cell, round(pow(list_distance(v.embedding, c.centre), 2), 9) AS gap
         FROM vec v CROSS JOIN centre c),
near AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap, cell) AS r FROM gaps),
close AS (SELECT q.doc_id AS query_id, n.doc_id FROM near q JOIN near n ON q.cell = n.cell AND q.r <= {GIVEN_PROBE} AND n.r = 1),
exact AS (SELECT * FROM """
        + _ranked("pairs", "query_id", "d2, doc_id", 10)
        + """)
SELECT round((SELECT count(*) FROM exact JOIN close USING (query_id, doc_id)) / (SELECT count(*) FROM exact), 6) AS recall,
       round((SELECT count(*) FROM close) / pow((SELECT count(*) FROM vec), 2), 6) AS candidate_share""",
    ),
    "knn_graph_quality": "SELECT count(DISTINCT embedding) AS n_nodes, CAST(24 AS BIGINT) AS longest_list, true AS recall_reached FROM embeddings",
    "search_phrases": _nested(PHRASES),
    "term_expansion": _expansion(WORD_FORMS),
    "search_word_forms": _nested(WORD_FORMS),
    "search_nested": _nested(NESTED),
}
ORACLES["parse_query_vector"] = ORACLES["parse_vector_text"]
# A walk from 32 starts with a beam of 64 finds all.
ORACLES["knn_by_graph"] = ORACLES["vector_knn"]
# All cells are visited and the codes lose next to nothing: the exact neighbours.
for _name in ("knn_batch_by_cells", "knn_approx", "knn_approx_by_blocks"):
    ORACLES[_name] = ORACLES["knn_batch"]

"""Keyword search: tokens, postings, statistics, BM25 and TF-IDF ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeglass.functions import text as tx
from tomeglass.functions.joins import BROADCAST_ROWS, is_within, join_lookup, join_requests
from tomeglass.operators.nearest import SCHEMA, HighestScores, as_ids
from tomeglass.operators.ranking import best_per_group
from tomeglass.session import cut_lineage

# Hits per query, and the two parameter sets of BM25.
HITS = 10
BM25_K1, BM25_B = 1.0, 0.65
DEFAULT_K1, DEFAULT_B = 1.2, 0.75

# Where a page begins: the score and the id of the last hit before it.
LAST = ("last_score", "last_id")

# Words of neighbouring texts that are counted together; a longer text by itself.
COUNTED_WORDS = 1_000_000

PRUNE_TERMS = 2000
BLOCK_ENTRIES = 2_000_000


@dataclass(frozen=True)
class TextIndex:
    """postings(doc_id, field, term, tf, dl, positions), term_stats(field, term, df), field_stats(field, n_docs, n_all, avg_dl), and
    grams(gram, term): pairs of letters of all terms, see ``term_grams``."""

    postings: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    grams: DataFrame


# Tokens and statistics


def by_document(documents: DataFrame, fields: Sequence[str], partitions: int) -> DataFrame:
    """The texts hashed by document, for an index bucketed by document: plain text is smaller than its postings. The ids are long, as
    those of postings, since a number of another type has another hash."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *fields).repartition(partitions, "doc_id")


def token_arrays(documents: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(doc_id, field, tokens, dl): one row per document and field, from one scan and without a shuffle."""
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), tx.tokens(F.col(f)).alias("tokens")) for f in fields])
    return documents.select("doc_id", F.explode(per_field).alias("f")).select(
        "doc_id", "f.field", "f.tokens", F.size("f.tokens").alias("dl")
    )


def tokenize(documents: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, doc_id, term), one row per occurrence."""
    return token_arrays(documents, fields).select("field", "doc_id", F.explode("tokens").alias("term"))


def counted_terms(arrays: DataFrame) -> DataFrame:
    """(doc_id, field, dl, terms), where ``terms`` lists each word of a text with (term, tf, positions). Words are counted inside each
    row, so neither a shuffle nor a table of counts is needed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.concatenate([[0], np.cumsum(batch.column("dl").to_numpy())])
            begin = 0
            while begin < batch.num_rows:
                end = min(batch.num_rows, max(begin + 1, int(np.searchsorted(total, total[begin] + COUNTED_WORDS, "right")) - 1))
                yield _counted(batch.slice(begin, end - begin))
                begin = end

    schema = "doc_id bigint, field string, dl int, terms array<struct<term: string, tf: bigint, positions: array<int>>>"
    rows = arrays.where(F.col("dl") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "field", "dl", "tokens")
    return rows.mapInArrow(count, schema)


def _counted(rows: pa.RecordBatch) -> pa.RecordBatch:
    dl = rows.column("dl").to_numpy()
    coded = rows.column("tokens").flatten().dictionary_encode()
    row = np.repeat(np.arange(len(dl)), dl)
    place = np.arange(len(row)) - np.repeat(np.cumsum(dl) - dl, dl)
    key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(place[order], pa.int32()))
    terms = coded.dictionary.take(coded.indices.take(pa.array(order[starts])))
    tf = pa.array(np.diff(np.append(starts, len(row))), pa.int64())
    entries = pa.StructArray.from_arrays([terms, tf, positions], ["term", "tf", "positions"])
    per_row = np.searchsorted(row[order[starts]], np.arange(len(dl) + 1))
    lists = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), entries)
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("field"), rows.column("dl"), lists], ["doc_id", "field", "dl", "terms"])


def postings(arrays: DataFrame) -> DataFrame:
    """(doc_id, field, term, tf, dl, positions): one row per document, field and word. No word is a key of anything."""
    entries = counted_terms(arrays).select("doc_id", "field", F.explode("terms").alias("p"), "dl")
    return entries.select("doc_id", "field", "p.term", "p.tf", "dl", "p.positions")


def term_counts(rows: DataFrame) -> DataFrame:
    """(field, term, df) from postings."""
    return rows.groupBy("field", "term").agg(F.count("*").alias("df"))


def pairs_of_letters(term: Column) -> Column:
    """Neighbouring letters of a term with a mark at both ends; a pair that comes again is numbered, so that sets of pairs compare
    like bags."""
    marked = F.concat(F.lit("^"), term, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(term) + 1), lambda i: F.substring(marked, i, F.lit(2)))
    return F.transform(pairs, lambda pair, i: F.concat(pair, F.size(F.filter(F.slice(pairs, 1, i + 1), lambda other: other == pair)).cast("string")))


def term_grams(stats: DataFrame) -> DataFrame:
    """(gram, term) for every different term of ``stats`` (field, term, df)."""
    return stats.select("term").distinct().select(F.explode(pairs_of_letters(F.col("term"))).alias("gram"), "term")


def field_stats(rows: DataFrame, n_all: int) -> DataFrame:
    """Per field of the postings: documents with a term, all ``n_all`` documents, average length over the former."""
    per_document = rows.groupBy("field", "doc_id").agg(F.max("dl").alias("dl"))
    return per_document.groupBy("field").agg(
        F.count("*").alias("n_docs"), F.lit(n_all).cast("bigint").alias("n_all"), F.avg("dl").alias("avg_dl")
    )


def term_stats(index: TextIndex) -> DataFrame:
    """(field, term, df, n_docs, avg_dl). One row per field is broadcast, whatever the corpus."""
    per_field = index.field_stats.select("field", "n_docs", "avg_dl")
    return index.term_stats.join(F.broadcast(per_field), "field")


# Scoring


@dataclass(frozen=True)
class Scoring:
    """The weight of a posting over tf, dl, df, n_docs, n_all and avg_dl; whether a repeated query word counts again."""

    weight: Column
    repeats: bool


def bm25(k1: float = BM25_K1, b: float = BM25_B) -> Scoring:
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturation = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl"))
    return Scoring(idf * F.col("tf") / saturation, repeats=True)


def tf_idf() -> Scoring:
    """tf · (ln(N/(df+1)) + 1), where N counts every document."""
    return Scoring(F.col("tf") * (F.log(F.col("n_all") / (F.col("df") + 1)) + 1), repeats=False)


def query_terms(queries: DataFrame, default: str = tx.DEFAULT_QUERY) -> DataFrame:
    """(query_id, term, qtf) of ``queries(query_id, text)``; an empty text stands for the default query."""
    text = tx.query_or_default(F.col("text"), default)
    words = queries.select("query_id", F.explode(tx.tokens(text)).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def search(
    index: TextIndex,
    queries: DataFrame,
    k: int = HITS,
    fields: Sequence[str] = ("title",),
    scoring: Scoring | None = None,
    default: str = tx.DEFAULT_QUERY,
    digits: int = 6,
    after: DataFrame | None = None,
) -> DataFrame:
    """Hits (query_id, rank, doc_id, score) of a batch of bag-of-words queries, any term may match.

    ``after`` (query_id, score, doc_id) goes on behind a hit of an earlier search, at the cost of a first page however deep
    that is; a query without a row there begins at its best.

    A document's score is the sum over fields and terms. Scores are rounded before ranking, so that the last
    bits, which depend on the order of addition, do not decide a rank; equal scores rank by doc_id.

    Whatever the plan, no row is made per query and matching document unless each word belongs to one query only:
    documents are scored in blocks, and a block hands on its k best per query.
    """
    scoring = scoring or bm25()
    all_fields = F.explode(F.array(*[F.lit(f) for f in fields])).alias("field")
    factor = (F.col("qtf") if scoring.repeats else F.lit(1)).cast("double").alias("factor")
    wanted = query_terms(queries, default).select(F.col("query_id").cast("bigint"), all_fields, "term", factor)
    if after is not None:
        last = after.select(F.col("query_id").cast("bigint"), F.col("score").alias("last_score"), F.col("doc_id").cast("bigint").alias("last_id"))
        begin = F.coalesce("last_score", F.lit(float("inf"))).alias("last_score")
        wanted = wanted.join(last, "query_id", "left").select(*wanted.columns, begin, F.coalesce("last_id", F.lit(-1)).alias("last_id"))
    gathered = wanted.limit(BROADCAST_ROWS + 1).toPandas()
    if len(gathered) > BROADCAST_ROWS:
        scores = _score_by_blocks(index, wanted, scoring, k, digits)
    else:
        gathered["term_id"] = gathered.groupby(["field", "term"]).ngroup()
        score = _score_own_words if gathered["term_id"].is_unique else _score_shared_words
        scores = score(_only_asked(index, gathered, fields), gathered, scoring, k, digits)
    return best_per_group(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select(
        "query_id", "rank", "doc_id", "score"
    )


def _only_asked(index: TextIndex, gathered: pd.DataFrame, fields: Sequence[str]) -> TextIndex:
    """Push a short list of query words into the scans, so that files sorted by term are read in part."""
    condition = F.col("field").isin(*fields)
    words = gathered["term"].unique().tolist()
    if len(words) <= PRUNE_TERMS:
        condition = condition & F.col("term").isin(words)
    return TextIndex(index.postings.where(condition), index.term_stats.where(condition), index.field_stats, index.grams)


def _weighted(index: TextIndex, terms: DataFrame) -> DataFrame:
    """Add the statistics to ``terms(field, term, ...)``, a counted small table."""
    stats = index.term_stats.join(F.broadcast(terms), ["field", "term"])
    return stats.join(F.broadcast(index.field_stats), "field")


def _score_own_words(index: TextIndex, gathered: pd.DataFrame, scoring: Scoring, k: int, digits: int) -> DataFrame:
    """No word belongs to two queries: a plain sum over the postings."""
    spark = index.postings.sparkSession
    own = gathered[["query_id", "field", "term", "factor", "term_id"]]
    asked = spark.createDataFrame(own, "query_id bigint, field string, term string, factor double, term_id bigint")
    matches = index.postings.join(F.broadcast(_weighted(index, asked)), ["field", "term"])
    part = (F.col("factor") * scoring.weight).alias("part")
    scores = matches.select("query_id", "doc_id", part).groupBy("query_id", "doc_id")
    scores = scores.agg(F.round(F.sum("part"), digits).alias("score"))
    if "last_id" not in gathered:
        return scores
    last = spark.createDataFrame(gathered[["query_id", "last_score", "last_id"]].drop_duplicates(), "query_id bigint, last_score double, last_id bigint")
    below = (F.col("score") < F.col("last_score")) | ((F.col("score") == F.col("last_score")) & (F.col("doc_id") > F.col("last_id")))
    return scores.join(F.broadcast(last), "query_id").where(below).drop("last_score", "last_id")


def _score_shared_words(index: TextIndex, gathered: pd.DataFrame, scoring: Scoring, k: int, digits: int) -> DataFrame:
    """Every posting is weighted once, documents are put together where they lie, and each task multiplies its
    documents by all queries."""
    spark = index.postings.sparkSession
    unique = gathered.drop_duplicates("term_id")[["field", "term", "term_id"]]
    terms = spark.createDataFrame(unique, "field string, term string, term_id bigint")
    matches = index.postings.join(F.broadcast(_weighted(index, terms)), ["field", "term"])
    entry = F.struct("term_id", scoring.weight.alias("weight"))
    documents = matches.select("doc_id", entry.alias("entry")).groupBy("doc_id").agg(F.collect_list("entry").alias("entries"))

    query_ids, first, row = np.unique(gathered["query_id"].to_numpy(), return_index=True, return_inverse=True)
    after = tuple(gathered[c].to_numpy()[first] for c in LAST) if "last_id" in gathered else None
    shared = spark.sparkContext.broadcast(((query_ids, row, gathered["term_id"].to_numpy(), gathered["factor"].to_numpy()), after))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, after = shared.value
        best = HighestScores(*asked, k, digits, after)
        for batch in batches:
            entries = batch.column("entries")
            row = np.repeat(np.arange(batch.num_rows), entries.value_lengths().to_numpy(zero_copy_only=False))
            term, weight = (entries.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            best.add(as_ids(batch.column("doc_id")), row, term, weight)
        yield pa.RecordBatch.from_pydict(best.columns())

    return _as_scores(documents.mapInArrow(score, SCHEMA))


def _score_by_blocks(index: TextIndex, wanted: DataFrame, scoring: Scoring, k: int, digits: int) -> DataFrame:
    """Too many query words for one task: documents and queries are cut into blocks by their ids, and every pair of
    blocks is a task. Words decide nothing about where a row goes, so a frequent word is no burden to any task."""
    on = ["field", "term"]
    words = wanted.groupBy(*on).agg(F.count("*").alias("n"))
    known = words.join(index.term_stats, on).join(F.broadcast(index.field_stats), "field")
    terms = cut_lineage(known.withColumn("term_id", F.monotonically_increasing_id()))
    last = [c for c in LAST if c in wanted.columns]
    asked = join_lookup(wanted, terms.select(*on, F.col("term_id").alias("asked_id")), on, terms).select(
        "query_id", "asked_id", "factor", *last
    )
    matches = join_requests(index.postings, terms, on, spread_by="doc_id").select(
        "doc_id", "term_id", scoring.weight.alias("weight")
    )
    size = terms.agg(F.sum("df").alias("matches"), F.sum("n").alias("asked")).first()
    doc_blocks, query_blocks = (-(-(size[name] or 1) // BLOCK_ENTRIES) for name in ("matches", "asked"))

    def blocks(df: DataFrame, own: str, key: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(
            other, F.explode(F.expr(f"sequence(0L, {m - 1}L)"))
        )

    def score(block: pa.Table, queries: pa.Table) -> pa.Table:
        query_ids, first, query_row = np.unique(as_ids(queries["query_id"]), return_index=True, return_inverse=True)
        after = tuple(as_ids(queries[c])[first] for c in last) or None
        best = HighestScores(query_ids, query_row, as_ids(queries["asked_id"]), as_ids(queries["factor"]), k, digits, after)
        if block.num_rows and queries.num_rows:
            ids, row = np.unique(as_ids(block["doc_id"]), return_inverse=True)
            order = np.argsort(row, kind="stable")
            best.add(ids, row[order], as_ids(block["term_id"])[order], as_ids(block["weight"])[order])
        return pa.Table.from_pydict(best.columns())

    left = blocks(matches, "d_block", "doc_id", doc_blocks, "q_block", query_blocks).groupBy("d_block", "q_block")
    right = blocks(asked, "q_block", "query_id", query_blocks, "d_block", doc_blocks).groupBy("d_block", "q_block")
    return _as_scores(left.cogroup(right).applyInArrow(score, SCHEMA))


def _as_scores(best: DataFrame) -> DataFrame:
    return best.select("query_id", "doc_id", (0.0 - F.col("cost")).alias("score"))


# Query syntax

# A clause: an optional sign, an optional field, then a phrase in quotes or a word.
CLAUSE = r"([+-]?)(?:(\w+):)?(?:\"([^\"]*)\"|([^\s\"]+))"


def parse_clauses(queries: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(query_id, clause, sign, field, words) of ``queries(query_id, text)``; one row per clause and field it looks in.

    ``+`` marks a clause that has to match, ``-`` one that must not; of the others any may. ``title:word`` looks in one field, a
    clause without a field, or with one that is not among ``fields``, in all of them. Quoted words have to follow each
    other. A clause without words is left out.
    """
    found = F.regexp_extract_all("text", F.lit(CLAUSE), F.lit(0))
    rows = queries.select("query_id", F.posexplode(found).alias("clause", "raw"))
    part = lambda i: F.regexp_extract("raw", CLAUSE, i)
    known = F.lower(part(2)).isin(*fields)
    named = F.when(known, F.array(F.lower(part(2)))).otherwise(F.array(*map(F.lit, fields)))
    # A prefix that is no field is text.
    body = F.concat_ws(" ", F.when(known | (part(2) == ""), F.lit(None)).otherwise(part(2)), part(3), part(4))
    rows = rows.select("query_id", "clause", part(1).alias("sign"), F.explode(named).alias("field"), tx.tokens(body).alias("words"))
    return rows.where(F.size("words") > 0)


def search_syntax(
    index: TextIndex,
    queries: DataFrame,
    k: int = HITS,
    fields: Sequence[str] = ("title",),
    scoring: Scoring | None = None,
    digits: int = 6,
) -> DataFrame:
    """Hits (query_id, rank, doc_id, score) of queries with signs, fields and phrases, see ``parse_clauses``.

    The words of all clauses but the excluded ones add to the score. A document is a hit if a clause matches, every ``+``
    clause does and no ``-`` clause does. Words and phrases are matched on the postings of their words alone. Tables of
    queries are broadcast if they are small by count; others meet the postings in salted shuffles.
    """
    scoring = scoring or bm25()
    clauses = cut_lineage(parse_clauses(queries, fields).withColumn("query_id", F.col("query_id").cast("bigint")))
    words = clauses.select("query_id", "clause", "sign", "field", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    few = is_within(words, BROADCAST_ROWS)
    terms = [r["term"] for r in words.select("term").distinct().limit(PRUNE_TERMS + 1).collect()]
    asked = F.col("field").isin(*fields) & (F.col("term").isin(terms) if len(terms) <= PRUNE_TERMS else F.lit(True))
    read = index.postings.where(asked)
    small = F.broadcast if few else lambda df: df

    def met_by(wanted: DataFrame) -> DataFrame:
        return join_requests(read, wanted, ["field", "term"], spread_by="doc_id", few=few)

    single = words.where("n = 1").select("query_id", "clause", "field", "term")
    by_word = met_by(single).select("query_id", "clause", "doc_id")
    long = words.where("n > 1").select("query_id", "clause", "field", "term", "n", "at")
    by_phrase = phrase_counts(met_by(long), ["query_id", "clause"]).select("query_id", "clause", "doc_id")
    matched = by_word.unionByName(by_phrase).distinct()

    kinds = clauses.select("query_id", "clause", "sign").distinct()
    needed = kinds.groupBy("query_id").agg(F.count(F.when(F.col("sign") == "+", 1)).alias("needed"))
    met = matched.join(small(kinds), ["query_id", "clause"]).groupBy("query_id", "doc_id")
    count = lambda sign: F.count(F.when(F.col("sign") == sign, 1))
    met = met.agg(count("+").alias("has"), count("-").alias("bad"), count("").alias("any")).join(small(needed), "query_id")
    allowed = met.where("bad = 0 and has = needed and has + any > 0").select("query_id", "doc_id")

    factor = (F.count("*") if scoring.repeats else F.lit(1)).cast("double").alias("factor")
    scored = words.where("sign <> '-'").groupBy("query_id", "field", "term").agg(factor)
    known = index.term_stats.where(asked).join(small(scored), ["field", "term"]).join(F.broadcast(index.field_stats), "field")
    scores = met_by(known).select("query_id", "doc_id", (F.col("factor") * scoring.weight).alias("part")).groupBy("query_id", "doc_id")
    scores = scores.agg(F.round(F.sum("part"), digits).alias("score")).join(allowed, ["query_id", "doc_id"])
    return best_per_group(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select("query_id", "rank", "doc_id", "score")


def phrase_counts(met: DataFrame, key: Sequence[str], slop: Column | None = None) -> DataFrame:
    """(*key, field, doc_id, tf, dl): how often documents have the phrases of ``met``, postings with the place ``at`` in a phrase of ``n`` words.

    A word at place p of the text and ``at`` of the phrase stands for a beginning p - at. An occurrence is a beginning of one
    word such that every word has one not before it, and at most ``slop`` after it; without ``slop`` all words have the
    same. The postings of a document lie together, so nothing is shuffled but the queries.
    """
    begins = F.transform("positions", lambda p: p - F.col("at"))
    kept = [F.first("n").alias("n"), F.max("dl").alias("dl"), *([F.first(slop).alias("_slop")] if slop is not None else [])]
    grouped = met.withColumn("begins", begins).groupBy(*key, "field", "doc_id").agg(F.collect_list("begins").alias("words"), *kept)
    whole = grouped.where(F.size("words") == F.col("n"))
    exact = F.aggregate("words", F.col("words")[0], F.array_intersect)
    if slop is None:
        found = exact
    else:
        every = F.array_distinct(F.flatten("words"))
        near = F.filter(every, lambda m: F.forall("words", lambda w: F.exists(w, lambda b: (b >= m) & (b <= m + F.col("_slop")))))
        found = F.when(F.col("_slop") == 0, exact).otherwise(near)
    return whole.withColumn("tf", F.size(found).cast("bigint")).where("tf > 0").select(*key, "field", "doc_id", "tf", "dl")


def search_page(
    index: TextIndex, queries: DataFrame, page: int, size: int = HITS, fields: Sequence[str] = ("title",)
) -> DataFrame:
    """Page ``page`` (from 1) of the ranked hits; ranks go on from the page before."""
    hits = search(index, queries, k=page * size, fields=fields)
    return hits.where(F.col("rank") > (page - 1) * size)

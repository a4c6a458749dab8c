"""Search by nested conditions: words, phrases with slop, prefixes, patterns and similar words, joined by all, any and not.

A batch of queries becomes two small tables: the leaves, which are matched on the text index, and the way in which the matches of a
document are put together, as a list of steps in the order of evaluation. Leaves over word forms are widened to the terms of the
index first, each by an equality join: prefixes and patterns by their first letters, similar words by shared pairs of letters.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeglass.functions import text as tx
from tomeglass.functions.joins import BROADCAST_ROWS, join_requests
from tomeglass.operators import lexical as lex
from tomeglass.operators.ranking import best_per_group
from tomeglass.session import cut_lineage

# Letters by which prefixes and patterns meet the terms of the index.
FIRST_LETTERS = 4
# So many ranges of terms reach the scan; with more, all terms are read.
RANGES = 200


@dataclass(frozen=True)
class Leaf:
    """A word; of a text with several words, the phrase of them. ``boost`` multiplies the score; without ``field`` all are searched."""

    text: str
    field: str | None = None
    boost: float = 1.0


class Word(Leaf):
    """Any document with the word."""


@dataclass(frozen=True)
class Phrase(Leaf):
    """The words in this order; with ``slop``, moved apart or past each other by as many places in all."""

    slop: int = 0


class Prefix(Leaf):
    """Words that begin with the text; the score is the boost for each field."""


class Pattern(Leaf):
    """Words like the text, in which ``*`` is any run of letters and ``?`` one; the score is the boost for each field."""


@dataclass(frozen=True)
class Similar(Leaf):
    """Words at most ``edits`` letters inserted, deleted or replaced away; each counts less by its edits per letter."""

    edits: int = 2


class Branch:
    """Conditions joined together; ``boost`` multiplies the scores of all leaves below."""

    def __init__(self, *parts: Leaf | Branch, boost: float = 1.0) -> None:
        self.parts, self.boost = parts, boost


class All(Branch):
    """Every part matches, except that parts in ``Not`` do not; the scores add up."""


class Any(Branch):
    """At least one part matches; the scores of those that do add up."""


class Not(Branch):
    """No part matches; adds nothing to a score."""


Condition = Leaf | Branch

_STEP = "array<struct<kind: string, n: int>>"
_LEAVES = "query_id bigint, leaf int, kind string, text string, fields array<string>, boost double, slop int"


def _steps(condition: Condition, boost: float, leaves: list[tuple[Leaf, float]]) -> Iterator[tuple[str, int]]:
    if isinstance(condition, Leaf):
        leaves.append((condition, boost * condition.boost))
        yield "leaf", len(leaves) - 1
        return
    for part in condition.parts:
        yield from _steps(part, boost * condition.boost, leaves)
    yield type(condition).__name__.lower(), len(condition.parts)


def as_tables(spark: SparkSession, queries: Mapping[int, Condition], fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves and steps (query_id, steps) of some queries, a batch that the caller holds in memory."""
    rows, programs = [], []
    for query_id, condition in queries.items():
        leaves: list[tuple[Leaf, float]] = []
        programs.append((query_id, list(_steps(condition, 1.0, leaves))))
        for number, (leaf, boost) in enumerate(leaves):
            where = [leaf.field] if leaf.field else list(fields)
            slop = leaf.slop if isinstance(leaf, Phrase) else leaf.edits if isinstance(leaf, Similar) else 0
            rows.append((query_id, number, type(leaf).__name__.lower(), leaf.text, where, float(boost), slop))
    return spark.createDataFrame(rows, _LEAVES), spark.createDataFrame(programs, f"query_id bigint, steps {_STEP}")


# Widening

_WIDENED = ["query_id", "leaf", "field", "term", "df", "factor", "constant"]


def _by_first_letters(index: lex.TextIndex, leaves: DataFrame) -> DataFrame:
    """Terms that begin with a prefix or fit a pattern. Leaves meet terms on as many first letters as they fix, up to ``FIRST_LETTERS``."""
    fixed = F.when(F.col("kind") == "prefix", F.lower("text")).otherwise(F.regexp_extract(F.lower("text"), r"^[^*?]*", 0))
    letters = F.substring(fixed, 1, FIRST_LETTERS)
    # Java quotes: a literal part between \Q and \E.
    quoted = F.concat(F.lit(r"^\Q"), F.regexp_replace(F.regexp_replace(F.lower("text"), r"\*", r"\\E.*\\Q"), r"\?", r"\\E.\\Q"), F.lit(r"\E$"))
    wanted = leaves.where("kind IN ('prefix', 'pattern') AND text <> ''").select(
        "query_id", "leaf", "kind", F.explode("fields").alias("field"), "boost", fixed.alias("fixed"), quoted.alias("like"), F.char_length(letters).alias("n"), letters.alias("letters")
    )
    starts = [r.letters for r in wanted.select("letters").distinct().limit(RANGES + 1).collect()]
    terms = index.term_stats
    if len(starts) <= RANGES:
        terms = terms.where(_any(F.col("term").startswith(s) for s in starts))
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(FIRST_LETTERS)), lambda n: F.struct(n.alias("n"), F.substring("term", F.lit(1), n).alias("letters"))))
    keyed = terms.select("field", "term", "df", cut.alias("key")).select("field", "term", "df", "key.n", "key.letters").where("char_length(letters) = n")
    fits = F.when(F.col("kind") == "prefix", F.col("term").startswith(F.col("fixed"))).otherwise(F.regexp_like("term", F.col("like")))
    met = keyed.join(F.broadcast(wanted), ["field", "n", "letters"]).where(fits)
    return met.select("query_id", "leaf", "field", "term", "df", F.col("boost").alias("factor"), F.lit(True).alias("constant"))


def _any(conditions: Iterator[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def similar_terms(index: lex.TextIndex, words: DataFrame) -> DataFrame:
    """(word, edits, term, distance) for ``words`` (word, edits): all terms within the distance, from pairs of letters that both have.

    An edit changes at most two of a word's pairs, so terms with too few common pairs are too far away. A word so short that none
    has to be left meets all terms of about its length.
    """
    words = words.distinct()
    pairs = words.where("char_length(word) >= 2 * edits").select("word", "edits", F.explode(lex.pairs_of_letters(F.col("word"))).alias("gram"))
    listed = [r.gram for r in pairs.select("gram").distinct().limit(lex.PRUNE_TERMS + 1).collect()]
    grams = index.grams.where(F.col("gram").isin(listed)) if len(listed) <= lex.PRUNE_TERMS else index.grams
    common = grams.join(F.broadcast(pairs), "gram").groupBy("word", "edits", "term").agg(F.count("*").alias("common"))
    enough = F.greatest(F.char_length("word"), F.char_length("term")) + 1 - 2 * F.col("edits")
    by_pairs = common.where(F.col("common") >= enough).select("word", "edits", "term")
    lengths = F.explode(F.sequence(F.char_length("word") - F.col("edits"), F.char_length("word") + F.col("edits")))
    short = words.where("char_length(word) < 2 * edits").select("word", "edits", lengths.alias("length"))
    terms = index.grams.where(F.col("gram").startswith("^")).select("term", F.char_length("term").alias("length"))
    candidates = by_pairs.unionByName(terms.join(F.broadcast(short), "length").select("word", "edits", "term"))
    return candidates.withColumn("distance", F.levenshtein("word", "term")).where("distance <= edits")


def _by_similarity(index: lex.TextIndex, leaves: DataFrame) -> DataFrame:
    asked = leaves.where("kind = 'similar'").select("query_id", "leaf", F.explode("fields").alias("field"), F.lower("text").alias("word"), F.col("slop").alias("edits"), "boost")
    near = cut_lineage(similar_terms(index, asked.select("word", "edits")))
    less = 1 - F.col("distance") / F.greatest(F.least(F.char_length("word"), F.char_length("term")), F.lit(1))
    met = near.join(F.broadcast(asked), ["word", "edits"]).withColumn("factor", F.col("boost") * less).where("factor > 0")
    known = index.term_stats.join(met, ["field", "term"])
    return known.select("query_id", "leaf", "field", "term", "df", "factor", F.lit(False).alias("constant"))


def expanded_terms(index: lex.TextIndex, queries: Mapping[int, Condition], fields: Sequence[str]) -> DataFrame:
    """(query_id, leaf, field, term, df): the terms of the index that the leaves over word forms stand for."""
    leaves, _ = as_tables(index.postings.sparkSession, queries, fields)
    return _widened(index, leaves).select("query_id", "leaf", "field", "term", "df")


def _widened(index: lex.TextIndex, leaves: DataFrame) -> DataFrame:
    return _by_first_letters(index, leaves).unionByName(_by_similarity(index, leaves))


# Matching


def _pruned(index: lex.TextIndex, terms: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The postings of a short list of terms, so that files sorted by term are read in part."""
    listed = [r.term for r in terms.select("term").distinct().limit(lex.PRUNE_TERMS + 1).collect()]
    condition = F.col("field").isin(*fields)
    return index.postings.where(condition & F.col("term").isin(listed) if len(listed) <= lex.PRUNE_TERMS else condition)


def matches(index: lex.TextIndex, leaves: DataFrame, scoring: lex.Scoring) -> DataFrame:
    """(query_id, doc_id, leaf, score): what each leaf adds to each document that it matches, over all its fields."""
    fields = [r.field for r in index.field_stats.select("field").collect()]
    words = leaves.where("kind IN ('word', 'phrase')").withColumn("words", tx.tokens(F.col("text"))).where("size(words) > 0")
    each = words.select("query_id", "leaf", F.explode("fields").alias("field"), "boost", "slop", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    asked = cut_lineage(each.join(index.term_stats, ["field", "term"], "left"))
    single = asked.where("n = 1 AND df IS NOT NULL").select("query_id", "leaf", "field", "term", "df", F.col("boost").alias("factor"), F.lit(False).alias("constant"))
    terms = cut_lineage(single.unionByName(_widened(index, leaves)))
    on = ["field", "term"]

    weighed = join_requests(_pruned(index, terms, fields), terms, on, spread_by="doc_id").join(F.broadcast(index.field_stats), "field")
    part = F.when(F.col("constant"), F.col("factor")).otherwise(F.col("factor") * scoring.weight)
    # A pattern counts once for each field, however many of its terms the field has.
    per_field = weighed.groupBy("query_id", "leaf", "doc_id", "field", "constant").agg(F.sum(part).alias("sum"), F.max(part).alias("max"))
    by_term = per_field.select("query_id", "leaf", "doc_id", F.when(F.col("constant"), F.col("max")).otherwise(F.col("sum")).alias("part"))

    long = asked.where("n > 1").select("query_id", "leaf", "field", "term", "n", "at", "slop")
    met = join_requests(_pruned(index, long, fields), long, on, spread_by="doc_id")
    counted = lex.phrase_counts(met, ["query_id", "leaf"], F.col("slop"))
    rarity = asked.where("n > 1").select("query_id", "leaf", "field", "df", F.col("boost").alias("factor"))
    phrases = join_requests(counted, rarity, ["query_id", "leaf", "field"], spread_by="doc_id").join(F.broadcast(index.field_stats), "field")
    by_phrase = phrases.select("query_id", "leaf", "doc_id", (F.col("factor") * scoring.weight).alias("part"))
    return by_term.unionByName(by_phrase).groupBy("query_id", "doc_id", "leaf").agg(F.sum("part").alias("score"))


def _evaluated(steps: Column, entries: Column) -> Column:
    """(hit, score) of a document, from the steps of a query and its entries (leaf, score): parts go on a stack, joins take them off."""
    empty = F.array().cast("array<struct<hit: boolean, score: double>>")

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda sum_, p: sum_ + p["score"])

    def value(hit: Column, score: Column) -> Column:
        return F.array(F.struct(hit.alias("hit"), F.when(hit, score).otherwise(F.lit(0.0)).alias("score")))

    def step(stack: Column, s: Column) -> Column:
        own = F.filter(entries, lambda e: e["leaf"] == s["n"])
        rest, parts = F.slice(stack, 1, F.size(stack) - s["n"]), F.slice(stack, F.size(stack) - s["n"] + 1, s["n"])
        return (
            F.when(s["kind"] == "leaf", F.concat(stack, value(F.size(own) > 0, total(own))))
            .when(s["kind"] == "all", F.concat(rest, value(F.forall(parts, lambda p: p["hit"]), total(parts))))
            .when(s["kind"] == "any", F.concat(rest, value(F.exists(parts, lambda p: p["hit"]), total(parts))))
            .otherwise(F.concat(rest, value(~F.exists(parts, lambda p: p["hit"]), F.lit(0.0))))
        )

    return F.aggregate(steps, empty, step, lambda stack: stack[0])


def search(
    index: lex.TextIndex,
    queries: Mapping[int, Condition],
    k: int = lex.HITS,
    fields: Sequence[str] = ("title",),
    scoring: lex.Scoring | None = None,
    digits: int = 6,
) -> DataFrame:
    """Hits (query_id, rank, doc_id, score) of nested conditions.

    Only documents that a leaf matches are looked at, so a query of nothing but ``Not`` has no hits. A leaf scores like a
    word of ``lexical.search``, a phrase like each of its words at the phrase's frequency. Leaves without words match nothing. The
    matches of a document are put together where its postings lie; a leaf's terms are as many as the index has.
    """
    scoring = scoring or lex.bm25()
    spark = index.postings.sparkSession
    leaves, programs = as_tables(spark, queries, fields)
    if not queries:
        return spark.createDataFrame([], "query_id bigint, rank int, doc_id bigint, score double")
    found = matches(index, leaves, scoring)
    entries = found.groupBy("query_id", "doc_id").agg(F.collect_list(F.struct("leaf", "score")).alias("entries"))
    few = len(queries) <= BROADCAST_ROWS
    judged = entries.join(F.broadcast(programs) if few else programs, "query_id").select("query_id", "doc_id", _evaluated(F.col("steps"), F.col("entries")).alias("r"))
    hits = judged.where("r.hit").select("query_id", "doc_id", F.round("r.score", digits).alias("score"))
    return best_per_group(hits, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select("query_id", "rank", "doc_id", "score")


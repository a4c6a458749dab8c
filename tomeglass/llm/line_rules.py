"""Quality rules on words and lines, and removal of lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeglass.functions.joins import BROADCAST_ROWS, is_within, join_lookup
from tomeglass.llm import shingles as sh
from tomeglass.session import cut_lineage

SYMBOLS = b"#*$%&|<>"


class Limits(NamedTuple):
    """A line is boilerplate on a host if more than ``min_docs`` distinct documents and ``share`` of the host's distinct documents have it.

    A document is depleted if less than ``left`` of its words stay. ``min_words`` and ``repeated`` (percent of words in
    repeated runs of three) are limits on the document alone.
    """

    min_docs: int = 30
    share: float = 0.002
    left: float = 0.3
    min_words: int = 50
    repeated: int = 50


def _counts(texts: sh.Texts) -> tuple[np.ndarray, ...]:
    """Per document: words, code points in words, symbols, repeated lines, words in repeated runs of three."""
    data, begins, docs = texts.data, texts.begins, len(texts)
    found = sh.words(texts, sh.plain_words(False))

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[begins[1:]] - total[begins[:-1]]

    inside = sh.plain_words(False).inside[data]
    chars = per_doc(inside & ((data & 0xC0) != 0x80))
    symbols = per_doc(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))

    lines = sh.words(texts, sh.alphabet(b"\n", False))
    seen = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    doc = np.repeat(np.arange(docs), np.diff(lines.first))
    spoken = seen[lines.end] > seen[lines.start]
    doc, key = doc[spoken], sh.mix(lines.hashes[spoken] + doc[spoken].astype(np.uint64) * sh.STEP)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    dup_lines = np.bincount(doc[order][again], minlength=docs)

    runs = sh.shingles(found, 3)
    per_run = np.diff(runs.first)
    n_words = np.diff(found.first)
    doc = np.repeat(np.arange(docs), per_run)
    key = sh.mix(runs.hashes + doc.astype(np.uint64) * sh.STEP)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    at = np.flatnonzero(twice)
    at = found.first[doc[at]] + at - runs.first[doc[at]]  # the word with which a repeated run begins
    covered = np.zeros(len(found.hashes) + 3, bool)
    for j in range(3):
        covered[at + j] = True
    total = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])
    return n_words, chars, symbols, dup_lines, total[found.first[1:]] - total[found.first[:-1]]


def rule_counts(docs: DataFrame) -> DataFrame:
    """(row, doc_id) of ``docs`` (row, doc_id, text) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_counts(texts) for texts in sh.text_slices(batch.column("text"))]
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts)] or [np.zeros(0, np.int64)] * len(names)
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), *map(pa.array, columns)], ["row", "doc_id", *names])

    return docs.select("row", "doc_id", "text").mapInArrow(count, "row bigint, doc_id bigint, " + ", ".join(f"{n} bigint" for n in names))


def normal_line(line: Column) -> Column:
    """A line in lower case, trimmed, with runs of white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " ")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def _text_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t\x0B\f\r]"))


def frequent_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(source, line, n): hashes of lines that more distinct documents of a host have than ``limits`` allow.

    Documents are told apart by the sequence of all their lines, so that copies count once, here and among the documents of the
    host: they are not boilerplate but duplicates, and other operators' business.
    """
    lines = F.transform(_text_lines(F.col("text")), normal_line)
    hashed = docs.select("source", F.transform(lines, lambda x: F.xxhash64(x)).alias("lines")).where("size(lines) > 0")
    hashed = hashed.select("source", F.xxhash64("lines").alias("told"), F.array_distinct("lines").alias("lines"))
    sizes = hashed.select("source", "told").distinct().groupBy("source").agg(F.count("*").alias("docs"))
    # The second aggregation sees a line once for each distinct document.
    once = hashed.select("source", "told", F.explode("lines").alias("line")).groupBy("source", "line", "told").agg(F.lit(1).alias("_"))
    counted = once.groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") > limits.min_docs)
    return counted.join(sizes, "source").where(F.col("n") > limits.share * F.col("docs")).select("source", "line", "n")


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without the lines whose hashes are in the array ``removed``; lines without words stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, line_hash(x))), "\n")


def clean_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, source): its counts, ``base_failed``, ``kept`` and ``removed``.

    ``base_failed`` judges the whole text by its own words. A document that passes is kept unless fewer than ``limits.left``
    of its words stay when the frequent lines of its host go; ``removed`` holds the hashes of those lines, and
    ``without_lines`` takes them out of a text. A missing text has no words, a missing host is a host of its own. Rows that
    share a doc_id are judged by their own texts. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "source", "text"))
    frequent = cut_lineage(frequent_lines(docs, limits))
    words = lambda x: F.size(F.filter(F.split(x, r"[ \t\x0B\f\r]+"), lambda w: w != ""))
    lines = F.transform(_text_lines(F.col("text")), lambda x: F.struct(line_hash(x).alias("line"), words(x).alias("words")))
    found = docs.select("row", "source", F.posexplode(lines).alias("pos", "l"))
    found = found.select("row", "source", "pos", F.col("l.line").alias("line"), F.col("l.words").alias("words"))
    keys = ["source", "line"]
    if is_within(frequent, BROADCAST_ROWS):
        hits = found.join(F.broadcast(frequent.select(*keys)), keys)
    else:
        hits = join_lookup(found, frequent.select(*keys), keys, frequent)
    # A set, so that rows repeated in the table count their lines once.
    gone = hits.groupBy("row").agg(F.collect_set(F.struct("pos", "line", "words")).alias("gone"))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeated * F.col("n_words"))
    gone_words = F.coalesce(F.aggregate("gone", F.lit(0).cast("bigint"), lambda n, x: n + x["words"]), F.lit(0))
    return (
        rule_counts(docs)
        .join(gone, "row", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_words") - gone_words >= limits.left * F.col("n_words")))
        .withColumn("removed", F.coalesce(F.array_distinct("gone.line"), F.array().cast("array<bigint>")))
        .drop("row", "gone")
    )

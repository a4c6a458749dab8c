"""Target-distribution importance resampling: draw the documents whose hashed word runs look most like a target's.

The distinct words of a slice of texts, each bounded by a delimiter on both sides, form an Aho-Corasick dictionary; a word carries
its CRC and its length in bytes. One scan of the automaton emits the payloads in order of the text. The CRC of a run of
words follows from the payloads of its neighbours alone, as appending n bytes is a linear map of a CRC, so no run is ever spelled
out. CRCs modulo the number of buckets are the features that are counted, and by which documents are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeglass.llm import shingles as sh
from tomeglass.session import cut_lineage

# Bytes of texts that share one dictionary; a longer text has one of its own.
DICTIONARY_BYTES = 4 << 20

# Lower-cased ASCII letters, digits and all bytes beyond ASCII stay, everything else becomes a space.
FOLDED = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Draw:
    """Runs of up to ``order`` words in ``buckets``; of the documents with ``least_words`` words, ``percent`` in 100 are drawn."""

    order: int = 2
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7


# CRCs of runs from CRCs of words


@cache
def _doubled_shifts(power: int) -> np.ndarray:
    """What appending 2^``power`` zero bytes makes of each byte of a CRC, as (4, 256)."""
    if power == 0:
        one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # linear part of one step
        value = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        return (value >> np.uint32(8)) ^ one[value & np.uint32(255)]
    half = _doubled_shifts(power - 1)
    return _apply(half, half)


def _apply(shift: np.ndarray, crc: np.ndarray) -> np.ndarray:
    parts = [shift[k][(crc >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


def appended(first: np.ndarray, second: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The CRC of a text followed by another one, from both CRCs and the length of the second."""
    out, power = first.copy(), 0
    while (n_bytes >> power).any():
        some = np.flatnonzero((n_bytes >> power) & 1)
        out[some] = _apply(_doubled_shifts(power), out[some])
        power += 1
    return out ^ second


# Automaton scans


@dataclass(frozen=True)
class Scan:
    """CRC and length of every word of some texts, in order, and the first word of each text."""

    crc: np.ndarray
    n_bytes: np.ndarray
    first: np.ndarray


def scan(texts: sh.Texts) -> Scan:
    """Find all words with an automaton of the distinct ones; a text is closed by a delimiter word of its own."""
    bounds = texts.begins.tolist()
    data = texts.data.tobytes().translate(FOLDED)
    whole = b" " + b" \n ".join(data[a:b] for a, b in zip(bounds, bounds[1:])) + b" \n "
    words = list(set(whole.split(b" ")) - {b"", b"\n"})
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    automaton.add_word(" \n ", 0)
    for number, word in enumerate(words, 1):
        automaton.add_word(f" {word.decode('latin-1')} ", number)
    automaton.make_automaton()
    found = np.array([number for _, number in automaton.iter(whole.decode("latin-1"))], np.int64)
    closing = found == 0
    crc = np.array([0, *map(zlib.crc32, words)], np.uint32)
    n_bytes = np.array([0, *map(len, words)], np.int64)
    per_text = np.diff(np.flatnonzero(closing), prepend=-1) - 1
    found = found[~closing]
    return Scan(crc[found], n_bytes[found], np.concatenate([[0], np.cumsum(per_text)]))


def run_buckets(found: Scan, how: Draw) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of one to ``order`` words, text by text, and the first run of each text."""
    per_text = np.diff(found.first)
    text = np.repeat(np.arange(len(per_text)), per_text)
    space = np.uint32(zlib.crc32(b" "))
    crc, buckets, of = found.crc, [found.crc % np.uint32(how.buckets)], [text]
    for size in range(2, how.order + 1):
        # The run that begins at a word, a space, and the word ``size`` - 1 places on.
        whole = text[size - 1 :] == text[: len(text) - size + 1]
        spaced = appended(crc[: len(whole)], np.full(len(whole), space), np.ones(len(whole), np.int64))
        crc = appended(spaced, found.crc[size - 1 :], found.n_bytes[size - 1 :])
        buckets.append((crc % np.uint32(how.buckets))[whole])
        of.append(text[: len(whole)][whole])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int32), np.searchsorted(of[order], np.arange(len(per_text) + 1))


def with_buckets(texts: DataFrame, how: Draw = Draw()) -> DataFrame:
    """(doc_id, n_words, buckets) for every row of ``texts`` (doc_id, text): a bucket for each run of words, repeats too."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sh.text_slices(batch.column("text"), DICTIONARY_BYTES):
                found = scan(some)
                buckets, first = run_buckets(found, how)
                ids = batch.column("doc_id").slice(some.first, len(some))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(buckets))
                yield pa.record_batch([ids, pa.array(np.diff(found.first)), lists], ["doc_id", "n_words", "buckets"])

    rows = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(measure, "doc_id bigint, n_words bigint, buckets array<int>")


# Counting and scoring


def bucket_counts(measured: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs. A task adds up its own and hands on at most one row per bucket."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column("buckets").flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(sums[some])], ["bucket", "n"])

    counted = measured.select("buckets").mapInArrow(add_up, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # as many rows as buckets
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, with one more of each; floored."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def _weighted(measured: DataFrame, gain: np.ndarray) -> DataFrame:
    shared = measured.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("buckets")
            n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(shared.value[column.flatten().to_numpy(zero_copy_only=False)])])
            last = np.cumsum(n)
            weight = (total[last] - total[last - n]) // np.maximum(n, 1)
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return measured.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def _noise(seed: int) -> Column:
    """A Gumbel variate in thousandths, from the hash of seed and id; a missing id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text).

    The weight is the mean gain of the document's word runs towards the texts of ``target`` (text), the score adds seeded
    noise, and the best ``percent`` of the documents with enough words are drawn in the order of ``rank``; the others have none. Words
    are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. A missing or empty text has no
    words and weight 0. Rows that repeat a doc_id are weighed and drawn one by one; equal scores rank by doc_id, a missing one
    last, then by n_features. An empty ``target`` or ``docs`` is a count of zeros. Other columns are ignored.

    Buckets of a text are written once and read for counting and for scoring. A score has at most some 110,000 values: a gain is
    less than 1000 ln 2^63 away from 0, the noise lies between -3,200 and 23,000. So a table of scores tells how
    many documents lie above each, and ranks are counted within one score, of which the noise gives no score a 2,000th of the rows.
    """
    measured = cut_lineage(with_buckets(docs, how))
    wanted = target.select(F.lit(None).cast("bigint").alias("doc_id"), "text")
    gain = gains(bucket_counts(measured, how.buckets), bucket_counts(with_buckets(wanted, how), how.buckets))
    scored = cut_lineage(_weighted(measured, gain).withColumn("score", F.col("weight") + _noise(how.seed)))
    able = F.col("n_words") >= how.least_words
    sizes = sorted(((r.score, r.n) for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn, above, places = how.percent * sum(n for _, n in sizes) // 100, 0, []
    for score, n in sizes:
        if above >= drawn:
            break
        places.append((score, above))
        above += n
    places = docs.sparkSession.createDataFrame(places, "score bigint, above bigint")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    marked = scored.join(F.broadcast(places), "score", "left").select(*columns, F.when(able, F.col("above")).alias("above"))
    ranked = marked.where("above IS NOT NULL").select(*columns, (F.col("above") + place).alias("rank"))
    none = F.lit(None).cast("bigint")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).otherwise(none))
    return ranked.unionByName(marked.where("above IS NULL").select(*columns, none.alias("rank")))

"""Quality classifier: random Fourier features over document statistics, ridge scores and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeglass.llm import shingles as sh
from tomeglass.session import cut_lineage

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "longest_word", "upper", "symbols", "bars", "shouts", "digits", "stops", "beyond_ascii",
    "distinct_words", "next_to_equal", "distinct_runs", "repeated_lines", "words_per_line", "lines_ending", "words_ending",
)
BINS = 2000


@dataclass(frozen=True)
class Settings:
    """Fourier features, width of the kernel in standard deviations of a statistic, ridge penalty per row, and the seed."""

    features: int = 256
    width: float = 4.0
    penalty: float = 1e-4
    seed: int = 11


def _flags(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = _UPPER | _flags("abcdefghijklmnopqrstuvwxyz")
_KINDS = {"symbols": _flags("#*$%&<>~^_{}[]\\/=+"), "bars": _flags("|"), "shouts": _flags("!?"), "digits": _flags("0123456789"), "stops": _flags(".,;:")}


def statistics(texts: sh.Texts) -> np.ndarray:
    """One row of ``STATISTICS`` per document; shares are 0 where there is nothing to share."""
    data, begins, docs = texts.data, texts.begins, len(texts)
    found = sh.words(texts, sh.plain_words(False))
    n_words = np.diff(found.first)
    safe = lambda n: np.maximum(n, 1)

    def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return total[first[1:]] - total[first[:-1]]

    in_word = sh.plain_words(False).inside[data]
    chars = sums(in_word & ((data & 0xC0) != 0x80), begins)
    letters = sums(_LETTERS[data], begins)
    length = (found.end - found.start).astype(np.float64)
    mean = sums(length, found.first) / safe(n_words)
    spread = np.sqrt(np.maximum(sums(length**2, found.first) / safe(n_words) - mean**2, 0))
    longest = np.zeros(docs)
    some = n_words > 0
    if some.any():
        longest[some] = np.maximum.reduceat(length, found.first[:-1][some])
    doc = np.repeat(np.arange(docs), n_words)
    equal = np.concatenate([(found.hashes[1:] == found.hashes[:-1]) & (doc[1:] == doc[:-1]), [False]])[: len(doc)]

    def distinct(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        key, at = np.unique(sh.mix(hashes + of.astype(np.uint64) * sh.STEP), return_index=True)
        return np.bincount(of[at], minlength=docs)

    runs = sh.shingles(found, 3)
    per_run = np.diff(runs.first)
    lines = sh.words(texts, sh.alphabet(b"\n", False))
    per_line = np.diff(lines.first)
    line_doc = np.repeat(np.arange(docs), per_line)
    ends = np.isin(data[found.end - 1], np.frombuffer(b".!?", np.uint8)) if len(doc) else np.zeros(0, bool)
    line_ends = np.isin(data[lines.end - 1], np.frombuffer(b".!?", np.uint8)) if len(line_doc) else np.zeros(0, bool)
    columns = {
        "log_words": np.log1p(n_words),
        "word_length": chars / safe(n_words),
        "word_length_spread": spread / np.maximum(mean, 1),
        "longest_word": np.log1p(longest),
        "upper": sums(_UPPER[data], begins) / safe(letters),
        "beyond_ascii": sums(data >= 0xC0, begins) / safe(chars),
        "distinct_words": distinct(found.hashes, doc) / safe(n_words),
        "next_to_equal": sums(equal, found.first) / safe(n_words),
        "distinct_runs": distinct(runs.hashes, np.repeat(np.arange(docs), per_run)) / safe(per_run),
        "repeated_lines": 1 - distinct(lines.hashes, line_doc) / safe(per_line),
        "words_per_line": np.log1p(n_words / safe(per_line)),
        "lines_ending": sums(line_ends, lines.first) / safe(per_line),
        "words_ending": sums(ends, found.first) / safe(n_words),
    } | {kind: sums(table[data], begins) / safe(chars) for kind, table in _KINDS.items()}
    return np.stack([columns[name] for name in STATISTICS], axis=1)


def text_statistics(column: pa.Array) -> np.ndarray:
    parts = [statistics(texts) for texts in sh.text_slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


class Fourier:
    """Standardised statistics, none further than six deviations from the mean, through cosines of random directions, which
    approximate a Gaussian kernel; and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, how: Settings) -> None:
        rng = np.random.default_rng(how.seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.directions = rng.normal(0, 1 / how.width, (len(mean), how.features))
        self.phases = rng.uniform(0, 2 * np.pi, how.features)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        standard = np.clip((rows - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(standard @ self.directions + self.phases)
        return np.concatenate([waves, np.ones((len(rows), 1))], axis=1)


@dataclass(frozen=True)
class Model:
    """Weights on the features, and the calibrated score at rising raw scores."""

    features: Fourier
    weights: np.ndarray
    raw: np.ndarray
    level: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.features(rows) @ self.weights, self.raw, self.level)


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of means ``y`` of ``n`` rows each at rising ``x``: centres and levels of the pools."""
    pools: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        pools.append([xi * ni, yi * ni, ni])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    table = np.array(pools)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row of ``docs`` (doc_id, text): the statistics of the whole text as an array."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = text_statistics(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(measure, "doc_id bigint, x array<double>")


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fold(doc_id: str = "doc_id"):
    """0, 1 or 2 by the CRC of the id; 1 is held out from all learning."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)).cast("int")


def fit(measured: DataFrame, labels: DataFrame, how: Settings = Settings()) -> Model:
    """Learn from ``measured`` (doc_id, x) and ``labels`` (doc_id, quality), without the rows of fold 1.

    Every task adds up the normal equations of its rows, the sums of all tasks are added by matrix row, and the driver solves a
    system whose size is the number of features. Each of the folds 0 and 2 is scored by the weights of the other one, and
    those scores are calibrated over ``BINS`` bins. All labelled rows count. Labels that are missing or neither 0 nor 1 are left
    out; with no labels every score is 0.5.
    """
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y in (0, 1)")
    rows = cut_lineage(measured.join(labels, "doc_id").withColumn("fold", fold()).where("fold <> 1").select("fold", "x", "y"))
    if rows.isEmpty():
        zeros = np.zeros(len(STATISTICS))
        return Model(Fourier(zeros, zeros, how), np.zeros(how.features + 1), np.array([0.0]), np.array([0.5]))
    vector = array_to_vector("x")
    summary = rows.agg(vector_to_array(Summarizer.mean(vector)).alias("m"), vector_to_array(Summarizer.std(vector)).alias("s")).first()
    features = Fourier(np.array(summary.m), np.array(summary.s), how)
    width = how.features + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width, width + 1))
        for batch in batches:
            z, y = features(_stack(batch.column("x"))), batch.column("y").to_numpy()
            second = batch.column("fold").to_numpy() == 2
            for i, some in enumerate((~second, second)):
                sums[i] += z[some].T @ np.concatenate([z[some], y[some, None]], axis=1)
        for i in range(2):
            lines = pa.array(list(sums[i]), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array([i] * width, pa.int32()), pa.array(range(width), pa.int32()), lines], ["fold", "line", "sums"])

    partial = rows.mapInArrow(add_up, "fold int, line int, sums array<double>")
    added = partial.groupBy("fold", "line").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    system = np.zeros((2, width, width + 1))
    for r in added.collect():  # 2 * (features + 1) rows
        system[r.fold, r.line] = r.sums

    def solve(sums: np.ndarray) -> np.ndarray:
        n = max(sums[-1, width - 1], 1.0)  # the constant's own square sum is the number of rows
        return np.linalg.solve(sums[:, :width] + how.penalty * n * np.eye(width), sums[:, width])

    other = np.stack([solve(system[1]), solve(system[0])])

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, at = features(_stack(batch.column("x"))), (batch.column("fold").to_numpy() == 2).astype(int)
            raw = np.clip((z * other[at]).sum(axis=1), -0.5, 1.5)
            yield pa.record_batch([pa.array(np.rint((raw + 0.5) / 2 * BINS).astype(np.int64)), batch.column("y")], ["bin", "y"])

    binned = rows.mapInArrow(raw_scores, "bin bigint, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    table = np.array(sorted((r.bin, r.y, r.n) for r in binned.collect()), float)  # at most BINS + 1 rows
    raw, level = pool_adjacent(table[:, 0] / BINS * 2 - 0.5, table[:, 1], table[:, 2])
    return Model(features, solve(system.sum(axis=0)), raw, level)


def quality_scores(docs: DataFrame, labels: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    The score, from 0 to 1, rises with the chance of label 1, and depends on the text alone. A missing text scores as an
    empty one. A missing doc_id is not held out. Rows that repeat a doc_id are scored one by one. Other columns are ignored.
    """
    measured = cut_lineage(with_statistics(docs))
    model = fit(measured, labels, how)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(_stack(batch.column("x"))))], ["doc_id", "score"])

    scored = measured.mapInArrow(score, "doc_id bigint, score double")
    held_out = F.coalesce(fold() == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, how: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, with all their columns."""
    model = fit(with_statistics(docs), labels, how)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(text_statistics(batch.column("text"))) >= least))

    return docs.mapInArrow(choose, docs.schema)

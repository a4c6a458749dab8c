"""Producers: LDA topic models and hashed text vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeglass.functions import text as tx
from tomeglass.operators.lexical import counted_terms, token_arrays
from tomeglass.operators.ranking import best_per_group
from tomeglass.session import cut_lineage, discard, spread
from tomeglass.sources.models import TopicModel

# The words shown per topic and the vector width.
TOPIC_WORDS = 10
DIMENSION = 768

# Words of documents, each counted once per document, that one task infers topics from. A word's row is sent to every block that has the word.
BLOCK_ENTRIES = 2_000_000
# Entries of documents whose topics are found together.
CACHED_ENTRIES = 8192

Encoder = Callable[[pd.Series], np.ndarray]


@dataclass(frozen=True)
class Blocks:
    """Documents dealt to blocks, for work that meets rows of the words of a block.

    ``documents`` (block, doc_id, places, counts): for every word of a document its place among the words of the block and how often
    it occurs, as 32-bit integers; ``words`` (block, place, term, df): every word of every block once.
    """

    documents: DataFrame
    words: DataFrame

    def per_term(self) -> DataFrame:
        """(term, n): the documents of each word."""
        return self.words.groupBy("term").agg(F.sum("df").alias("n"))


def word_blocks(documents: DataFrame, text: str = "text", block_entries: int = BLOCK_ENTRIES) -> Blocks:
    """The words of documents that have any, counted, dealt by hash to blocks of about ``block_entries`` of them and numbered there:
    words go to a block as texts once, whatever the number of passes."""
    arrays = token_arrays(documents.select("doc_id", F.col(text).alias("text")), ["text"])
    short = lambda e: F.struct(e["term"].alias("term"), e["tf"].cast("int").alias("tf"))
    counted = cut_lineage(counted_terms(spread(arrays)).select("doc_id", F.transform("terms", short).alias("terms")))
    entries = counted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(documents.sparkSession.sparkContext.defaultParallelism, -(-entries // block_entries))
    dealt = counted.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "terms")
    fields = "block int, doc_id bigint, places binary, counts binary, place int, term string, df bigint"
    table = cut_lineage(dealt.groupBy("block").applyInArrow(_numbered_words, fields))
    discard(counted)
    words = table.where("term IS NOT NULL").select(F.col("block").alias("block"), "place", "term", "df")
    return Blocks(table.where("term IS NULL").select("block", "doc_id", "places", "counts"), words)


def _numbered_words(dealt: pa.Table) -> pa.Table:
    """The documents of a block by numbers of its words, then these words."""
    lists = dealt["terms"].combine_chunks()
    coded = lists.flatten().field(0).dictionary_encode()
    place, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), len(coded.dictionary)
    counts = lists.flatten().field(1).to_numpy(zero_copy_only=False).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32) * np.int32(4)
    packed = lambda x: pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])
    block, rows = dealt["block"][0], dealt.num_rows
    names = ["block", "doc_id", "places", "counts", "place", "term", "df"]
    of_documents = [pa.repeat(block, rows), dealt["doc_id"].combine_chunks(), packed(place), packed(counts), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64())]
    numbers = [pa.array(np.arange(words, dtype=np.int32)), coded.dictionary, pa.array(np.bincount(place, minlength=words).astype(np.int64))]
    of_words = [pa.repeat(block, words), pa.nulls(words, pa.int64()), pa.nulls(words, pa.binary()), pa.nulls(words, pa.binary()), *numbers]
    return pa.concat_tables([pa.Table.from_arrays(of_documents, names), pa.Table.from_arrays(of_words, names)])


def fit_topic_model(
    documents: DataFrame,
    k: int,
    text: str = "text",
    vocabulary: int | None = None,
    min_docs: int = 1,
    iterations: int = 20,
    seed: int = 42,
    block_entries: int = BLOCK_ENTRIES,
) -> TopicModel:
    """Fit LDA by variational inference to whole texts: every iteration takes all documents, and all words count unless the caller
    limits them.

    The weights of a word, ``k`` numbers, are a row of a table. Documents are dealt to blocks by hash; in every iteration a block
    meets the rows of its own words, infers the topics of its documents, and hands on what it adds to each of its words. So neither
    the driver nor a task holds the weights of all words; the driver sees ``k`` sums. First weights follow from a
    hash of word, topic and seed, so that a seed gives the same model again. A document without words has weight 0 for
    every topic.
    """
    blocks = word_blocks(documents, text, block_entries)
    spread_of = blocks.per_term().where(F.col("n") >= min_docs)
    if vocabulary is not None:
        spread_of = spread_of.orderBy(F.desc("n"), "term").limit(vocabulary)
    weights = cut_lineage(spread_of.select("term", F.transform(hashed_normals(k, seed), lambda x: F.greatest(1 + 0.1 * x, F.lit(0.1))).alias("weights")))

    for _ in range(iterations):
        sums = summed_rows(_infer(blocks, weights, k), "weights", k)
        before, weights = weights, cut_lineage(sums.select("term", F.transform("weights", lambda w: w + 1 / k).alias("weights")))
        discard(before)
    inferred = _infer(blocks, weights, k, False).select("doc_id", "weights")
    empty = documents.select("doc_id").join(blocks.documents.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.array_repeat(F.lit(0.0), k).alias("weights"))
    topic_doc = cut_lineage(inferred.unionByName(empty)).select("doc_id", F.posexplode("weights").alias("topic_id", "weight"))
    totals = F.array(*[F.lit(float(t)) for t in _totals(weights, k)])
    shares = weights.select("term", F.posexplode(F.zip_with("weights", totals, lambda w, t: w / t)).alias("topic_id", "weight"))
    topic_word = shares.select("topic_id", "term", "weight")
    return TopicModel(heaviest_words(topic_word), topic_doc.select("topic_id", "doc_id", "weight"), topic_word)


def summed_rows(rows: DataFrame, name: str, n: int) -> DataFrame:
    """(term, ``name``): the sum of the arrays of ``n`` numbers of each term, column by column, so that it is compiled and begins before the shuffle."""
    sums = rows.groupBy("term").agg(*[F.sum(F.get(name, F.lit(i))).alias(f"_{i}") for i in range(n)])
    return sums.select("term", F.array(*[f"_{i}" for i in range(n)]).alias(name))


def hashed_normals(n: int, seed: int) -> Column:
    """``n`` normal variates for a ``term``, from its hashes: the same in every run and on every machine."""

    def uniform(i: Column, number: int) -> Column:
        return (F.pmod(F.xxhash64("term", i, F.lit(seed), F.lit(number)), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * np.pi * uniform(i, 1)))


def _totals(weights: DataFrame, k: int) -> np.ndarray:
    summed = weights.groupBy(F.lit("all")).agg(vector_to_array(Summarizer.sum(array_to_vector("weights"))).alias("sums")).first()
    return np.array(summed.sums) if summed else np.ones(k)


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of the logarithm of the gamma function, for positive numbers."""
    below = sum(1 / (x + i) for i in range(6))
    x = x + 6
    square = 1 / (x * x)
    return np.log(x) - 0.5 / x - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square / 240))) - below


def _expected(gamma: np.ndarray) -> np.ndarray:
    return np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True)))


def infer_topics(
    doc: np.ndarray, term: np.ndarray, n: np.ndarray, beta: np.ndarray, docs: int, alpha: float, steps: int = 60, close: float = 1e-3, add: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of documents, and what they ``add`` to the weights of words, from entries (doc, term, n) in order of documents.

    ``beta`` holds the exponentials of the expected logarithms of the words' weights. A document is done when its weights
    change by less than ``close`` on average.
    """
    k = beta.shape[1]
    total = np.searchsorted(doc, np.arange(docs + 1))
    lengths = np.diff(total)
    gamma = np.full((docs, k), alpha) + np.bincount(doc, n, docs)[:, None] / k
    theta, columns = _expected(gamma), np.ascontiguousarray(beta.T)
    # Documents do not depend on each other: those that fill up to one length are a stack of small matrices, some at a time, so that
    # they stay in a cache.
    step = 1 << np.maximum(np.log2(np.maximum(lengths, 1)).astype(np.int64) - 3, 3)
    filled = -(-lengths // step) * step
    order = np.argsort(filled, kind="stable")
    order = order[lengths[order] > 0]
    begin = 0
    while begin < len(order):
        width = int(filled[order[begin]])
        end = min(int(np.searchsorted(filled[order], width, "right")), begin + max(1, CACHED_ENTRIES // width))
        live, begin = order[begin:end], end
        inside = np.arange(width) < lengths[live][:, None]
        at = np.where(inside, total[live][:, None] + np.arange(width), total[live][:, None])
        counts, words = np.where(inside, n[at], 0.0), term[at]
        rows = np.empty((len(live), k, width))
        for t in range(k):
            rows[:, t] = columns[t][words]
        for _ in range(steps):
            ratio = counts / (np.matmul(theta[live][:, None], rows)[:, 0] + 1e-100)
            new = alpha + theta[live] * np.matmul(rows, ratio[:, :, None])[:, :, 0]
            going = np.abs(new - gamma[live]).mean(axis=1) >= close
            gamma[live], theta[live] = new, _expected(new)
            live = live[going]
            if not len(live):
                break
            if not going.all():
                counts, rows = counts[going], rows[going]
    if not add:
        return gamma, np.zeros((0, k))
    met = np.full(len(doc), 1e-100)
    for t in range(k):
        met += np.repeat(theta[:, t], lengths) * columns[t][term]
    shared = n / met
    added = np.stack([np.bincount(term, shared * np.repeat(theta[:, t], lengths), len(beta)) for t in range(k)], axis=1) * beta
    return gamma, added


def block_entries_of(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry of the documents of a block whose word is in ``right`` the row of the document, that of the word, and how often it occurs."""
    places, n = (np.frombuffer(b"".join(left[name].to_pylist()), np.int32) for name in ("places", "counts"))
    doc = np.repeat(np.arange(left.num_rows, dtype=np.int32), pc.binary_length(left["places"]).to_numpy() // 4)
    listed = right["place"].to_numpy()
    row = np.full(max(places.max(initial=-1), listed.max(initial=-1)) + 1, -1, np.int32)
    row[listed] = np.arange(len(listed), dtype=np.int32)
    term = row[places]
    known = term >= 0
    return (doc, term, n) if known.all() else (doc[known], term[known], n[known])


def lists_of(rows: np.ndarray) -> pa.Array:
    at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1]))
    return pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(rows).ravel()))


def _infer(blocks: Blocks, weights: DataFrame, k: int, add: bool = True) -> DataFrame:
    """(doc_id, term, weights): what every block adds to each of its words, or without ``add`` the shares of the topics of its documents."""
    totals = digamma(_totals(weights, k))
    names = ["doc_id", "term", "weights"]

    def infer(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, term, n = block_entries_of(left, right)
        rows = right["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        gamma, added = infer_topics(doc, term, n.astype(np.float64), np.exp(digamma(rows) - totals), left.num_rows, 1 / k, add=add)
        if add:
            return pa.Table.from_arrays([pa.nulls(right.num_rows, pa.int64()), right["term"].combine_chunks(), lists_of(added)], names)
        share = gamma / gamma.sum(axis=1, keepdims=True)
        some = np.bincount(doc, minlength=left.num_rows) > 0
        return pa.Table.from_arrays([left["doc_id"].combine_chunks(), pa.nulls(left.num_rows, pa.string()), lists_of(np.where(some[:, None], share, 0.0))], names)

    rows_of_words = blocks.words.join(weights, "term").select("block", "place", "term", "weights").groupBy("block")
    return blocks.documents.groupBy("block").cogroup(rows_of_words).applyInArrow(infer, "doc_id bigint, term string, weights array<double>")


def numbered(spread: DataFrame) -> DataFrame:
    """(term, place): places from 0 without gaps, widest spread first. Rows are sorted into ranges and counted per range."""
    ranged = cut_lineage(
        spread.repartitionByRange(F.desc("n"), F.asc("term"))
        .sortWithinPartitions(F.desc("n"), "term")
        .select("term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"))
    )
    parts = ranged.groupBy("part").agg(F.count("*").alias("rows"), F.min("seq").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("seq") - F.col("first")
    return ranged.join(F.broadcast(starts), "part").select("term", place.cast("int").alias("place"))


def heaviest_words(topic_word: DataFrame, n: int = TOPIC_WORDS) -> DataFrame:
    """(topic_id, words): the n heaviest terms of each topic, equal weights in the order of the terms."""
    best = best_per_group(topic_word, ["topic_id"], [F.desc("weight"), F.asc("term")], n)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return best.groupBy("topic_id").agg(F.transform(ordered, lambda w: w["term"]).alias("words"))


def embed_hashed(documents: DataFrame, text: str = "text", dim: int = DIMENSION) -> DataFrame:
    """(doc_id, embedding): word counts at places given by the first digits of the word's MD5, scaled to length 1.

    A stand-in that needs no weights, not a language model: texts are close if they share words.
    """
    place = F.transform(tx.tokens(F.col(text)), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dim)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(places).to_numpy(zero_copy_only=False))
            counts = np.zeros((batch.num_rows, dim))
            np.add.at(counts, (row, places.flatten().to_numpy(zero_copy_only=False)), 1)
            length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit = (counts / np.where(length > 0, length, 1)).astype(np.float32)
            at = pa.array(np.arange(0, unit.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "embedding": pa.ListArray.from_arrays(at, pa.array(unit.ravel()))})

    return documents.select("doc_id", place.alias("places")).mapInArrow(count, "doc_id bigint, embedding array<float>")


def embed(documents: DataFrame, load_encoder: Callable[[], Encoder], text: str = "text") -> DataFrame:
    """(doc_id, embedding) by a caller's sentence encoder, loaded once per partition and fed whole batches."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder()
        for batch in batches:
            vectors = np.asarray(encoder(batch["text"]), dtype=np.float32)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "embedding": list(vectors)})

    rows = documents.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(encode, "doc_id bigint, embedding array<float>")

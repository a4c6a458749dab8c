"""Learnt text vectors: TF-IDF and a truncated singular value decomposition of the whole corpus.

The matrix of documents and words is never built. A pass multiplies it by a table of word rows and its transpose by the result, block
of documents by block, and adds up what each word gets; the table is made orthogonal from the sum of its products, a
matrix as small as the number of columns, which is all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeglass.operators import learning as ml
from tomeglass.session import cut_lineage, discard


# Words of documents, each counted once per document, that one task holds. A word's row is sent to every block that has the word.
BLOCK_ENTRIES = 8_000_000
# Of these, what is multiplied at a time.
SLICE_ENTRIES = 1_000_000


@dataclass(frozen=True)
class LatentModel:
    """``words`` (term, idf, row): for every word its weight and its row of right singular vectors; the singular values."""

    words: DataFrame
    values: np.ndarray


def _rows(table: pa.Table, width: int) -> np.ndarray:
    return table["row"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _slices(left: pa.Table, right: pa.Table, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents at a time: their entries (document, word, weight) with rows of length 1, and the products of the documents with
    ``columns``, which have a number for each word of ``right``."""
    doc, term, n = ml.block_entries_of(left, right)
    idf, total = right["idf"].to_numpy(), np.searchsorted(doc, np.arange(left.num_rows + 1))
    begin = 0
    while begin < left.num_rows:
        end = min(left.num_rows, max(begin + 1, int(np.searchsorted(total, total[begin] + SLICE_ENTRIES, "right")) - 1))
        some, docs = slice(total[begin], total[end]), end - begin
        place, words = doc[some] - begin, term[some]
        weight = (1 + np.log(n[some])) * idf[words]
        weight = weight / np.sqrt(np.bincount(place, weight**2, docs))[place]
        yield place, words, weight, np.stack([np.bincount(place, weight * column[words], docs) for column in columns], axis=1)
        begin = end


def _sums_of_products(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of the outer products of all ``row`` with themselves; a task adds up its own."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            matrix = batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += matrix.T @ matrix
        yield pa.RecordBatch.from_pydict({"i": np.arange(width), "row": list(total)})

    added = rows.select("row").mapInArrow(add_up, "i bigint, row array<double>").groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    out = np.zeros((width, width))
    for r in added.collect():  # as many rows as columns
        out[r.i] = r.row
    return (out + out.T) / 2


def _turned(words: DataFrame, turn: np.ndarray) -> DataFrame:
    """Every ``row`` multiplied by ``turn``."""
    shared = words.sparkSession.sparkContext.broadcast(turn)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(shared.value)) @ shared.value
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("idf"), ml.lists_of(matrix)], ["term", "idf", "row"])

    return words.select("term", "idf", "row").mapInArrow(multiply, "term string, idf double, row array<double>")


def _orthogonal(words: DataFrame, width: int) -> np.ndarray:
    """What turns all rows so that the columns are orthogonal and of length 1; directions that are empty become zero."""
    values, vectors = np.linalg.eigh(_sums_of_products(words, width))
    scale = np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return vectors * scale


def fit_latent(documents: DataFrame, k: int, text: str = "text", min_docs: int = 1, more: int = 16, passes: int = 6, seed: int = 7, block_entries: int = BLOCK_ENTRIES) -> LatentModel:
    """The ``k`` greatest singular values of the corpus and their vectors, by ``passes`` of subspace iteration with ``more`` columns.

    A document's row holds (1 + ln tf) · ln(1 + N / df) of its words, scaled to length 1; N counts documents with words. All documents
    and all words in ``min_docs`` documents count in every pass. The first rows follow from hashes, so a seed gives the same again.
    """
    blocks = ml.word_blocks(documents, text, block_entries)
    width, n = k + more, blocks.documents.count()
    counted = blocks.per_term().where(F.col("n") >= min_docs)
    idf = cut_lineage(counted.select("term", F.log(1 + F.lit(n) / F.col("n")).alias("idf")))
    of_blocks = cut_lineage(blocks.words.join(idf, "term").select("block", "place", "term", "idf"))

    def met(words: DataFrame, turn: np.ndarray, back: bool) -> DataFrame:
        """What every block adds to its words, or without ``back`` the products of its documents. Rows are turned where they are used.

        Rows go to blocks and back in single precision, since the next pass makes up for it; the last products are made from rows as they are.
        """

        def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
            columns = np.ascontiguousarray((_rows(right, width) @ turn).T)
            if not back:
                return pa.concat_tables([pa.Table.from_arrays([ml.lists_of(products)], ["row"]) for *_, products in _slices(left, right, columns)])
            added = np.zeros(columns.shape)
            for place, word, weight, products in _slices(left, right, columns):
                for i in range(width):
                    added[i] += np.bincount(word, weight * products[place, i], right.num_rows)
            return pa.Table.from_arrays([right["term"].combine_chunks(), ml.lists_of(added.T.astype(np.float32))], ["term", "row"])

        sent = F.col("row").cast("array<float>") if back else F.col("row")
        rows = of_blocks.join(words.select("term", sent.alias("row")), "term").select("block", "place", "term", "idf", "row").groupBy("block")
        return blocks.documents.groupBy("block").cogroup(rows).applyInArrow(multiply, "term string, row array<float>" if back else "row array<double>")

    words = cut_lineage(idf.select("term", ml.hashed_normals(width, seed).alias("row")))
    turn = _orthogonal(words, width)
    for _ in range(passes):
        before, words = words, cut_lineage(ml.summed_rows(met(words, turn, True), "row", width))
        discard(before)
        turn = _orthogonal(words, width)
    values, last = np.linalg.eigh(_sums_of_products(met(words, turn, False), width))
    first = np.argsort(-values)[:k]
    last = last[:, first] * np.where(last[np.abs(last[:, first]).argmax(axis=0), first] < 0, -1.0, 1.0)  # one of the two signs
    return LatentModel(cut_lineage(_turned(words.join(idf, "term"), turn @ last)), np.sqrt(np.maximum(values[first], 0)))


def embed_latent(documents: DataFrame, model: LatentModel, text: str = "text", block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(doc_id, embedding): the documents, or queries, in the model's space; one without a known word is all zeros."""
    k = len(model.values)
    blocks = ml.word_blocks(documents, text, block_entries)

    def embed(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = np.ascontiguousarray(_rows(right, k).T)
        products = np.concatenate([np.zeros((0, k)), *(products for *_, products in _slices(left, right, columns))])
        return pa.Table.from_arrays([left["doc_id"].combine_chunks(), ml.lists_of(products)], ["doc_id", "embedding"])

    rows = blocks.words.join(model.words, "term").select("block", "place", "idf", "row").groupBy("block")
    found = blocks.documents.groupBy("block").cogroup(rows).applyInArrow(embed, "doc_id bigint, embedding array<double>")
    empty = documents.select("doc_id").join(blocks.documents.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").cast("bigint"), F.array_repeat(F.lit(0.0), k).alias("embedding"))
    return found.unionByName(empty)

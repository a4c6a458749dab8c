"""Test items inside long documents: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeglass.llm import shingles as sh


class Method(NamedTuple):
    """Words per shingle, least containment in percent, MinHash functions, and the least size class of items.

    Class c holds the items of more than half of c and at most c shingles. Documents are cut into windows of two blocks
    of c shingles, every block in two windows, so an item inside a document lies in one window whatever the length of the
    document, and makes up at least a fifth of its shingles. One equal value of ``hashes`` proposes the pair: a contiguous
    item is missed with a chance below (1 - 0.19)^64, one in 700,000. Items of at most half of the least class would be too
    small a part of its windows; they are looked up by their shingles and never missed.
    """

    shingle: int = 5
    percent: int = 80
    hashes: int = 64
    least_class: int = 16
    block_items: int = 20_000


class Item(NamedTuple):
    item_id: int
    words: int
    shingles: np.ndarray


class Partition:
    """The items of one shingle length and one size class."""

    def __init__(self, items: list[Item], how: Method) -> None:
        self.items = items
        begins = np.concatenate([[0], np.cumsum([len(i.shingles) for i in items])[:-1]])
        self.values = sh.block_minima(np.concatenate([i.shingles for i in items]), begins, how.hashes)
        # Which low bits occur among the items' values, per function: a first look that rules out nearly all windows.
        self.mask = np.uint32((1 << (32 * len(items)).bit_length()) - 1)
        self.low = np.zeros((how.hashes, int(self.mask) + 1), bool)
        for k in range(how.hashes):
            self.low[k, self.values[:, k] & self.mask] = True
        self.order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.asfortranarray(np.take_along_axis(self.values, self.order, axis=0))

    def matches(self, windows: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item number) of equal values."""
        for k in range(windows.shape[1]):
            column = windows[:, k]
            near = np.flatnonzero(self.low[k][column & self.mask])
            first, last = (np.searchsorted(self.sorted[:, k], column[near], side) for side in ("left", "right"))
            for at in np.flatnonzero(first < last):
                for i in self.order[first[at] : last[at], k]:
                    yield int(near[at]), int(i)


class Lookup:
    """The items of one shingle length that are too short for windows, by so many of their shingles that no match holds none."""

    def __init__(self, items: list[Item], how: Method) -> None:
        self.items = items
        # Of n shingles at least ``needed`` have to be in a document, so one of any n - needed + 1.
        needed = [max(1, -(-how.percent * len(i.shingles) // 100)) for i in items]
        keys = [i.shingles[: len(i.shingles) - n + 1] for i, n in zip(items, needed)]
        values, number = np.concatenate(keys), np.repeat(np.arange(len(items)), [len(k) for k in keys])
        order = np.argsort(values, kind="stable")
        self.values, self.number = values[order], number[order]

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(document, item number) of equal shingles."""
        at = np.flatnonzero(np.isin(hashes, self.values))
        doc = np.searchsorted(first, at, "right") - 1
        low, high = np.searchsorted(self.values, hashes[at], "left"), np.searchsorted(self.values, hashes[at], "right")
        return {(d, int(i)) for d, a, b in set(zip(doc.tolist(), low.tolist(), high.tolist())) for i in self.number[a:b]}


def _items(rows: list[tuple[int, str]], how: Method) -> dict[int, dict[int, list[Item]]]:
    """Items by shingle length, then by size class, 0 for those at most half of the least; an item shorter than a shingle is one shingle of its own length."""
    found: dict[int, dict[int, list[Item]]] = {}
    for texts in sh.text_slices(pa.array([t for _, t in rows], pa.string())):
        split = sh.words(texts, sh.letter_words())
        whole = sh.shingles(split, how.shingle)
        for d in range(len(texts)):
            n_words = int(split.first[d + 1] - split.first[d])
            own = np.unique(whole.hashes[whole.first[d] : whole.first[d + 1]])
            if not len(own):
                continue
            size = how.least_class if 2 * len(own) > how.least_class else 0
            while 0 < size < len(own):
                size *= 2
            item = Item(rows[texts.first + d][0], n_words, own)
            found.setdefault(min(n_words, how.shingle), {}).setdefault(size, []).append(item)
    return found


def _window_minima(hashes: np.ndarray, first: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values of windows of two blocks of ``size`` shingles, and the document of each."""
    per_doc = np.diff(first)
    blocks = -(-per_doc // size)
    doc = np.repeat(np.arange(len(per_doc)), blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    minima = sh.block_minima(hashes, first[doc] + nth * size, n)
    followed = np.flatnonzero(doc[:-1] == doc[1:]) if len(doc) else np.zeros(0, np.int64)
    both = minima.copy(order="K")
    both[followed] = np.minimum(minima[followed], minima[followed + 1])
    return both, doc


Groups = dict[int, dict[int, "Partition | Lookup"]]


def _grouped(rows: list[tuple[int, str]], how: Method) -> Groups:
    return {length: {size: Partition(items, how) if size else Lookup(items, how) for size, items in by_size.items()} for length, by_size in _items(rows, how).items()}


def _held(groups: Groups, column: pa.Array, how: Method) -> Iterator[tuple[int, Item, int]]:
    """(row, item, common shingles) for every item that a text of ``column`` holds, by rows."""
    for texts in sh.text_slices(column):
        split = sh.words(texts, sh.letter_words())
        for length, by_size in groups.items():
            found = sh.shingles(split, length)
            for size, part in by_size.items():
                if isinstance(part, Lookup):
                    proposed = part.matches(found.hashes, found.first)
                else:
                    values, doc = _window_minima(found.hashes, found.first, size, how.hashes)
                    proposed = {(int(doc[w]), i) for w, i in part.matches(values)}
                for d, i in sorted(proposed):
                    if split.first[d + 1] - split.first[d] < length:
                        continue  # fewer words than a shingle make a shingle of another kind
                    item = part.items[i]
                    inside = int(np.isin(item.shingles, found.hashes[found.first[d] : found.first[d + 1]]).sum())
                    if 100 * inside >= how.percent * len(item.shingles):
                        yield texts.first + d, item, inside


def _search(docs: DataFrame, rows: list[tuple[int, str]], how: Method) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_grouped(rows, how))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            out = [(ids[row].as_py(), item.item_id, len(item.shingles), inside) for row, item, inside in _held(shared.value, batch.column("text"), how)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_item", "n_shared"])

    return docs.mapInArrow(search, "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint")


def _blocks(benchmark: DataFrame, how: Method) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``how.block_items`` and 16 MB of text."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    items = items.dropDuplicates(["item_id", "text"])
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // how.block_items), -(-size // (16 << 20)))
    for block in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r.item_id, r.text) for r in some.collect()]


def without_items(docs: DataFrame, benchmark: DataFrame, how: Method = Method()) -> DataFrame:
    """The rows of ``docs`` whose ``text`` holds no item of ``benchmark`` (see ``contained_items``), with all their columns.

    Each row is judged by its own text, whatever its doc_id or other columns; a missing text holds nothing. Nothing is shuffled.
    """
    for rows in _blocks(benchmark, how):
        shared = docs.sparkSession.sparkContext.broadcast(_grouped(rows, how))

        def choose(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[row for row, _, _ in _held(shared.value, batch.column("text"), how)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(choose, docs.schema)
    return docs


def contained_items(docs: DataFrame, benchmark: DataFrame, how: Method = Method()) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item that a document holds.

    A document (doc_id, text) holds an item (item_id, text) if it has at least ``how.percent`` of the item's shingles of
    lower-cased words; words are runs of letters, digits and what lies beyond ASCII. An item with fewer words than a shingle
    has to occur as a whole. Items or documents without words, missing texts, and items without id match nothing; documents
    that repeat or lack a doc_id are searched like any other. Other columns are ignored.

    The documents are read once and not shuffled; the items are the queries and go to every task in blocks of at most
    ``how.block_items`` and 16 MB of text, one pass for each block.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = [_search(docs, rows, how) for rows in _blocks(benchmark, how)]
    return reduce(DataFrame.unionByName, found).withColumn("containment", F.col("n_shared") / F.col("n_item"))

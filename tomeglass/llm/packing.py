"""Packing of token sequences by best-fit decreasing into windows of a fixed size."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the pre-tokeniser of byte-level BPE

# Pieces with their ids that a task holds before it hands them on.
HELD_PIECES = 512


@cache
def byte_level_encoder(path: str):
    """A function from a text to its ids, equal to those of the byte-level BPE tokenizer in the JSON file at ``path``.

    The merges of such a file are a ranking of byte strings, and a ranking can be applied several times faster than
    by the file's own library. Files of another kind, and files whose merges do not follow the ids, go to that library.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model, added = spec["model"], spec["added_tokens"]
    pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    ids = [model["vocab"].get(p, -1) for p in pairs]
    simple = spec["normalizer"] is None and spec["pre_tokenizer"] == plain and model["type"] == "BPE" and not model.get("dropout")
    simple = simple and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    if not (simple and ids == sorted(ids) and len(set(ids)) == len(model["vocab"]) - 256):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    import tiktoken

    # Printable bytes stand for themselves, the others for the code points from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: fast.encode_to_numpy(text, allowed_special="all")


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each piece, longest first, each into the tightest open window that holds it.

    A segment tree over remaining capacities 0 to ``window`` knows which capacities have an open window; the leftmost such
    capacity from the length on is the tightest fit, found by going up and down the tree once.
    """
    size = 1 << int(window).bit_length()
    any_open = [False] * (2 * size)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]

    def mark(capacity: int, state: bool) -> None:
        node = size + capacity
        any_open[node] = state
        while node > 1:
            node >>= 1
            state = any_open[2 * node] or any_open[2 * node + 1]
            if any_open[node] == state:
                return
            any_open[node] = state

    def tightest(length: int) -> int:
        node = size + length
        while not any_open[node]:
            while node & 1:
                node >>= 1
            if node == 0:
                return -1
            node += 1
        while node < size:
            node *= 2
            node += not any_open[node]
        return node - size

    windows, offsets, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        capacity = tightest(length)
        if capacity < 0:
            capacity, number = window, opened
            opened += 1
        else:
            number = open_at[capacity].pop()
            if not open_at[capacity]:
                mark(capacity, False)
        windows[piece], offsets[piece] = number, window - capacity
        left = capacity - length
        if left:
            if not open_at[left]:
                mark(left, True)
            open_at[left].append(number)
    return windows, offsets


def token_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, spread[, ids]): the ids of ``docs`` (doc_id, text) cut into pieces.

    Overlong documents are cut into full windows first, the rest is one shorter piece. ``spread`` is a number that deals
    pieces out evenly and is the same when a task runs again.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(tokenizer)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        number = 0
        types = {"ids": pa.list_(pa.int32())}
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread", *(["ids"] if with_ids else [])]
        rows = {name: [] for name in names}

        def take() -> pa.RecordBatch:
            taken = pa.record_batch([pa.array(rows[n], types.get(n, pa.int64())) for n in names], names)
            for held in rows.values():
                held.clear()
            return taken

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                doc_id, ids = doc_id.as_py(), np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    number += 1
                    spread = zlib.crc32(b"%d %d" % (task, number))
                    for name, value in zip(names, (doc_id, start, len(piece), zlib.crc32(piece), len(ids), spread, piece)):
                        rows[name].append(value)
                    if len(rows["doc_id"]) == HELD_PIECES:
                        yield take()
        yield take()

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, spread bigint"
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, group_rows: int = 10_000, with_ids: bool = True) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with ``sequence_id`` and ``offset``: every id lies in exactly one piece.

    A document is its ids by ``tokenizer`` (a file that every executor can read) and ``end_id``; a missing text is an empty
    one. Pieces are dealt evenly into groups of at most about ``group_rows``, whatever their doc_id, and each group is packed on
    its own, so that a task never holds more than a group, however long the documents are; at that size the padding of
    best-fit decreasing is well below one percent. How many pieces there can be follows from the bytes, as a token has one at least. Sequences are as long as their pieces, so whoever pads them needs no further length.
    Rows that repeat or lack a doc_id are packed like any other. Other columns are ignored.
    """
    most = F.sum(F.octet_length(F.coalesce("text", F.lit(""))) / window + 1)
    groups = max(1, math.ceil((docs.agg(most).first()[0] or 0) / group_rows))
    pieces = token_pieces(docs, tokenizer, window, end_id, with_ids)
    pieces = pieces.withColumn("group", F.pmod("spread", F.lit(groups))).drop("spread")
    names = [f.name for f in pieces.schema if f.name != "group"]

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])  # whatever order they came in
        windows, offsets = best_fit(rows.column("length").to_numpy(), window)
        group = rows.column("group")[0].as_py()
        return rows.select(names).append_column("sequence_id", pa.array((group << 32) + windows)).append_column("offset", pa.array(offsets))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "group")
    return pieces.groupBy("group").applyInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, used) from pieces with their ids, padded to ``window`` unless the length is a power of two."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(placed, lambda p: p["ids"])).alias("ids"))
    used = F.size("ids")
    even = used.bitwiseAND(used - 1) == 0
    padding = F.array_repeat(F.lit(pad_id), F.when(even, 0).otherwise(window - used))
    return whole.select("sequence_id", F.concat("ids", padding).alias("ids"), used.cast("bigint").alias("used"))

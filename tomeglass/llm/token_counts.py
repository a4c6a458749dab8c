"""Token counts of documents without making their ids: pieces are counted once per distinct pre-token."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeglass.session import cut_lineage

FREQUENT = 100_000
FREQUENT_BYTES = 64
HELD = 300_000


@cache
def tokenizer_from(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _used(docs: DataFrame) -> DataFrame:
    """(token, n): distinct pre-tokens of the whole corpus and how often they occur; added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in batch.column("text").cast(pa.large_binary()):
                held.update((text.as_py() or b"").split())
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        yield rows()

    return docs.select("text").mapInArrow(count, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _pieces(used: DataFrame, path: str) -> DataFrame:
    """(token, n, pieces): the number of ids of each pre-token."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_from(path)
        for batch in batches:
            tokens = batch.column("token").cast(pa.string()).to_pylist()
            pieces = []
            for begin in range(0, len(tokens), 2000):
                found = tokenizer.encode_batch_fast(tokens[begin : begin + 2000], add_special_tokens=False)
                pieces += [len(e.ids) for e in found]
            yield batch.append_column("pieces", pa.array(pieces, pa.int64()))

    return used.mapInArrow(encode, "token binary, n bigint, pieces bigint")


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    ``path`` is a tokenizer file whose pre-tokens hold no white space, so a run without ASCII white space is tokenized alone
    as it is within its text; such runs are the pre-tokens here. Their pieces are counted once each over the whole corpus
    and joined to the frequencies in each document. The commonest short ones, at most ``FREQUENT``, go to
    every task, where their share of a document is summed at once; only the rare rest is shuffled for the join, so that no
    common token makes a hot key. A missing text is an empty one. Rows that repeat or lack a doc_id are counted like any
    other. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = cut_lineage(_pieces(_used(docs), path))
    short = pieces.where(F.octet_length("token") <= FREQUENT_BYTES).withColumn("level", F.floor(F.log2("n") * 64))
    least, room = 1 << 20, FREQUENT
    for r in short.groupBy("level").agg(F.count("*").alias("size")).orderBy(F.desc("level")).collect():  # some thousand levels
        if r.size > room:
            break
        least, room = r.level, room - r.size
    common = short.where(F.col("level") >= least).select("token", "pieces").collect()
    known = docs.sparkSession.sparkContext.broadcast({bytes(r.token): r.pieces for r in common})

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of, task, row = known.value, TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for batch in batches:
            rows, sizes, sums, rest = [], [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                text = text.as_py() or b""
                total, rare = 0, []
                for token, n in Counter(text.split()).items():
                    found = pieces_of.get(token)
                    if found is None:
                        rare.append((token, n))
                    else:
                        total += n * found
                rows.append((task << 40) + row)
                row += 1
                sizes.append(len(text))
                sums.append(total)
                rest.append(rare)
            kind = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))
            rare = [[{"token": t, "n": n} for t, n in r] for r in rest]
            columns = [pa.array(rows, pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, kind)]
            yield pa.record_batch(columns, ["row", "doc_id", "n_bytes", "known", "rare"])

    schema = "row bigint, doc_id bigint, n_bytes bigint, known bigint, rare array<struct<token:binary,n:bigint>>"
    counted = cut_lineage(docs.mapInArrow(look_up, schema))
    rare = counted.select("row", F.explode("rare").alias("r")).select("row", F.col("r.token").alias("token"), F.col("r.n").alias("times"))
    rest = rare.join(pieces.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0))
    joined = counted.select("row", "doc_id", "n_bytes", "known").join(rest, "row", "left")
    return joined.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))

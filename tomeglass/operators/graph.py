"""A neighbour graph over vectors, and a search that walks it.

The graph starts from neighbours within random blocks and improves in rounds: whoever shares a neighbour is likely to be near. In a
round every vector meets the neighbours of its neighbours, forward and backward, as far as one of them is new, and keeps the
nearest. Lists have a fixed length on both sides, so no task ever holds more of the graph than its share of lists, and a vector that
is near to very many others does not make a hot list. A search goes from a few starts to the unvisited neighbours of its best
hits so far, all queries at once, one join a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeglass.functions import vectors as vx
from tomeglass.functions.joins import join_lookup
from tomeglass.operators import knn as kn
from tomeglass.operators import nearest as nn
from tomeglass.operators.ranking import best_per_group
from tomeglass.session import cut_lineage

EDGE = "doc_id bigint, neighbour bigint, d2 double"


@dataclass(frozen=True)
class Settings:
    """Neighbours of a vector, further ones by which it is met, rows of a first block, first blocks of a vector, greatest number of
    rounds, and the share of changed entries below which they end."""

    degree: int = 24
    backward: int = 16
    block_rows: int = 256
    starts: int = 2
    rounds: int = 8
    changed: float = 0.002


@dataclass(frozen=True)
class NeighbourGraph:
    """``edges`` (doc_id, neighbour, d2, rank), nearest first, between ``nodes`` (doc_id); ``ways`` (doc_id, others), where to go on from a
    node: its neighbours, and a bounded number of those it is a neighbour of, first those that hardly anyone leads to; ``copies`` (doc_id, copy_id): rows of an equal
    vector, which are not in the graph; ``vectors`` (doc_id, embedding); how many entries each round changed."""

    edges: DataFrame
    nodes: DataFrame
    ways: DataFrame
    copies: DataFrame
    vectors: DataFrame
    changes: list[int]


def _nearest_in_lists(lists: DataFrame, dim: int, degree: int) -> DataFrame:
    """Edges between members of each list (key, doc_id, embedding, last, fresh): at least one is fresh, and the edge is shorter than
    what one of them has for its last. Lists arrive one after the other and are bounded."""

    def meet(rows: pa.Table) -> dict[str, np.ndarray]:
        ids, fresh, last = rows["doc_id"].to_numpy(), rows["fresh"].to_numpy(), rows["last"].to_numpy()
        matrix = nn.as_matrix(rows["embedding"], dim)
        a, b = np.triu_indices(len(ids), 1)
        some = (fresh[a] | fresh[b]) & (ids[a] != ids[b])
        a, b = a[some], b[some]
        d2 = np.round(((matrix[a] - matrix[b]) ** 2).sum(axis=1), 9) if len(a) < 64 * len(ids) else np.round(nn.squared_distances(matrix, matrix)[a, b], 9)
        to_a, to_b = d2 < last[a], d2 < last[b]
        own, other, cost = np.concatenate([ids[a[to_a]], ids[b[to_b]]]), np.concatenate([ids[b[to_a]], ids[a[to_b]]]), np.concatenate([d2[to_a], d2[to_b]])
        # Of a long list only the nearest can stay.
        order = np.lexsort((other, cost, own))
        own, other, cost = own[order], other[order], cost[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        return {"doc_id": own[place < degree], "neighbour": other[place < degree], "d2": cost[place < degree]}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = table["key"].to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for begin, end in zip([0, *cuts[:-1]], cuts):
                yield pa.RecordBatch.from_pydict(meet(table.slice(begin, end - begin)))
            held = table.slice(cuts[-1] if len(cuts) else 0).combine_chunks()
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_pydict(meet(held))

    return lists.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(compare, EDGE)


def _best(edges: DataFrame, degree: int) -> DataFrame:
    unique = edges.groupBy("doc_id", "neighbour").agg(F.min("d2").alias("d2"), F.min("fresh").alias("fresh"))
    return best_per_group(unique, ["doc_id"], [F.asc("d2"), F.asc("neighbour")], degree)


def build_graph(vectors: DataFrame, dim: int, how: Settings = Settings()) -> NeighbourGraph:
    """The approximate ``degree`` nearest neighbours of each of ``vectors`` (doc_id, embedding); ids are unique.

    Equal vectors are one node, the one with the lowest doc_id. Vectors that are missing are left out, one of another dimension
    is an error. What is compared follows from hashes of ids and vectors alone, so the result does not depend on the partitioning.
    """
    stored = kn._stored(vectors, dim)
    nodes = cut_lineage(kn._lowest_copies(stored, 1).select("doc_id", "embedding"))
    keyed = stored.select("doc_id", F.xxhash64("embedding").alias("a"), F.xxhash64("embedding", F.lit(1)).alias("b"))
    groups = cut_lineage(keyed.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    further = join_lookup(keyed, groups.select("a", "b", "first"), ["a", "b"], groups).where("doc_id <> first")
    copies = cut_lineage(further.select(F.col("first").alias("doc_id"), F.col("doc_id").alias("copy_id")))
    n = nodes.count()

    blocks = max(1, -(-n // how.block_rows))
    first = F.posexplode(F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(s)), F.lit(blocks)) for s in range(how.starts)])).alias("start", "block")
    lists = nodes.select("doc_id", "embedding", first).select(
        (F.col("start") * blocks + F.col("block")).cast("bigint").alias("key"), "doc_id", "embedding", F.lit(float("inf")).alias("last"), F.lit(True).alias("fresh")
    )
    edges = cut_lineage(_best(_nearest_in_lists(lists, dim, how.degree).withColumn("fresh", F.lit(True)), how.degree))
    changes: list[int] = []
    while len(changes) < how.rounds:
        met = _nearest_in_lists(_meetings(edges, nodes, how), dim, how.degree)
        known = edges.select("doc_id", "neighbour", "d2", F.lit(False).alias("fresh"))
        # An entry that was there is not fresh: the least of false and true.
        edges = cut_lineage(_best(known.unionByName(met.withColumn("fresh", F.lit(True))), how.degree))
        changes.append(edges.where("fresh").count())
        if changes[-1] <= how.changed * n * how.degree:
            break
    return NeighbourGraph(edges.select("doc_id", "neighbour", "d2", "rank"), nodes.select("doc_id"), _ways(edges, how), copies, stored, changes)


def _ways(edges: DataFrame, how: Settings) -> DataFrame:
    incoming = edges.groupBy(F.col("neighbour").alias("doc_id")).agg(F.count("*").alias("n"))
    turned = edges.join(incoming, "doc_id", "left").select(F.col("neighbour").alias("doc_id"), F.col("doc_id").alias("other"), F.coalesce("n", F.lit(0)).alias("n"), "d2")
    backward = best_per_group(turned, ["doc_id"], [F.asc("n"), F.asc("d2"), F.asc("other")], how.backward)
    both = edges.select("doc_id", F.col("neighbour").alias("other")).unionByName(backward.select("doc_id", "other"))
    return cut_lineage(both.groupBy("doc_id").agg(F.collect_set("other").alias("others")))


def _meetings(edges: DataFrame, nodes: DataFrame, how: Settings) -> DataFrame:
    """Lists (key, doc_id, embedding, last, fresh): each node's neighbours, and those it is a neighbour of, as many as
    ``backward``, fresh ones first and then by hash."""
    forward = edges.select(F.col("doc_id").alias("key"), F.col("neighbour").alias("member"), "fresh")
    turned = edges.select(F.col("neighbour").alias("key"), F.col("doc_id").alias("member"), "fresh")
    some = best_per_group(turned, ["key"], [F.desc("fresh"), F.xxhash64("key", "member")], how.backward).drop("rank")
    own = edges.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("member"), F.lit(False).alias("fresh")).distinct()
    lists = forward.unionByName(some).unionByName(own).groupBy("key", "member").agg(F.max("fresh").alias("fresh"))
    # A list without a fresh member has met before.
    alive = lists.withColumn("any", F.max("fresh").over(Window.partitionBy("key"))).where("any")
    last = edges.groupBy("doc_id").agg(F.when(F.count("*") == how.degree, F.max("d2")).otherwise(F.lit(float("inf"))).alias("last"))
    known = nodes.join(last, "doc_id", "left").select(F.col("doc_id").alias("member"), "embedding", F.coalesce("last", F.lit(float("inf"))).alias("last"))
    # A node is a member of as many lists as it has neighbours on both sides; one that very many have for theirs is sought out in parts.
    counts = alive.groupBy("member").agg(F.count("*").alias("n"))
    return join_lookup(alive.select("key", "member", "fresh"), known, ["member"], counts).select("key", F.col("member").alias("doc_id"), "embedding", "last", "fresh")


@dataclass(frozen=True)
class Walk:
    """Hits kept while walking, hits followed in one step, starts of a query, and the greatest number of steps."""

    beam: int = 64
    followed: int = 16
    starts: int = 32
    steps: int = 24


def search_graph(graph: NeighbourGraph, queries: DataFrame, dim: int, k: int = kn.HITS, exclude_self: bool = False, digits: int = 6, how: Walk = Walk()) -> DataFrame:
    """Hits (query_id, rank, doc_id, d2, score) for ``queries`` (query_id, embedding), by walking the graph from hashed starts.

    A step follows the ``followed`` nearest of the ``beam`` best nodes of a query that it has not followed yet. The walk ends when no
    query has one left, or after ``steps``. Distances are exact; which neighbours are found is approximate.
    """
    asked = cut_lineage(kn._asked(queries, dim))
    vectors = graph.vectors
    starts = graph.nodes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.starts).collect()
    listed = F.array(*[F.lit(r.doc_id) for r in starts]).cast("array<bigint>")
    fresh = asked.select("query_id", F.explode(listed).alias("doc_id"))
    seen, best = fresh, None
    for _ in range(how.steps):
        # Nodes that many queries reach make narrow rows, and Spark splits such a key at run time.
        near = fresh.join(vectors, "doc_id")
        both = near.join(asked.withColumnRenamed("embedding", "asked"), "query_id")
        found = both.select("query_id", "doc_id", F.round(vx.squared_l2(F.col("asked"), F.col("embedding")), digits).alias("cost"), F.lit(False).alias("done"))
        ranked = best_per_group(found if best is None else best.unionByName(found), ["query_id"], [F.asc("cost"), F.asc("doc_id")], how.beam).drop("rank")
        open_place = F.row_number().over(Window.partitionBy("query_id", "done").orderBy("cost", "doc_id"))
        state = cut_lineage(ranked.withColumn("now", ~F.col("done") & (open_place <= how.followed)))
        following = state.where("now").select("query_id", "doc_id")
        if following.isEmpty():
            break
        best = state.select("query_id", "doc_id", "cost", (F.col("done") | F.col("now")).alias("done"))
        reached = following.join(graph.ways, "doc_id").select("query_id", F.explode("others").alias("doc_id")).distinct()
        fresh = cut_lineage(reached.join(seen, ["query_id", "doc_id"], "left_anti"))
        seen = seen.unionByName(fresh)
    hits = state.select("query_id", "doc_id", "cost")
    # Rows of an equal vector lie as near.
    reach = k + 1 if exclude_self else k
    lowest = best_per_group(graph.copies, ["doc_id"], [F.asc("copy_id")], reach).groupBy("doc_id").agg(F.collect_list("copy_id").alias("copies"))
    copies = join_lookup(hits, lowest, ["doc_id"], hits.groupBy("doc_id").agg(F.count("*").alias("n"))).select("query_id", F.explode("copies").alias("doc_id"), "cost")
    hits = hits.unionByName(copies)
    return kn._ranked(hits.where("query_id <> doc_id") if exclude_self else hits, k, digits)

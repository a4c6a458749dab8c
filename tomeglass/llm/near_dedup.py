"""Near duplicates by MinHash bands, sequential Bayesian verification and exact comparison of shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeglass.llm import shingles as sh
from tomeglass.llm.components import components
from tomeglass.session import cut_lineage

# Nodes on each side of a tile, cells compared at once, and bytes of each side's values gathered at once.
TILE = 2048
CELLS = 1 << 22
GATHERED = 1 << 22


class Method(NamedTuple):
    """Words per shingle, least similarity in percent, MinHash bands and the chance at which a true link is given up.

    A pair of similarity 0.8 shares none of 32 bands of 5 values with a chance of 3 in a million. ``miss`` bounds the
    posterior chance that a pair dropped after a batch of ``batch`` values reaches the similarity. Nodes that stay apart from
    others in their keys are compared by ``fine`` further values of one byte each.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    band: int = 5
    batch: int = 32
    fine: int = 2048
    miss: float = 1e-4

    @property
    def hashes(self) -> int:
        return self.bands * self.band

    def least_matches(self, sizes: tuple[int, ...], limit: float) -> list[tuple[int, int]]:
        """(values compared, least matches): with fewer, a chance of ``limit`` per value has a posterior below ``miss``.

        The prior is uniform, so the posterior after m of n matches is a Beta distribution, and its upper tail at t is the
        chance of at most m successes in n + 1 trials of probability t.
        """
        out = []
        for n in sizes:
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                ways = math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                tail += math.exp(ways + m * math.log(limit) + (n + 1 - m) * math.log(1 - limit))
            out.append((n, m))
        return out

    def first_steps(self) -> list[tuple[int, int]]:
        return self.least_matches((*range(self.batch, self.hashes, self.batch), self.hashes), self.percent / 100)

    def fine_steps(self) -> list[tuple[int, int]]:
        """For values cut to one byte, which are also equal by chance."""
        limit = self.percent / 100
        return self.least_matches((self.fine // 4, self.fine // 2, self.fine), limit + (1 - limit) / 256)


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for texts in sh.text_slices(column):
        found = sh.shingles(sh.words(texts, sh.plain_words(True)), size)
        for begin, end in zip(found.first[:-1], found.first[1:]):
            yield np.unique(found.hashes[begin:end])


def _node(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def _signed(docs: DataFrame, how: Method) -> DataFrame:
    """(doc_id, n, node, sig): size, 128-bit key and MinHash values of a text's shingle set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column("text"), how.shingle))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            sigs = [b""] * len(sets)
            if len(full):
                begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                minima = np.ascontiguousarray(sh.block_minima(np.concatenate([sets[i] for i in full]), begins, how.hashes))
                for i, row in zip(full, minima):
                    sigs[i] = row.tobytes()
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n": sizes,
                    "node": pa.array([_node(s) for s in sets], pa.binary()),
                    "sig": pa.array(sigs, pa.binary()),
                }
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        sign, "doc_id bigint, n bigint, node binary, sig binary"
    )


def _stars(members: DataFrame) -> DataFrame:
    """(key, band, node) with the hub of each key; the hub itself is one of the rows.

    The hub is the node with the most neighbours over all its keys, of equals the greatest. In a group of edited copies that
    is the one nearest to all others, so one comparison each finds most links.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    met = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("met"))
    weighed = members.join(met, "node")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("met", "node")).alias("top")).select("key", F.col("top.node").alias("hub"))
    return members.join(hubs, "key")


def _likely(pairs: DataFrame, sigs: DataFrame, how: Method) -> DataFrame:
    """Pairs (a, b) that no batch of MinHash values rules out."""
    steps = how.first_steps()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, how.hashes) for c in ("sig_a", "sig_b")
            )
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:
                matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                keep = matches >= least
                alive, matches, done = alive[keep], matches[keep], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    of = lambda end: sigs.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sig_a", "sig_b").mapInArrow(compare, "a binary, b binary")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, how: Method) -> DataFrame:
    """(node, set) of the wanted nodes (node, doc_id), made anew from one text each instead of being kept for all."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column("text"), how.shingle))
            nodes = batch.column("node").to_pylist()
            same = [i for i, s in enumerate(sets) if _node(s) == nodes[i]]
            for begin in range(0, len(same), 256):
                some = same[begin : begin + 256]
                yield pa.record_batch(
                    {"node": pa.array([nodes[i] for i in some], pa.binary()), "set": pa.array([sets[i].tobytes() for i in some], pa.binary())}
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id")
    return texts.select("node", "text").mapInArrow(make, "node binary, set binary").dropDuplicates(["node"])


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, both): exact sizes of intersection and union of the shingle sets of each pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inter, union = [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                inter.append(len(np.intersect1d(x, y, assume_unique=True)))
                union.append(len(x) + len(y) - inter[-1])
            yield pa.record_batch(
                {"a": batch.column("a"), "b": batch.column("b"), "inter": pa.array(inter, pa.int64()), "both": pa.array(union, pa.int64())}
            )

    of = lambda end: sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(compare, "a binary, b binary, inter bigint, both bigint")


def _unsettled(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, band, node, label, main, n, n_other) of the keys whose nodes are not one component; main: that of the hub."""
    label = F.coalesce("label", "node").alias("label")
    hub_label = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    rows = stars.join(labels, "node", "left").join(hub_label, "hub", "left")
    rows = rows.select("key", "band", "node", label, (label == F.coalesce("hub_label", "hub")).alias("main"))
    # In a key of two nodes their pair has been compared.
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum((~F.col("main")).cast("long")).alias("n_other"))
    return rows.join(counts.where("n > 2 and n_other > 0"), "key")


def _fine(sets: DataFrame, how: Method) -> DataFrame:
    """(node, fine): further MinHash values of sets, one byte each."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                own = [np.frombuffer(s.as_buffer(), np.uint64) for s in part.column("set")]
                begins = np.concatenate([[0], np.cumsum([len(s) for s in own])[:-1]])
                values = np.ascontiguousarray(sh.block_minima(np.concatenate(own), begins, how.fine, seed=13).astype(np.uint8))
                yield pa.record_batch([part.column("node"), pa.array([v.tobytes() for v in values], pa.binary())], ["node", "fine"])

    return sets.mapInArrow(sign, "node binary, fine binary")


def _compared(signature: np.ndarray, i: np.ndarray, j: np.ndarray, what: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``what`` of where the rows ``i`` and ``j`` of a signature are equal, for each pair; some pairs at a time, however many there are."""
    step = max(1, GATHERED // (signature.shape[1] * signature.itemsize))
    parts = [what(signature[i[k : k + step]] == signature[j[k : k + step]]) for k in range(0, max(len(i), 1), step)]
    return np.concatenate(parts)


def _met(tile: pa.Table, how: Method, best: int | None) -> Iterator[pa.RecordBatch]:
    """Likely pairs (a, b) of a tile's left and right nodes in different components, some left nodes at a time."""
    steps, fine_steps = how.first_steps(), how.fine_steps()
    side, band = tile.column("side").to_numpy(), tile.column("band")[0].as_py()
    nodes, names = np.array(tile.column("node").to_pylist(), object), np.array(tile.column("label").to_pylist(), object)
    number = {name: i for i, name in enumerate(dict.fromkeys(names))}
    of = np.array([number[name] for name in names])
    values = np.frombuffer(b"".join(tile.column("sig").to_pylist()), np.uint32).reshape(-1, how.hashes)
    fine = np.frombuffer(b"".join(tile.column("fine").to_pylist()), np.uint8).reshape(-1, how.fine)
    lefts, rights = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    at_once = max(1, CELLS // (how.batch * max(len(rights), 1)))
    for begin in range(0, len(lefts), at_once):
        some = lefts[begin : begin + at_once]
        i, j = np.nonzero(of[some][:, None] != of[rights][None, :])
        i, j = some[i], rights[j]
        for signature, stages in ((values, steps), (fine, fine_steps)):
            matches, done = 0, 0
            for n, least in stages:
                matches = matches + _compared(signature[:, done:n], i, j, lambda equal: equal.sum(axis=1))
                alive = matches >= least
                i, j, matches, done = i[alive], j[alive], matches[alive], n
        # A pair that shares several keys is reported by the first of them alone.
        first = _compared(values, i, j, lambda equal: equal.reshape(len(equal), how.bands, how.band).all(axis=2).argmax(axis=1) == band)
        i, j, matches = i[first], j[first], matches[first]
        if best:
            order = np.lexsort((-matches, i))
            i, j = i[order], j[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[nth < best], j[nth < best]
        pairs = sorted({(min(a, b), max(a, b)) for a, b in zip(nodes[i], nodes[j])})
        yield pa.record_batch([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], ["a", "b"])


def _across(unsettled: DataFrame, sigs: DataFrame, how: Method, best: int | None) -> DataFrame:
    """Pairs (a, b) of nodes in one key but two components that no batch of MinHash values rules out.

    Every node outside the hub's component meets all nodes of other components. Both sides are cut into blocks of about
    ``TILE`` nodes, each pair of blocks is compared as a matrix inside a task, and only what passes leaves it: all of it, or
    the ``best`` of each node.
    """
    blocks = lambda n: F.ceil(F.col(n) / TILE)
    rows = unsettled.join(sigs, "node")
    rows = rows.select("key", "band", "node", "label", "main", "sig", "fine", blocks("n").alias("n_right"), blocks("n_other").alias("n_left"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = rows.where("not main").withColumn("l", own("n_left")).withColumn("r", every("n_right")).withColumn("side", F.lit(0))
    right = rows.withColumn("r", own("n_right")).withColumn("l", every("n_left")).withColumn("side", F.lit(1))
    tiles = left.unionByName(right).select("key", "l", "r", "side", "band", "node", "label", "sig", "fine")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile; a tile may run over several batches."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            at = np.stack([table.column(c).to_numpy() for c in ("key", "l", "r")])
            cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts[:-1]], cuts):
                yield from _met(table.slice(begin, end - begin), how, best)
            held = table.slice(cuts[-1] if len(cuts) else 0).combine_chunks().to_batches()
        if held:
            yield from _met(pa.Table.from_batches(held), how, best)

    dealt = tiles.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r", "side", "node")
    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, how: Method = Method()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two texts are linked if their sets of shingles reach ``how.percent``; ``component_id`` is the least doc_id that links
    lead to, and ``kept`` marks that document. Texts without words are linked with nothing.

    Equal sets are one node. In each band key one node, the hub, is compared with the others, so a group of copies costs as
    many comparisons as it has members. Only keys whose nodes are not one component then go on: first the likeliest pairs
    across components are verified, which joins most of what belongs together, then all that are left. No link is lost but
    for the stated chances, and pairs within a component are not compared.

    Rows without doc_id have no links, a null ``component_id`` and are kept. Rows that share a doc_id are judged by their
    own texts. Other columns are ignored. An empty table gives an empty result.
    """
    signed = cut_lineage(_signed(docs, how))
    real = signed.where("n > 0 and doc_id is not null")
    nodes = real.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    width = 4 * how.band
    band_keys = F.expr(f"transform(sequence(0, {how.bands - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))")
    keyed = real.select("node", F.posexplode(band_keys).alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key")
    members = cut_lineage(keyed.join(shared, "key").distinct())
    stars = cut_lineage(_stars(members))
    active = members.select("node").distinct()
    sigs = cut_lineage(real.select("node", "sig").dropDuplicates(["node"]).join(active, "node"))
    sets = cut_lineage(_shingle_sets(docs, nodes.join(active, "node"), how))

    similar = F.expr(f"100 * inter >= {how.percent} * both")
    spokes = stars.where("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    checked = cut_lineage(_measured(_likely(spokes, sigs, how), sets))
    labels = components(checked.where(similar).select("a", "b"))
    finer = None
    for best in (3, None):
        unsettled = cut_lineage(_unsettled(stars, labels))
        if unsettled.isEmpty():
            break
        if finer is None:
            finer = cut_lineage(sigs.join(_fine(sets.join(unsettled.select("node").distinct(), "node"), how), "node"))
        pairs = _across(unsettled, finer, how, best).join(checked.select("a", "b"), ["a", "b"], "left_anti")
        found = cut_lineage(_measured(pairs, sets))
        checked = checked.unionByName(found)
        known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = components(known.unionByName(found.where(similar).select("a", "b")))

    of_node = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of_node.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = of_node.join(least, "label").select("node", "component_id")
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.expr("n > 0 and doc_id is not null"), F.col("node")).alias("node"))
    component = F.coalesce("component_id", "doc_id")
    return rows.join(of_node, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )

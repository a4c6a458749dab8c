"""Nearest neighbours through short codes: a scan of codes with a running bound, and exact distances of what survives.

A vector is stored as its cell and, for every two values of its difference from the cell's centre, the number of the nearest of 256
learnt pairs, with the length of what the code leaves out. From a code follow bounds of the squared distance to a query. What lies
beyond the k-th best so far, but for a chosen small chance, is dropped while scanning; the rest is compared by its full vector, so
every distance that is returned is exact.

The codes of 64 values of a vector take 32 bytes, an eighth of the vector. Queries may be confined to their nearest cells;
``probes_for`` measures how many cells hold a wanted share of the true neighbours. Rows with equal vectors are coded once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeglass.functions import vectors as vx
from tomeglass.functions.joins import join_lookup
from tomeglass.operators import knn as kn
from tomeglass.operators import nearest as nn
from tomeglass.operators.ranking import best_per_group
from tomeglass.session import cut_lineage, spread

LEVELS = 256
WIDTH = 2
STEPS = 4
# The chance that a neighbour is dropped for another vector.
MISS = 1e-6
SLICE_ROWS = 4096
HELD = 2_000_000
# Codes that are sent to a task together: short, and the more there are, the fewer candidates survive.
BAND_CODES = 1 << 20

CANDIDATE = "query_id bigint, doc_id bigint, low double, high double, best boolean"


@dataclass(frozen=True)
class Quantiser:
    """Centres of cells (cells, dim), and for each part of a difference its levels (parts, levels, width)."""

    centres: np.ndarray
    levels: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """(rows, parts, width), filled up with zeros at the end."""
        parts, _, width = self.levels.shape
        out = np.zeros((len(rows), parts * width))
        out[:, : self.dim] = rows
        return out.reshape(len(rows), parts, width)

    def nearest_levels(self, rows: np.ndarray) -> np.ndarray:
        parts = self.parts(rows)
        out = np.empty(parts.shape[:2], np.uint8)
        for p in range(parts.shape[1]):
            out[:, p] = np.round(nn.squared_distances(parts[:, p], self.levels[p]), 12).argmin(axis=1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The differences from the centre that codes (rows, parts) stand for."""
        return self.levels[np.arange(codes.shape[1])[None, :], codes].reshape(len(codes), -1)[:, : self.dim]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code and length of the remainder of each row."""
        if not len(rows):
            return np.zeros(0, np.int32), np.zeros((0, len(self.levels)), np.uint8), np.zeros(0)
        cell = np.round(nn.squared_distances(rows, self.centres), 9).argmin(axis=1).astype(np.int32)
        difference = rows - self.centres[cell]
        codes = self.nearest_levels(difference)
        return cell, codes, np.sqrt(((difference - self.decode(codes)) ** 2).sum(axis=1))


def _slices(rows: np.ndarray) -> Iterator[np.ndarray]:
    for begin in range(0, len(rows), SLICE_ROWS):
        yield rows[begin : begin + SLICE_ROWS]


def train(vectors: DataFrame, dim: int, centres: np.ndarray, width: int = WIDTH, steps: int = STEPS) -> Quantiser:
    """Levels by ``steps`` of k-means over all vectors, from the ``LEVELS`` vectors that come first by hash.

    Each step adds up the rows of every task per level and hands the driver ``LEVELS`` rows per part.
    """
    stored = kn._stored(vectors, dim)
    first = nn.as_matrix(stored.orderBy(F.xxhash64("embedding"), "doc_id").limit(LEVELS).toArrow()["embedding"], dim)
    found = Quantiser(centres, np.zeros((-(-dim // width), 1, width)))
    if not len(first):
        return found
    cell = nn.squared_distances(first, centres).argmin(axis=1)
    found = Quantiser(centres, np.round(found.parts(first - centres[cell]).transpose(1, 0, 2), 9))
    for _ in range(steps):
        shared = vectors.sparkSession.sparkContext.broadcast(found)

        def add_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            quantiser = shared.value
            n, sums = np.zeros(quantiser.levels.shape[:2], np.int64), np.zeros(quantiser.levels.shape)
            for batch in batches:
                for rows in _slices(nn.as_matrix(batch.column("embedding"), dim)):
                    near = np.round(nn.squared_distances(rows, quantiser.centres), 9).argmin(axis=1)
                    difference = rows - quantiser.centres[near]
                    codes, parts = quantiser.nearest_levels(difference), quantiser.parts(difference)
                    for p in range(parts.shape[1]):
                        n[p] += np.bincount(codes[:, p], minlength=n.shape[1])
                        for w in range(width):
                            sums[p, :, w] += np.bincount(codes[:, p], parts[:, p, w], n.shape[1])
            part, level = np.nonzero(n)
            columns = {"part": part, "level": level, "n": n[part, level], "sums": list(sums[part, level])}
            yield pa.RecordBatch.from_pydict(columns, pa.schema([("part", pa.int64()), ("level", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))]))

        added = stored.mapInArrow(add_up, "part bigint, level bigint, n bigint, sums array<double>")
        total = vector_to_array(Summarizer.sum(array_to_vector("sums")))
        levels = found.levels.copy()
        for r in added.groupBy("part", "level").agg(F.sum("n").alias("n"), total.alias("sums")).collect():
            levels[r.part, r.level] = np.round(np.array(r.sums) / r.n, 9)
        found = Quantiser(centres, levels)
    return found


# The index


@dataclass(frozen=True)
class VectorIndex:
    """``codes`` (cell, doc_id, code, error) of distinct vectors, sorted by cell; ``copies`` (doc_id, copy_id): further rows of the
    same vector, if there are any; ``vectors`` (doc_id, embedding): what they were made from; ``sizes``: codes per cell."""

    quantiser: Quantiser
    codes: DataFrame
    copies: DataFrame | None
    vectors: DataFrame
    sizes: np.ndarray

    @property
    def code_bytes(self) -> int:
        """Bytes of a code, with its remainder and id."""
        return len(self.quantiser.levels) + 12


def write_vector_index(vectors: DataFrame, path: str, dim: int, centres: np.ndarray | None = None, width: int = WIDTH, steps: int = STEPS) -> VectorIndex:
    """Code all of ``vectors`` (doc_id, embedding) below ``path``; without ``centres`` there is one cell around their mean.

    Rows without a vector are left out, one of another dimension is an error. Of equal vectors the one with the lowest doc_id is
    coded, and the others are listed as its copies.
    """
    stored, spark = kn._stored(vectors, dim), vectors.sparkSession
    if centres is None:
        mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))).alias("m")
        found = stored.groupBy(F.lit("all")).agg(mean).first()
        centres = np.round(np.array([found.m if found else np.zeros(dim)]), 9)
    quantiser = train(vectors, dim, centres, width, steps)
    shared = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.encode(rows) for rows in _slices(nn.as_matrix(batch.column("embedding"), dim))]
            for (cell, codes, error), begin in zip(found, range(0, len(batch), SLICE_ROWS)):
                ids = batch.column("doc_id").slice(begin, len(cell))
                yield pa.RecordBatch.from_arrays([pa.array(cell), ids, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["cell", "doc_id", "code", "error"])

    coded = kn._lowest_copies(stored, 1).mapInArrow(encode, "cell int, doc_id bigint, code binary, error double")
    # Blocks of a cell by id, so that a large cell is not the work of one task.
    coded.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(64))).sortWithinPartitions("cell", "doc_id").write.mode("overwrite").parquet(f"{path}/codes")
    keyed = stored.select("doc_id", F.xxhash64("embedding").alias("a"), F.xxhash64("embedding", F.lit(1)).alias("b"))
    groups = cut_lineage(keyed.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = join_lookup(keyed, groups.select("a", "b", "first"), ["a", "b"], groups).where("doc_id <> first")
    copies.select(F.col("first").alias("doc_id"), F.col("doc_id").alias("copy_id")).write.mode("overwrite").parquet(f"{path}/copies")
    rows = [("centre", i, c.tolist()) for i, c in enumerate(centres)] + [("levels", i, p.ravel().tolist()) for i, p in enumerate(quantiser.levels)]
    spark.createDataFrame(rows, "kind string, i int, row array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return read_vector_index(spark, path, vectors)


def read_vector_index(spark: SparkSession, path: str, vectors: DataFrame) -> VectorIndex:
    """The index below ``path``, with the ``vectors`` it was made from."""

    rows = sorted(spark.read.parquet(f"{path}/model").collect())
    centres, parts = (np.array([r.row for r in rows if r.kind == kind]) for kind in ("centre", "levels"))
    width = -(-centres.shape[1] // len(parts))
    quantiser = Quantiser(centres, parts.reshape(len(parts), -1, width))
    codes = spark.read.schema("cell int, doc_id bigint, code binary, error double").parquet(f"{path}/codes")
    copies = spark.read.schema("doc_id bigint, copy_id bigint").parquet(f"{path}/copies")
    sizes = np.zeros(len(centres), np.int64)
    for r in codes.groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]
    return VectorIndex(quantiser, codes, None if copies.isEmpty() else copies, kn._stored(vectors, quantiser.dim), sizes)


# Candidates


class Survivors:
    """Codes that may belong to one of the ``k`` nearest vectors of some queries, by what was seen so far.

    What a code leaves out has a known length e, and lies between -e and e along the way d to the query. In many dimensions it
    is spread over all of them, so that the error of a squared distance is normal with a deviation of 2de / sqrt(dim); a vector is
    dropped if that of two of them, of this vector and of one of the k best, would have to be greater than ``miss`` allows. In few
    dimensions, where that says less than the lengths do, only what is certain counts.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, miss: float, dim: int):
        self.query_ids, self.queries = query_ids, queries
        spread = NormalDist().inv_cdf(1 - miss) * np.sqrt(2 / dim)
        self.spread = 2 * spread if spread < 1 else None
        self.best = np.full((len(query_ids), k), np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, rows: np.ndarray, ids: np.ndarray, centre: np.ndarray, differences: np.ndarray, error: np.ndarray) -> None:
        """Compare the queries ``rows`` with vectors of one cell, given as differences from its centre."""
        width = max(1, min(len(ids), nn.CELLS))
        height = max(1, nn.CELLS // max(1, width))
        for left in range(0, len(ids), width):
            some = slice(left, left + width)
            for top in range(0, len(rows), height):
                self._tile(rows[top : top + height], ids[some], centre, differences[some], error[some])

    def _tile(self, rows: np.ndarray, ids: np.ndarray, centre: np.ndarray, differences: np.ndarray, error: np.ndarray) -> None:
        asked, bound = self.queries[rows] - centre, self.best[rows].max(axis=1, initial=-np.inf)
        if np.isfinite(bound).all() and len(ids):
            self._near(rows, ids, asked, differences, error, bound)
            return
        low, high = self._bounds(nn.squared_distances(asked, differences), error)
        best = np.concatenate([self.best[rows], high], axis=1)
        k = self.best.shape[1]
        self.best[rows] = np.partition(best, k - 1, axis=1)[:, :k]
        row, column = np.nonzero(low <= self.best[rows].max(axis=1, keepdims=True))
        self.held.append((rows[row], ids[column], low[row, column], high[row, column]))

    def _bounds(self, d2: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the squared distance is at least, and at most."""
        d = np.sqrt(d2)
        if self.spread is None:
            low, high = np.maximum(d - error, 0) ** 2, (d + error) ** 2
        else:
            low, high = d2 - error**2 - self.spread * d * error, d2 + error**2
        return low - 1e-9 * (1 + d2), high

    def _near(self, rows: np.ndarray, ids: np.ndarray, asked: np.ndarray, differences: np.ndarray, error: np.ndarray, bound: np.ndarray) -> None:
        """The same where all of ``rows`` have a bound: only codes that one product says may reach it are looked at."""
        most = error.max()
        if self.spread is None:
            reach = (most + np.sqrt(bound + 1e-9)) / (1 - 4e-5)
            row, column = nn.may_lie_within(asked, differences, reach**2 * (1 + 1e-9))
        else:
            # For any c, 2d is at most d² / c + c, which is close where c is near to d.
            c = np.median(self.spread * most + np.sqrt((self.spread * most) ** 2 + 4 * (bound + most**2))) / 2 + 1e-9
            factor = 1 - 1e-9 - self.spread * error / (2 * c)
            row, column = nn.may_lie_within(asked, differences, bound, factor, error**2 + self.spread * error * c / 2 + 1e-9)
        d2 = np.empty(len(row))
        step = max(1, nn.CELLS // asked.shape[1])
        for begin in range(0, len(row), step):
            some = slice(begin, begin + step)
            d2[some] = ((asked[row[some]] - differences[column[some]]) ** 2).sum(axis=1)
        low, high = self._bounds(d2, error[column])
        kept = low <= bound[row]
        row, column, low, high = row[kept], column[kept], low[kept], high[kept]
        k = self.best.shape[1]
        order = np.lexsort((high, row))
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        first = order[rank < k]
        nearer = np.full((len(rows), k), np.inf)
        nearer[row[first], rank[rank < k]] = high[first]
        self.best[rows] = np.partition(np.concatenate([self.best[rows], nearer], axis=1), k - 1, axis=1)[:, :k]
        kept = low <= self.best[rows].max(axis=1)[row]
        self.held.append((rows[row[kept]], ids[column[kept]], low[kept], high[kept]))

    def take(self) -> pa.RecordBatch:
        """What is held and lies within today's bound, and whether it is among the k best so far."""
        parts = self.held or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        row, ids, low, high = (np.concatenate(p) for p in zip(*parts))
        bound = self.best.max(axis=1, initial=-np.inf)[row] if len(row) else np.zeros(0)
        kept = low <= bound
        self.held = []
        columns = [self.query_ids[row[kept]], ids[kept], low[kept], high[kept], (high <= bound)[kept]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "doc_id", "low", "high", "best"])

    @property
    def full(self) -> bool:
        return sum(len(h[0]) for h in self.held) > HELD


def _codes(column: pa.Array | pa.ChunkedArray, parts: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _compare(survivors: Survivors, quantiser: Quantiser, cells: np.ndarray, visits: np.ndarray, ids: np.ndarray, codes: np.ndarray, error: np.ndarray) -> None:
    for cell in np.unique(cells):
        here, rows = np.flatnonzero(cells == cell), np.flatnonzero(visits[:, cell])
        if len(rows):
            survivors.add(rows, ids[here], quantiser.centres[cell], quantiser.decode(codes[here]), error[here])


def _scan(index: VectorIndex, gathered: pa.Table, route: kn.Route, reach: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """Few queries go to every task; only the row groups of visited cells are read."""
    spark, quantiser = index.codes.sparkSession, index.quantiser
    ids, matrix = nn.as_ids(gathered["query_id"]), nn.as_matrix(gathered["embedding"], quantiser.dim)
    visits = np.concatenate([route(rows) for rows in _slices(matrix)]) if len(ids) else np.zeros((0, len(index.sizes)), bool)
    shared = spark.sparkContext.broadcast((quantiser, ids, matrix, visits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, ids, matrix, visits = shared.value
        survivors = Survivors(ids, matrix, reach, miss, quantiser.dim)
        for batch in batches:
            if len(batch) and len(ids):
                codes = _codes(batch.column("code"), len(quantiser.levels))
                cells, error = batch.column("cell").to_numpy(), batch.column("error").to_numpy()
                _compare(survivors, quantiser, cells, visits, nn.as_ids(batch.column("doc_id")), codes, error)
                if survivors.full:
                    yield survivors.take()
        yield survivors.take()

    visited = [int(c) for c in np.flatnonzero(visits.any(axis=0))]
    read = index.codes if len(visited) == len(index.sizes) else index.codes.where(F.col("cell").isin(visited))
    work = [(c, int(index.sizes[c]), int(visits[:, c].sum())) for c in visited]
    # Codes are so short that a file of them is read in one task, which is little reading but all the comparing.
    return spread(read).mapInArrow(scan, CANDIDATE), spark.createDataFrame(work, "cell int, n bigint, visits bigint")


def _by_blocks(index: VectorIndex, queries: DataFrame, route: kn.Route, reach: int, miss: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Many queries meet the codes of the cells they visit in blocks of bounded size."""
    dim = index.quantiser.dim
    shared = queries.sparkSession.sparkContext.broadcast(index.quantiser)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        quantiser, none = shared.value, Survivors(np.zeros(0, np.int64), np.zeros((0, dim)), reach, miss, dim)
        ids, error = nn.as_ids(left["doc_id"]), left["error"].to_numpy()
        codes = _codes(left["code"], len(quantiser.levels))
        found = [none.take()]
        for part, cells_met in kn.in_blocks(left, right, block_rows):
            survivors = Survivors(nn.as_ids(part["query_id"]), nn.as_matrix(part["embedding"], dim), reach, miss, quantiser.dim)
            for cell, here, asking in cells_met:
                survivors.add(asking, ids[here], quantiser.centres[cell], quantiser.decode(codes[here]), error[here])
                if survivors.full:
                    found.append(survivors.take())
            found.append(survivors.take())
        return pa.Table.from_batches(found)

    return kn.blocks_of_cells(index.codes, queries, index.sizes, route, dim, ["doc_id", "code", "error"], compare, CANDIDATE, BAND_CODES)


# Search


@dataclass(frozen=True)
class CodeHits(kn.ApproximateHits):
    """Hits and work as of any approximate search, and the pairs whose full vectors were compared (query_id, doc_id)."""

    compared: DataFrame

    def bytes_share(self, index: VectorIndex) -> float:
        """Bytes of codes and vectors that were compared, in shares of those of all vectors of 4-byte values for every query."""
        dim = 4 * index.quantiser.dim
        scanned = self.work.agg(F.sum(F.col("n") * F.col("visits"))).first()[0] or 0
        asked = self.hits.select("query_id").distinct().count()
        return (scanned * index.code_bytes + self.compared.count() * dim) / max(1, index.vectors.count() * asked * dim)


def search(
    index: VectorIndex,
    queries: DataFrame,
    k: int = kn.HITS,
    probe: int | None = None,
    miss: float = MISS,
    exclude_self: bool = False,
    digits: int = 6,
    broadcast_bytes: int = kn.BROADCAST_BYTES,
    block_rows: int = kn.BLOCK_ROWS,
) -> CodeHits:
    """The ``k`` nearest vectors to each of ``queries`` (query_id, embedding) in its ``probe`` nearest cells, or in all.

    Within the visited cells a neighbour is lost with a chance of about ``miss``. The distances are exact; d2 is rounded, and equal
    ones rank by doc_id, as in ``knn``. Missing queries are left out, short ones filled up with zeros.
    """
    m = len(index.sizes)
    queries, reach = kn._asked(queries, index.quantiser.dim), k + 1 if exclude_self else k
    cells = kn.Cells(index.quantiser.centres, index.sizes, np.zeros(m), np.zeros(m), np.zeros((m, 1)))
    route = kn.ProbeRoute(cells, min(probe or m, m))
    few = min(kn.SCANNED, broadcast_bytes // (8 * (index.quantiser.dim + 2 * reach + 1) + m))
    gathered = queries.limit(few + 1).toArrow()
    if gathered.num_rows <= few:
        found, work = _scan(index, gathered, route, reach, miss)
    else:
        found, work = _by_blocks(index, queries, route, reach, miss, block_rows)
    found = cut_lineage(found)
    last = best_per_group(found.where("best"), ["query_id"], [F.asc("high"), F.asc("doc_id")], reach).groupBy("query_id")
    bound = last.agg(F.when(F.count("*") == reach, F.max("high")).otherwise(F.lit(float("inf"))).alias("bound"))
    pairs = found.join(bound, "query_id").where("low <= bound").select("query_id", "doc_id")
    if index.copies:
        # Of equal vectors only the lowest ids can be hits.
        pairs = cut_lineage(pairs)
        lowest = best_per_group(index.copies, ["doc_id"], [F.asc("copy_id")], reach).groupBy("doc_id").agg(F.collect_list("copy_id").alias("copies"))
        further = join_lookup(pairs, lowest, ["doc_id"], pairs.groupBy("doc_id").agg(F.count("*").alias("n")))
        pairs = pairs.unionByName(further.select("query_id", F.explode("copies").alias("doc_id")))
    if exclude_self:
        pairs = pairs.where("query_id <> doc_id")
    # Vectors that many queries have for a candidate make narrow rows, and Spark splits such a key at run time.
    near = pairs.join(index.vectors, "doc_id")
    both = near.join(queries.withColumnRenamed("embedding", "asked"), "query_id")
    hits = both.select("query_id", "doc_id", F.round(vx.squared_l2(F.col("asked"), F.col("embedding")), digits).alias("cost"))
    return CodeHits(kn._ranked(hits, k, digits), work, pairs)


def probes_for(index: VectorIndex, target: float, k: int = kn.HITS, sample: int = 256) -> int:
    """The fewest cells to visit that hold ``target`` of the true neighbours of at most ``sample`` stored vectors, the first by hash."""
    dim = index.quantiser.dim
    asked = index.vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "query_id")
    hits = kn.knn(index.vectors, asked, dim, k, exclude_self=True).select("query_id", "doc_id")
    near = hits.join(index.vectors, "doc_id").join(asked.withColumnRenamed("embedding", "asked"), "query_id").select("embedding", "asked").toArrow()
    if not near.num_rows:
        return 1
    centres = index.quantiser.centres
    own = np.round(nn.squared_distances(nn.as_matrix(near["embedding"], dim), centres), 9).argmin(axis=1)
    gaps = np.round(nn.squared_distances(nn.as_matrix(near["asked"], dim), centres), 9)
    place = np.argsort(np.argsort(gaps, axis=1, kind="stable"), axis=1)[np.arange(len(own)), own]
    share = np.cumsum(np.bincount(place, minlength=len(centres))) / len(place)
    return int(np.searchsorted(share, target - 1e-12)) + 1

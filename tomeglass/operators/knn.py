"""Nearest neighbours by squared L2 distance, for a batch of queries.

Two exact plans with the same result. A counted small set of queries goes to every task, and the vectors are scanned
where they lie. A larger set is joined cell by cell: vectors belong to the cell of their nearest pivot, a query visits
the cells that can hold one of its neighbours, as far as those found in its own cell tell. Cells and queries are dealt to bands of bounded size, a pair of which is a task,
and compared there in blocks. The approximate search uses the same cells and visits the nearest few.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeglass.functions import vectors as vx
from tomeglass.operators import nearest as nn
from tomeglass.operators.ranking import best_per_group
from tomeglass.session import cut_lineage

# Fixed value: hits per query.
HITS = 10

BROADCAST_BYTES = 64 << 20
# More queries than this meet the vectors cell by cell, however few bytes they take.
SCANNED = 1 << 14
# Pivots grow with the square root of the vectors between these.
PIVOTS = 256
MOST_PIVOTS = 2048
BLOCK_ROWS = 8192
# Rows of either side that are sent to a task together, and queries a task gets at least.
BAND_ROWS = 65536
LEAST_ROWS = 512
# Vectors of its own cell that a query's bound is taken from, and queries that meet them in a task.
BOUND_ROWS = 4096
SLACK = 1e-9


def dim_violations(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has not exactly ``dim`` values; a missing vector has none."""
    size = F.when(F.col("embedding").isNull(), 0).otherwise(F.size("embedding"))
    return vectors.select("doc_id", size.alias("dim")).where(F.col("dim") != dim)


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    dim: int,
    k: int = HITS,
    exclude_self: bool = False,
    digits: int = 6,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """Exact hits (query_id, rank, doc_id, d2, score) for vectors(doc_id, embedding), queries(query_id, embedding).

    A stored vector has to have ``dim`` values. A query with fewer is filled up with zeros, one with more is an error, and
    missing vectors and queries are left out. d2 is rounded before ranking and equal distances rank by doc_id.
    ``exclude_self`` leaves out the vector whose doc_id is the query_id.
    """
    vectors, queries = _stored(vectors, dim), _asked(queries, dim)
    few = min(SCANNED, broadcast_bytes // (8 * (dim + 2 * k + 1)))
    gathered = queries.limit(few + 1).toArrow()
    if gathered.num_rows <= few:
        hits = _scan(vectors, gathered, k, dim, digits, exclude_self)
    else:
        hits = _exact_by_cells(vectors, queries, k, dim, digits, exclude_self, block_rows, pivots)
    return _ranked(hits, k, digits)


def _stored(vectors: DataFrame, dim: int) -> DataFrame:
    present = vectors.where(F.col("embedding").isNotNull())
    return present.select(F.col("doc_id").cast("bigint"), vx.of_dimension(F.col("embedding"), dim).alias("embedding"))


def _asked(queries: DataFrame, dim: int) -> DataFrame:
    present = queries.where(F.col("embedding").isNotNull())
    return present.select(F.col("query_id").cast("bigint"), vx.filled_up(F.col("embedding"), dim).alias("embedding"))


def _ranked(hits: DataFrame, k: int, digits: int) -> DataFrame:
    best = best_per_group(hits.withColumnRenamed("cost", "d2"), ["query_id"], [F.asc("d2"), F.asc("doc_id")], k)
    score = F.round(vx.score_of(F.col("d2")), digits).alias("score")
    return best.select("query_id", "rank", "doc_id", "d2", score)


# Few queries: one pass over the vectors


def _scan(vectors: DataFrame, queries: pa.Table, k: int, dim: int, digits: int, exclude_self: bool) -> DataFrame:
    """Every partition reports its k nearest per query."""
    ids, matrix = nn.as_ids(queries["query_id"]), nn.as_matrix(queries["embedding"], dim)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = nn.Nearest(*shared.value, k, digits, exclude_self)
        for batch in batches:
            if batch.num_rows:
                best.add(nn.as_ids(batch.column("doc_id")), nn.as_matrix(batch.column("embedding"), dim))
        yield pa.RecordBatch.from_pydict(best.columns())

    return vectors.mapInArrow(scan, nn.SCHEMA)


# Many queries: cells and blocks


@dataclass(frozen=True)
class Cells:
    """Pivots with what is known of the vectors nearest to each; as many entries as pivots, whatever the data."""

    pivots: np.ndarray
    n: np.ndarray
    inner: np.ndarray
    radius: np.ndarray
    nearest: np.ndarray


Route = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class BoundedRoute:
    """Cells that can hold one of a query's ``reach`` nearest vectors.

    ``known`` squared distances bound that to the last neighbour from above. Where there is none, the vectors closest to each
    pivot do through the triangle inequality. A cell is left out if its ring around the pivot, or the half-space nearer to
    its pivot, lies beyond.
    """

    cells: Cells
    reach: int
    digits: int

    def __call__(self, queries: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        cells = self.cells
        d = np.sqrt(nn.squared_distances(queries, cells.pivots))
        bound = np.full(len(d), np.inf) if known is None else np.sqrt(known)
        unknown = np.flatnonzero(np.isinf(bound))
        if len(unknown):
            reachable = (d[unknown, :, None] + cells.nearest[None, :, :]).reshape(len(unknown), -1)
            bound[unknown] = np.partition(reachable, self.reach - 1, axis=1)[:, self.reach - 1]
        # Squared distances closer than the rounding step may tie.
        bound = np.sqrt(bound * bound + 10.0**-self.digits) + SLACK
        own = d.argmin(axis=1)
        gap = np.sqrt(nn.squared_distances(cells.pivots, cells.pivots))[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = (d * d - d[np.arange(len(d)), own][:, None] ** 2) / (2 * gap)
        beyond = np.where(gap > 0, beyond, 0.0)
        lower = np.maximum(np.maximum(d - cells.radius, cells.inner - d), beyond)
        return (lower <= bound[:, None]) & (cells.n > 0)


@dataclass(frozen=True)
class ProbeRoute:
    """The ``probe`` nearest cells; equally near ones by number."""

    cells: Cells
    probe: int

    def __call__(self, queries: np.ndarray) -> np.ndarray:
        d = np.round(nn.squared_distances(queries, self.cells.pivots), 9)
        chosen = np.argsort(d, axis=1, kind="stable")[:, : self.probe]
        visits = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(visits, chosen, True, axis=1)
        return visits & (self.cells.n > 0)


def _exact_by_cells(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    digits: int,
    exclude_self: bool,
    block_rows: int,
    pivots: int | None,
) -> DataFrame:
    reach = k + 1 if exclude_self else k
    pivots = pivots or max(PIVOTS, min(MOST_PIVOTS, math.isqrt(vectors.count())))
    kept = _lowest_copies(vectors, reach)
    centres = nn.as_matrix(vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pivots).toArrow()["embedding"], dim)
    assigned = cut_lineage(assign_cells(kept, centres, dim))
    cells = _describe(assigned, centres, reach)
    route = BoundedRoute(cells, reach, digits)
    asked = cut_lineage(_bounded(assigned, queries, cells, k, dim, digits, exclude_self))
    hits, _ = _by_blocks(assigned, asked, cells, route, k, dim, digits, exclude_self, block_rows)
    return hits


def _bounded(assigned: DataFrame, queries: DataFrame, cells: Cells, k: int, dim: int, digits: int, exclude_self: bool) -> DataFrame:
    """``queries`` with ``bound``, a squared distance within which ``k`` vectors lie, infinite where that is not known.

    A query meets up to about ``BOUND_ROWS`` vectors of the nearest cell that has any, in lots of bounded size on both sides.
    """
    element = queries.schema["embedding"].dataType.elementType.simpleString()
    present = np.flatnonzero(cells.n)
    if not len(present):
        return queries.withColumn("bound", F.lit(float("inf")))
    pivots = cells.pivots[present]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = [nn.squared_distances(nn.as_matrix(part.column("embedding"), dim), pivots).argmin(axis=1) for part in _slices(batch, max(1, nn.CELLS // len(pivots)))]
            cell = present[np.concatenate([*nearest, np.zeros(0, np.int64)]).astype(np.int64)]
            yield pa.RecordBatch.from_pydict({"cell": cell.astype(np.int32), "query_id": batch.column("query_id"), "embedding": batch.column("embedding")})

    asking = queries.mapInArrow(own, f"cell int, query_id bigint, embedding array<{element}>")
    lots = []
    for row in asking.groupBy("cell").count().collect():  # as many rows as cells
        parts = -(-int(cells.n[row["cell"]]) // BOUND_ROWS)
        lots.append((row["cell"], parts, max(parts, -(-row["count"] // BOUND_ROWS))))
    plan = F.broadcast(queries.sparkSession.createDataFrame(lots, "cell int, parts int, lots int"))
    left = assigned.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    left = left.select("cell", F.explode(F.expr("sequence(part, lots - 1, parts)")).alias("lot"), "doc_id", "embedding")
    right = asking.join(plan, "cell").withColumn("lot", F.pmod(F.xxhash64("query_id", "embedding"), F.col("lots")).cast("int"))

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows = nn.as_ids(left["doc_id"]), nn.as_matrix(left["embedding"], dim)
        found = [np.zeros(0)]
        for part in _slices(right, max(1, nn.CELLS // max(len(ids), 1))):
            asked = nn.as_matrix(part["embedding"], dim)
            d2 = nn.squared_distances(asked, rows)
            if exclude_self:
                d2[part["query_id"].to_numpy()[:, None] == ids[None, :]] = np.inf
            size = (asked * asked).sum(axis=1) + (rows * rows).sum(axis=1).max(initial=0.0)
            last = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(d2), np.inf)
            found.append(last + 1e-13 * dim * size + 10.0**-digits)
        return right.select(["query_id", "embedding"]).append_column("bound", pa.array(np.concatenate(found)))

    key = ["cell", "lot"]
    met = left.groupBy(*key).cogroup(right.select(*key, "query_id", "embedding").groupBy(*key))
    return met.applyInArrow(bound, f"query_id bigint, embedding array<{element}>, bound double")


def _slices(rows: pa.Table | pa.RecordBatch, step: int) -> Iterator[pa.Table | pa.RecordBatch]:
    return (rows.slice(begin, step) for begin in range(0, rows.num_rows, step))


def _lowest_copies(vectors: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors only the lowest ids can be among the hits, as equal distances rank by id."""
    marked = vectors.withColumn("_hash", F.xxhash64("embedding"))
    return best_per_group(marked, ["_hash", "embedding"], [F.asc("doc_id")], keep).drop("_hash", "rank")


def assign_cells(vectors: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """(cell, dist, doc_id, embedding): each vector with its nearest pivot."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.sqrt(nn.squared_distances(nn.as_matrix(batch.column("embedding"), dim), centres))
            cell = d.argmin(axis=1) if batch.num_rows else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "cell": cell.astype(np.int32),
                    "dist": d[np.arange(len(cell)), cell],
                    "doc_id": batch.column("doc_id"),
                    "embedding": batch.column("embedding"),
                }
            )

    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    return vectors.mapInArrow(assign, f"cell int, dist double, doc_id bigint, embedding array<{element}>")


def _describe(assigned: DataFrame, centres: np.ndarray, reach: int) -> Cells:
    m = len(centres)
    n, inner, radius = np.zeros(m, dtype=np.int64), np.full(m, np.inf), np.zeros(m)
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    for row in sizes.collect():
        n[row["cell"]], inner[row["cell"]], radius[row["cell"]] = row["n"], row["lo"], row["hi"]
    near = np.full((m, reach), np.inf)
    closest = best_per_group(assigned.select("cell", "dist", "doc_id"), ["cell"], [F.asc("dist"), F.asc("doc_id")], reach)
    for row in closest.select("cell", "rank", "dist").collect():
        near[row["cell"], row["rank"] - 1] = row["dist"]
    return Cells(centres, n, inner, radius, near)


def _by_blocks(
    assigned: DataFrame,
    queries: DataFrame,
    cells: Cells,
    route: Route,
    k: int,
    dim: int,
    digits: int,
    exclude_self: bool,
    block_rows: int,
) -> tuple[DataFrame, DataFrame]:
    """Nearest vectors within the visited cells, and the size of the work per cell (cell, n, visits)."""

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows_of = nn.as_ids(left["doc_id"]), nn.as_matrix(left["embedding"], dim)
        found = []
        for part, cells_met in in_blocks(left, right, block_rows):
            within = part["bound"].to_numpy() if "bound" in part.column_names else None
            best = nn.Nearest(nn.as_ids(part["query_id"]), nn.as_matrix(part["embedding"], dim), k, digits, exclude_self, within)
            for _, here, asking in cells_met:
                best.add_for(asking, ids[here], rows_of[here])
            found.append(pa.RecordBatch.from_pydict(best.columns()))
        return pa.Table.from_batches(found) if found else pa.Table.from_pydict(nn.Best(np.zeros(0, np.int64), k).columns())

    return blocks_of_cells(assigned, queries, cells.n, route, dim, ["doc_id", "embedding"], block, nn.SCHEMA)


def in_blocks(left: pa.Table, right: pa.Table, block_rows: int) -> Iterator[tuple[pa.Table, Iterator[tuple[int, np.ndarray, np.ndarray]]]]:
    """Queries ``block_rows`` at a time, and for each lot the cells of ``left`` that some of it visit, ``block_rows`` at a time: the cell,
    its rows, and the rows of the lot that visit it."""
    cells = nn.as_ids(left["cell"])
    order = np.argsort(cells, kind="stable")
    present, starts = np.unique(cells[order], return_index=True)
    ends = np.append(starts[1:], len(order))

    def met(part: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        visits = np.unpackbits(np.frombuffer(b"".join(part["visits"].to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1)
        for cell, first, last in zip(present, starts, ends):
            asking = np.flatnonzero(visits[:, cell])
            if len(asking):
                for begin in range(first, last, block_rows):
                    yield int(cell), order[begin : min(begin + block_rows, last)], asking

    for begin in range(0, right.num_rows, block_rows):
        part = right.slice(begin, block_rows)
        yield part, met(part)


def _bands(n: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """The first band of each cell of ``n`` rows and how many bands it has: small cells share one, a large cell is cut into several."""
    first, several = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    size, band, filled = max(1, -(-int(n.sum()) // bands)), -1, 0
    for cell in np.flatnonzero(n):
        if n[cell] > size:
            first[cell], several[cell] = band + 1, -(-n[cell] // size)
            band, filled = band + several[cell], size
        else:
            if band < 0 or filled + n[cell] > size:
                band, filled = band + 1, 0
            first[cell], filled = band, filled + n[cell]
    return first, several


def blocks_of_cells(
    assigned: DataFrame,
    queries: DataFrame,
    n: np.ndarray,
    route: Route,
    dim: int,
    columns: Sequence[str],
    compare: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    band_rows: int = BAND_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``compare`` the rows of every visited cell, ``columns`` of ``assigned`` (cell, doc_id, ...), with its queries, band by band.

    Rows of cells lie in bands of about ``band_rows``, queries in others of ``BAND_ROWS``; every pair of bands is a task, to which a query goes once however
    many of its cells it visits. So a row is sent as often as the other side has bands, and neither a large cell nor a popular one
    ends up in a single task. ``compare`` gets the rows of a band with their ``cell``, and queries (query_id, embedding, visits), see
    ``in_blocks``. The second result is the size of the work per cell (cell, n, visits). Where queries have a ``bound``, the route and
    ``compare`` get it too.
    """
    m = len(n)
    # Rows routed at once: the bounds of a route take rows x pivots x neighbours numbers.
    step = max(1, 65536 // m)
    spark = assigned.sparkSession
    shared = spark.sparkContext.broadcast(route)
    more = [c for c in ("bound",) if c in queries.columns]

    def visited(part: pa.RecordBatch) -> np.ndarray:
        return shared.value(nn.as_matrix(part.column("embedding"), dim), *(part.column(c).to_numpy() for c in more))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visits = np.zeros(m + 1, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                chosen = visited(batch.slice(start, step))
                visits += np.append(chosen.sum(axis=0), chosen.any(axis=1).sum())
        yield pa.RecordBatch.from_pydict({"cell": np.arange(m + 1, dtype=np.int32), "visits": visits})

    visits = queries.mapInArrow(count, "cell int, visits bigint").groupBy("cell").agg(F.sum("visits").alias("visits"))
    counted = {r["cell"]: r["visits"] for r in visits.collect() if r["visits"]}
    asking_rows = counted.pop(m, 0)
    met = np.array([n[c] if c in counted else 0 for c in range(m)], np.int64)
    v_bands, q_bands = max(1, -(-int(met.sum()) // band_rows)), max(1, -(-asking_rows // BAND_ROWS))
    # Enough tasks for all cores, if there are rows for them.
    q_bands = max(q_bands, min(-(-3 * spark.sparkContext.defaultParallelism // v_bands), asking_rows // LEAST_ROWS))
    first, several = _bands(met, v_bands)
    work = [(c, int(n[c]), v, int(first[c]), int(several[c])) for c, v in sorted(counted.items())]
    plan = spark.createDataFrame(work, "cell int, n bigint, visits bigint, first bigint, several bigint")
    lies_in = np.zeros((m, int((first + several).max(initial=1))), np.float32)
    for cell in counted:
        lies_in[cell, first[cell] : first[cell] + several[cell]] = 1

    element = queries.schema["embedding"].dataType.elementType.simpleString()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                chosen = visited(part)
                row, band = np.nonzero(chosen.astype(np.float32) @ lies_in)
                bits = pa.array([b.tobytes() for b in np.packbits(chosen, axis=1)], pa.binary())
                yield pa.RecordBatch.from_pydict(
                    {
                        "v_band": band,
                        "query_id": part.column("query_id").take(pa.array(row)),
                        "embedding": part.column("embedding").take(pa.array(row)),
                        "visits": bits.take(pa.array(row)),
                        **{c: part.column(c).take(pa.array(row)) for c in more},
                    }
                )

    routed = queries.mapInArrow(visit, f"v_band bigint, query_id bigint, embedding array<{element}>, visits binary" + "".join(f", {c} double" for c in more))
    asking = routed.withColumn("q_band", F.pmod(F.xxhash64("query_id"), F.lit(q_bands)))
    answering = (
        assigned.join(F.broadcast(plan.select("cell", "first", "several")), "cell")
        .withColumn("v_band", F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("several")))
        .withColumn("q_band", F.explode(F.expr(f"sequence(0L, {q_bands - 1}L)")))
    )
    key = ["v_band", "q_band"]
    hits = (
        answering.select(*key, "cell", *columns)
        .groupBy(*key)
        .cogroup(asking.select(*key, "query_id", "embedding", "visits", *more).groupBy(*key))
        .applyInArrow(compare, schema)
    )
    return hits, plan.select("cell", "n", "visits")


# Approximate search


@dataclass(frozen=True)
class ApproximateHits:
    """Hits, and the work behind them: ``work(cell, n, visits)`` gives the share of vectors compared."""

    hits: DataFrame
    work: DataFrame


def train_cells(vectors: DataFrame, cells: int, dim: int, steps: int = 3) -> np.ndarray:
    """Centres of cells: the vectors with the lowest doc_ids, then ``steps`` times the means of what is nearest to each.

    Means are rounded, so the result does not depend on how the vectors are partitioned. A centre that nothing is nearest to
    stays. Each step adds up one row per cell in every task and hands the driver as many rows as there are cells.
    """
    stored = _stored(vectors, dim)
    centres = np.round(nn.as_matrix(stored.orderBy("doc_id").limit(cells).toArrow()["embedding"], dim), 6)
    for _ in range(steps):
        shared = vectors.sparkSession.sparkContext.broadcast(centres)

        def add_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros(shared.value.shape), np.zeros(len(shared.value), dtype=np.int64)
            for batch in batches:
                rows = nn.as_matrix(batch.column("embedding"), dim)
                nearest = np.round(nn.squared_distances(rows, shared.value), 9).argmin(axis=1)
                np.add.at(sums, nearest, rows)
                n += np.bincount(nearest, minlength=len(n))
            yield pa.RecordBatch.from_pydict({"cell": np.arange(len(n)), "n": n, "sums": list(sums)})

        added = stored.mapInArrow(add_up, "cell bigint, n bigint, sums array<double>").where("n > 0")
        total = Summarizer.sum(array_to_vector("sums"))
        means = added.groupBy("cell").agg(F.sum("n").alias("n"), vector_to_array(total).alias("sums")).collect()
        centres = centres.copy()
        for row in means:
            centres[row["cell"]] = np.round(np.array(row["sums"]) / row["n"], 6)
    return centres


def knn_approx(
    vectors: DataFrame,
    queries: DataFrame,
    centres: np.ndarray,
    probe: int,
    k: int = HITS,
    exclude_self: bool = False,
    digits: int = 6,
    block_rows: int = BLOCK_ROWS,
) -> ApproximateHits:
    """The nearest vectors among those in the ``probe`` cells nearest to each query. All of a cell is compared."""
    dim = centres.shape[1]
    vectors, queries = _stored(vectors, dim), _asked(queries, dim)
    assigned = cut_lineage(assign_cells(vectors, centres, dim))
    cells = _describe(assigned, centres, 1)
    hits, work = _by_blocks(
        assigned, queries, cells, ProbeRoute(cells, probe), k, dim, digits, exclude_self, block_rows
    )
    return ApproximateHits(_ranked(hits, k, digits), work)


def recall_and_share(approximate: ApproximateHits, exact: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """One row (recall, candidate_share): neither number means anything without the other."""
    hits = approximate.hits.select("query_id", "doc_id", F.lit(1).alias("hit"))
    found = exact.join(hits, ["query_id", "doc_id"], "left")
    counted = {
        "found": found.agg(F.count("hit").alias("n")),
        "wanted": exact.agg(F.count("*").alias("n")),
        "compared": approximate.work.agg(F.sum(F.col("n") * F.col("visits")).alias("n")),
        "vectors": vectors.agg(F.count("*").alias("n")),
        "queries": queries.agg(F.count("*").alias("n")),
    }
    parts = [df.select(F.lit(name).alias("what"), "n") for name, df in counted.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)

    def number(name: str):
        return F.sum(F.when(F.col("what") == name, F.col("n")))

    return every.agg(
        F.round(number("found") / number("wanted"), 6).alias("recall"),
        F.round(number("compared") / (number("vectors") * number("queries")), 6).alias("candidate_share"),
    )

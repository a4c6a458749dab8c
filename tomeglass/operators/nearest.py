"""The k best rows of one block of documents for one block of queries, kept as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CELLS = 4_000_000
QUERIES = 128

SCHEMA = "query_id bigint, doc_id bigint, cost double"


def as_matrix(column: pa.ChunkedArray | pa.ListArray, dim: int) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def as_ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    return np.maximum(squares - 2.0 * (a @ b.T), 0.0)


def may_lie_within(queries: np.ndarray, vectors: np.ndarray, limit: np.ndarray, factor: np.ndarray | float = 1.0, more: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs whose squared distance, times a vector's ``factor``, is at most a query's ``limit`` and ``more`` of the vector, in
    order of the queries, and of few others.

    One product in single precision about the vectors' mean, with as much slack as its rounding may take; numbers that it cannot hold
    are compared in double precision.
    """
    middle = vectors.mean(axis=0)
    q, v = queries - middle, vectors - middle
    squares, lengths = (q * q).sum(axis=1), (v * v).sum(axis=1)
    factor, more = np.broadcast_to(factor, len(v)), np.broadcast_to(more, len(v))
    size = squares + lengths.max(initial=0.0) + np.abs(more).max(initial=0.0) + np.abs(limit)
    if not np.all(size < 1e30):
        return np.nonzero(squared_distances(queries, vectors) * factor <= limit[:, None] + more)
    slack = (queries.shape[1] + 16) * 2.0**-22 * size + 1e-30
    q = np.column_stack([q, squares, np.ones(len(q))]).astype(np.float32)
    v = np.column_stack([v * factor[:, None], -0.5 * factor, 0.5 * (more - factor * lengths)]).astype(np.float32)
    least = (-0.5 * limit - slack).astype(np.float32)
    return np.divmod(np.flatnonzero((q @ v.T >= least[:, None]).ravel()), len(v))


class Best:
    """Running k best (cost, id) pairs per query: lower cost first, ties to the lower id, infinite cost never."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.cost = np.full((len(query_ids), k), np.inf)
        self.id = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def offer(self, rows: slice, ids: np.ndarray, cost: np.ndarray) -> None:
        """Costs of the documents ``ids`` for the queries ``rows``."""
        last_cost, last_id = self.cost[rows, -1:], self.id[rows, -1:]
        limit = last_cost
        if cost.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(cost, self.k - 1, axis=1)[:, self.k - 1 : self.k])
        better = (cost <= limit) & ((cost < last_cost) | (ids[None, :] < last_id)) & np.isfinite(cost)
        row, col = np.nonzero(better)
        if len(row):
            self._merge(rows, row, cost[row, col], ids[col])

    def _merge(self, rows: slice, row: np.ndarray, cost: np.ndarray, ids: np.ndarray) -> None:
        old_cost, old_id = self.cost[rows], self.id[rows]
        n = len(old_cost)
        all_row = np.concatenate([np.repeat(np.arange(n), self.k), row])
        all_cost = np.concatenate([old_cost.ravel(), cost])
        all_id = np.concatenate([old_id.ravel(), ids])
        order = np.lexsort((all_id, all_cost, all_row))
        first = np.searchsorted(all_row[order], np.arange(n))
        keep = order[first[:, None] + np.arange(self.k)[None, :]]
        self.cost[rows], self.id[rows] = all_cost[keep], all_id[keep]

    def columns(self) -> dict[str, np.ndarray]:
        found = np.isfinite(self.cost)
        return {
            "query_id": np.repeat(self.query_ids, self.k)[found.ravel()],
            "doc_id": self.id[found],
            "cost": self.cost[found],
        }


class Nearest(Best):
    """The k nearest vectors by squared distance, rounded before comparing; none beyond ``within`` is among them, if that is given per query."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, digits: int, exclude_self: bool, within: np.ndarray | None = None):
        super().__init__(query_ids, k)
        self.queries, self.digits, self.exclude_self = queries, digits, exclude_self
        self.within = np.full(len(query_ids), np.inf) if within is None else within

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = max(1, min(len(ids), CELLS))
        height = max(1, CELLS // width)
        for left in range(0, len(ids), width):
            for top in range(0, len(self.query_ids), height):
                self._add_tile(slice(top, top + height), ids[left : left + width], vectors[left : left + width])

    def add_for(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Only for the queries ``rows``."""
        some = Nearest(self.query_ids[rows], self.queries[rows], self.k, self.digits, self.exclude_self, self.within[rows])
        some.cost, some.id = self.cost[rows], self.id[rows]
        some.add(ids, vectors)
        self.cost[rows], self.id[rows] = some.cost, some.id

    def _add_tile(self, rows: slice, ids: np.ndarray, vectors: np.ndarray) -> None:
        queries = self.queries[rows]
        own = column = None
        if self.exclude_self:
            order = np.argsort(ids)
            at = np.searchsorted(ids, self.query_ids[rows], sorter=order)
            column = order[np.minimum(at, len(ids) - 1)]
            own = ids[column] == self.query_ids[rows]
        row, col, cost = self._where_known(rows, queries, vectors) or self._where_open(rows, queries, vectors, own, column)
        if own is not None:
            others = ~own[row] | (col != column[row])
            row, col, cost = row[others], col[others], cost[others]
        if len(row):
            self._merge(rows, row, cost, ids[col])

    def _where_known(self, rows: slice, queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Pairs that may matter, if all queries have a bound and these are few."""
        limit = np.minimum(self.cost[rows, -1], self.within[rows])
        if not np.isfinite(limit).all() or not len(vectors):
            return None
        row, col = may_lie_within(queries, vectors, limit + self._slack(queries, vectors)[:, 0])
        return None if len(row) > 4 * self.k * len(queries) else (row, col, self._exact(row, col, queries, vectors))

    def _where_open(self, rows: slice, queries: np.ndarray, vectors: np.ndarray, own: np.ndarray | None, column: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d2 = squared_distances(queries, vectors)
        if own is not None:
            d2[np.nonzero(own)[0], column[own]] = np.inf
        return self._exact_where_it_matters(rows, d2, queries, vectors)

    def _slack(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        size = (queries * queries).sum(axis=1)[:, None] + (vectors * vectors).sum(axis=1).max()
        return 1e-13 * queries.shape[1] * size + 10.0**-self.digits

    def _exact_where_it_matters(self, rows: slice, d2: np.ndarray, queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The product form is fast but loses digits where vectors lie far from the origin.

        What it says for certain, that a vector is beyond the k-th so far, is kept; all others, k and those that tie with
        the last of them, are computed anew from their differences before rounding.
        """
        slack = self._slack(queries, vectors)
        limit = np.minimum(self.cost[rows, -1:], self.within[rows, None])
        near = (d2 <= limit + slack) & np.isfinite(d2)
        if d2.shape[1] > self.k and np.count_nonzero(near) > 4 * self.k * len(d2):
            limit = np.minimum(limit, np.partition(d2, self.k - 1, axis=1)[:, self.k - 1 : self.k] + slack)
            near &= d2 <= limit + slack
        row, col = np.nonzero(near)
        return row, col, self._exact(row, col, queries, vectors)

    def _exact(self, row: np.ndarray, col: np.ndarray, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        exact = np.empty(len(row))
        for begin in range(0, len(row), CELLS // max(1, queries.shape[1])):
            i, j = row[begin : begin + CELLS // max(1, queries.shape[1])], col[begin : begin + CELLS // max(1, queries.shape[1])]
            exact[begin : begin + len(i)] = np.round(((queries[i] - vectors[j]) ** 2).sum(axis=1), self.digits)
        return exact


class HighestScores(Best):
    """The k documents with the highest sum of term weights, rounded before comparing, whatever the signs of the weights.

    A document is a hit of a query if it has one of its terms.
    Queries are given as one entry per query and term: the position of the query, the term's id, and a factor. With ``after``,
    a score and an id per query, only what ranks below them is a hit.
    """

    def __init__(
        self, query_ids: np.ndarray, row: np.ndarray, term: np.ndarray, factor: np.ndarray, k: int, digits: int, after: tuple[np.ndarray, np.ndarray] | None = None
    ):
        super().__init__(query_ids, k)
        self.after = after
        order = np.argsort(row, kind="stable")
        self.row, self.term, self.factor, self.digits = row[order], term[order], factor[order], digits

    def add(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """One entry per document and term; ``row`` is the position in ``ids`` and ascends."""
        top = 0
        while top < len(self.query_ids):
            rows, entries = self._next_queries(top)
            terms, column = np.unique(self.term[entries], return_inverse=True)
            if len(terms):
                factors = np.zeros((rows.stop - top, len(terms)))
                factors[self.row[entries] - top, column] = self.factor[entries]
                self._add_tiles(rows, factors, terms, ids, row, term, weight)
            top = rows.stop

    def _next_queries(self, top: int) -> tuple[slice, slice]:
        """Some queries from ``top`` on, fewer of long ones, and their entries."""
        step = min(QUERIES, len(self.query_ids) - top)
        low, high = np.searchsorted(self.row, [top, top + step])
        while step > 1 and step * (high - low) > CELLS:
            step //= 2
            high = np.searchsorted(self.row, top + step)
        return slice(top, top + step), slice(low, high)

    def _add_tiles(self, rows, factors, terms, ids, row, term, weight) -> None:
        at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
        asked = terms[at] == term
        at, row, weight = at[asked], row[asked], weight[asked]
        width = max(1, CELLS // max(factors.shape))
        for left in range(0, len(ids), width):
            low, high = np.searchsorted(row, [left, left + width])
            if low == high:
                continue
            here = ids[left : left + width]
            weights = np.zeros((len(terms), len(here)))
            weights[at[low:high], row[low:high] - left] = weight[low:high]
            score = factors @ weights
            if min(weight[low:high].min(), self.factor.min()) > 0:
                met = score > 0
            else:
                present = np.zeros(weights.shape)
                present[at[low:high], row[low:high] - left] = 1
                met = (factors != 0).astype(float) @ present > 0
            cost = np.where(met, -np.round(score, self.digits), np.inf)
            if self.after:
                last, last_id = (-self.after[0][rows, None], self.after[1][rows, None])
                cost[(cost < last) | ((cost == last) & (here[None, :] <= last_id))] = np.inf
            self.offer(rows, here, cost)

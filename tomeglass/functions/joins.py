"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 64
HOT_KEYS = 1000


def is_within(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_within(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger side keeps Spark's own choice of join."""
    return F.broadcast(df) if is_within(df, max_rows) else df


def join_requests(
    rows: DataFrame,
    requests: DataFrame,
    on: Sequence[str],
    spread_by: str,
    few: bool | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Inner join of a large table with a table of requests on a key that may be hot.

    A counted small request side is broadcast, and the large side does not move (``few`` passes on an earlier
    count). Otherwise every key is split ``salts`` ways by ``spread_by``, and the requests are repeated once per salt,
    so that no task owns a whole key.
    """
    if is_within(requests, BROADCAST_ROWS) if few is None else few:
        return rows.join(F.broadcast(requests), list(on))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    copies = requests.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


def join_lookup(rows: DataFrame, lookup: DataFrame, on: Sequence[str], counts: DataFrame, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of rows with a lookup that is unique on ``on``, where few keys may own most of the rows.

    ``counts`` holds the rows per key in its column ``n``. The ``hot_keys`` most frequent keys, a table of fixed size,
    are broadcast, and their rows stay where they are. Every other key owns less than one ``hot_keys``-th of the
    rows, so the rest is an ordinary shuffled join.
    """
    hot = F.broadcast(counts.orderBy(F.desc("n"), *on).limit(hot_keys).select(*on))
    hot_rows = rows.join(F.broadcast(lookup.join(hot, list(on))), list(on))
    cold_rows = rows.join(hot, list(on), "left_anti").join(lookup, list(on))
    return hot_rows.unionByName(cold_rows)

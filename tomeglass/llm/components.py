"""Connected components of a graph given as a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeglass.session import cut_lineage


def _mark(links: DataFrame) -> tuple:
    """Tells link tables apart: rows and a sum over hashes, which does not depend on their order."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the label is the least node of its component.

    Every round hangs the larger neighbours of a node on its least neighbour, then the smaller ones. Rows never outgrow
    twice the links, a hub's rows are aggregated before they are shuffled, and rounds grow with the logarithm of the nodes.
    Null ends and loops are left out; an empty table gives an empty one.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = cut_lineage(links)
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(hung.select("a", F.col("least").alias("b")))
        links = cut_lineage(small.where("a <> b").distinct())
        before, mark = mark, _mark(links)
        if mark == before:
            break
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return labels.unionByName(roots)

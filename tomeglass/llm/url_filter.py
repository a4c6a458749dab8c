"""URL filter by a tree of path templates per host; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeglass.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MERGED = "+"
BROADCAST_BYTES = 32 << 20


class Limits(NamedTuple):
    """Shape of the tree and when its leaves are rejected.

    A segment keeps its name if at least ``support`` URLs and one in ``fanout`` of its parent's have it; all others are
    variable and become a wildcard, so a node has at most ``fanout`` named branches. Named branches whose share of bad URLs
    lies within ``similar`` standard errors of their parent's are merged. A template is rejected if its share of good URLs, smoothed by ``weight`` URLs of the whole table's share, is below
    ``purity``.
    """

    support: int = 5
    fanout: int = 50
    similar: float = 2.58
    weight: float = 5.0
    purity: float = 0.5


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the (host and path, verdict) rules that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, outcome in sorted(rules, key=lambda r: len(r[0])):  # the last that fits is the longest
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _wildcard(segment: Column) -> Column:
    """A wildcard that keeps the ending of a file name."""
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1))


def _one_level(rows: DataFrame, named: DataFrame, level: int) -> DataFrame:
    """Add the next step to ``template`` of rows with host and segs: a name, or a wildcard."""
    segment = F.get("segs", F.lit(level))
    step = F.concat("template", F.lit("/"), F.coalesce(F.element_at("names", segment), _wildcard(segment)))
    rows = rows.join(named, ["host", "template"], "left")
    return rows.withColumn("template", F.when(F.size("segs") > level, step).otherwise(F.col("template"))).drop("names")


def _if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows, spelled out, are few bytes; no more than 100,000 of them are looked at."""
    spelled = F.octet_length(F.to_json(F.struct("*")))
    rows, size = df.limit(100_001).agg(F.count("*"), F.sum(spelled)).first()
    return F.broadcast(df) if rows <= 100_000 and (size or 0) <= BROADCAST_BYTES else df


def _below(level: Column | int) -> Column:
    """Wildcards for all segments from ``level`` on."""
    rest = F.slice("segs", level + 1, F.greatest(F.size("segs") - level, F.lit(0)))
    return F.array_join(F.transform(rest, lambda s: F.concat(F.lit("/"), _wildcard(s))), "")


def _named_branches(counted: DataFrame, level: int, limits: Limits) -> DataFrame:
    """(host, template, names) for the nodes of one level: which segments keep a name, and which name."""
    branches = counted.where(F.size("segs") > level).groupBy("host", "template", F.get("segs", F.lit(level)).alias("segment"))
    branches = branches.agg(*(F.sum(c).alias(c) for c in ("n", "known", "bad")))
    parents = branches.groupBy("host", "template").agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "known", "bad")))
    heavy = branches.where(F.col("n") >= limits.support).join(parents, ["host", "template"]).where(F.col("n") * limits.fanout >= F.col("all_n"))
    share = (F.col("all_bad") + 0.5) / (F.col("all_known") + 1)
    error = F.sqrt(F.col("known") * share * (1 - share))
    alike = F.abs(F.col("bad") - F.col("known") * share) <= limits.similar * error
    found = heavy.groupBy("host", "template").agg(F.collect_list(F.struct("segment", alike.alias("alike"))).alias("found"))
    several = F.size(F.filter("found", lambda b: b["alike"])) > 1
    named = F.transform("found", lambda b: F.struct(b["segment"], F.when(b["alike"] & several, F.lit(MERGED)).otherwise(b["segment"])))
    return found.select("host", "template", F.map_from_entries(named).alias("names"))


def judge_urls(urls: DataFrame, known: DataFrame, rules: Sequence[tuple[str, str]] = (), limits: Limits = Limits()) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for every row of ``urls`` (page_id, url).

    ``known`` (page_id, bad 0 or 1) labels some of the URLs. The longest fitting rule decides; where none fits the template of
    the URL does. URLs that are missing or have no ``://`` have empty hosts and paths and one template of their own. Rows
    that repeat or lack a page_id are judged like any other, labels of a repeated page count as bad if one says so. Other
    columns are ignored; an empty table gives an empty result.

    URLs are added up by host and path before anything is grouped by host. The different paths climb the tree level by level, as long
    as any node has ``limits.support`` URLs, and meet the pages once at the end, by host and path, so a host with most of the
    URLs is no group of its own anywhere.
    """
    labels = known.groupBy("page_id").agg(F.max("bad").alias("bad"))
    parsed = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("segs", _segments(F.col("path")))
    counted = parsed.join(labels, "page_id", "left").groupBy("host", "segs")
    counted = counted.agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rows = cut_lineage(counted.withColumn("template", F.lit("")))
    deepest, n_known, n_bad = rows.agg(F.max(F.size("segs")), F.sum("known"), F.sum("bad")).first()

    level = 0
    while level < (deepest or 0):
        alive = rows.where(F.size("segs") > level).groupBy("host", "template").agg(F.sum("n").alias("n")).where(F.col("n") >= limits.support)
        if alive.isEmpty():
            break
        named = cut_lineage(_named_branches(rows, level, limits))
        rows = cut_lineage(_one_level(rows, _if_small(named), level))
        level += 1
    rows = rows.withColumn("template", F.concat("template", _below(level)))

    good = 1 - (n_bad or 0) / max(n_known or 0, 1)
    leaves = rows.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    purity = (F.col("known") - F.col("bad") + limits.weight * good) / (F.col("known") + limits.weight)
    impure = leaves.where(purity < limits.purity).select("host", "template", F.lit(True).alias("impure"))
    told = cut_lineage(rows.join(_if_small(cut_lineage(impure)), ["host", "template"], "left").select("host", "segs", "template", "impure"))

    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(_if_small(told), ["host", "segs"])
    own = F.when(F.col("impure"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template")

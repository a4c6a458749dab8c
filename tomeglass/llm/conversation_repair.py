"""Repair of conversations whose roles break the order they should have, at the least cost of edits.

A conversation has the roles ``(s?(ua)+)?``: an optional system row, then pairs of user and assistant. An LR parser reads them row by
row over a graph-structured stack: all ways to keep, rerole, delete or insert rows go on side by side, and ways whose stacks end in
the same state are one from there on, the cheapest, or of equally cheap ones the least by the letters of their edits. A path of given
letters has one cost, so of two equally cheap paths none begins with the other and the least stays the least whatever follows.

Stacks are at most four states deep, and of costs and orders only differences count, so that few fronts of stack tops ever
occur; the move from one front to the next is computed once per process. A conversation may be of any length: rows are sorted by
ranges, a range parses its part of a conversation for every stack that it may begin with, and the parts are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeglass.session import cut_lineage

SPACE = r"\x20\x09-\x0D"

# Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# The LR table of C -> (nothing) | P | s P, P -> u a | P u a: states after a shift, rules to reduce by (rows of the rule), states after P.
SHIFT = {(0, "s"): 1, (0, "u"): 3, (1, "u"): 3, (2, "u"): 4, (5, "u"): 4, (3, "a"): 6, (4, "a"): 7}
REDUCE = {6: 2, 7: 3}
GOTO = {0: 2, 1: 5}
ACCEPTED = (0, 2, 5)
AFTER_SYSTEM = 5


class Node(NamedTuple):
    """A state of a stack, linked to what lies below; stacks share their lower parts."""

    state: int
    below: Node | None


BOTTOM = Node(0, None)


def shifted(node: Node, initial: str) -> Node | None:
    """The stack after one more role, with all reductions done; None if the grammar does not allow it there."""
    state = SHIFT.get((node.state, initial))
    if state is None:
        return None
    node = Node(state, node)
    while node.state in REDUCE:
        for _ in range(REDUCE[node.state]):
            node = node.below
        node = Node(GOTO[node.state], node)
    return node


def _stacks() -> tuple[Node, ...]:
    found, new = [BOTTOM], [BOTTOM]
    while new:
        new = list(dict.fromkeys(n for node in new for i in "sua" if (n := shifted(node, i)) and n not in found))
        found += new
    return tuple(found)


STACKS = _stacks()


class Top(NamedTuple):
    """The end of a stack and of its path: cost, place in the order of all paths, and the letters past those of equal place."""

    node: Node
    cost: int
    rank: int
    tail: str


class Symbol(NamedTuple):
    """What counts of a row: the initial of its role, whether it has to go, whether it is cut off."""

    initial: str
    bad: bool
    truncated: bool


Front = tuple[Top, ...]
# Of every top of the next front, the number of the one it goes on from and the letters between them.
Moves = tuple[tuple[int, str], ...]


def _merge(tops: dict[int, tuple], cost: int, rank: int, letters: str, node: Node, parent: int, own: str) -> bool:
    new = (cost, rank, letters, node, parent, own)
    old = tops.get(node.state)
    if old is None or new[:3] < old[:3]:
        tops[node.state] = new
        return True
    return False


def _closed(tops: dict[int, tuple]) -> tuple[int, Front, Moves]:
    """Insert rows wherever that gives a new or better top, then put costs and orders in their simplest form."""
    waiting = list(tops.values())
    while waiting:
        better = []
        for cost, rank, letters, node, parent, own in waiting:
            for initial in "ua":
                if (after := shifted(node, initial)) and _merge(tops, cost + INSERT, rank, letters + "I", after, parent, own + "I"):
                    better.append(tops[after.state])
        waiting = better
    least = min(t[0] for t in tops.values())
    front, moves, new_rank, old_rank, base = [], [], -1, None, ""
    for cost, rank, letters, node, parent, own in sorted(tops.values(), key=lambda t: (t[1], t[2], t[3].state)):
        if rank != old_rank or not letters.startswith(base):
            new_rank, old_rank, base = new_rank + 1, rank, letters
        front.append(Top(node, cost - least, new_rank, letters[len(base) :]))
        moves.append((parent, own))
    return least, tuple(front), tuple(moves)


@cache
def opening(node: Node, insert: bool) -> tuple[int, Front, Moves]:
    """The front before any row; ``insert`` where a conversation begins, not where one goes on."""
    tops = {node.state: (0, 0, "", node, 0, "")}
    return _closed(tops) if insert else (0, (Top(node, 0, 0, ""),), ((0, ""),))


@cache
def step(front: Front, row: Symbol) -> tuple[int, Front, Moves]:
    """What the cheapest top gains in cost, the next front, and how it comes from this one."""
    tops: dict[int, tuple] = {}
    extra = TRUNCATED if row.truncated else 0
    for parent, (node, cost, rank, tail) in enumerate(front):
        _merge(tops, cost + DELETE, rank, tail + "D", node, parent, "D")
        if row.bad:
            continue
        if after := shifted(node, row.initial):
            _merge(tops, cost + extra, rank, tail + "K", after, parent, "K")
        for initial in "ua":
            if after := shifted(node, initial):
                _merge(tops, cost + REROLE + extra, rank, tail + "R", after, parent, "R")
    return _closed(tops)


def parse(node: Node, rows: list[Symbol], begins: bool) -> list[tuple[Node, int, str]]:
    """All stacks that a path over ``rows`` from ``node`` can end in, with cost and letters of the best path to each."""
    total, front, moves = opening(node, begins)
    history = [moves]
    for row in rows:
        gained, front, moves = step(front, row)
        total += gained
        history.append(moves)
    ends = []
    for number, top in enumerate(front):
        letters, at = [], number
        for moves in reversed(history):
            at, own = moves[at]
            letters.append(own)
        ends.append((top.node, total + top.cost, "".join(reversed(letters))))
    return ends


# Rows and their faults


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with one row in four harmed, chosen by the CRC of id and turn; for trials of the repair."""
    present = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(present("conv_id"), F.lit(":"), present("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    harmed = rows.select("conv_id", "turn", present("role").alias("role"), present("text").alias("text"), kind.alias("kind"))
    harmed = harmed.where("kind <> 0").withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return harmed.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("key"), F.asc("seen")]


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with what is wrong with each: ``fault`` is blank, duplicate, truncated or null.

    ``key`` tells texts apart and orders rows of one turn; ``seen`` numbers equal rows, the first of which is no duplicate.
    """
    present = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    plain = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), present("role").alias("role"), present("text").alias("text"))
    keyed = plain.withColumn("key", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "key").orderBy(F.asc_nulls_first("turn")))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    truncated = ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    fault = F.when(blank, "blank").when(F.col("seen") > 1, "duplicate").when(truncated, "truncated")
    return keyed.withColumn("seen", seen).withColumn("fault", fault)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows sorted by conversation and turn over ranges; (part, place) is the place of a row in its range."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(range(place, place + batch.num_rows), pa.int64())
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), places], names=[*batch.schema.names, "part", "place"])

    spread = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    schema = "conv_id bigint, turn bigint, role string, text string, fault string, part int, place bigint"
    return cut_lineage(spread.select("conv_id", "turn", "role", "text", "fault").mapInArrow(number, schema))


# Parts of conversations, one for each range


def _runs(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Neighbouring rows with equal ``key``, without holding more than a batch of them."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda row: tuple(row[k] for k in key))


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


LEGAL = ("su", "ua", "au")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
_END = pa.struct([("entry", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])
_PART = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), *((name, pa.int64()) for name in COUNTS), ("first", pa.string()), ("last", pa.string()), ("ends", pa.list_(_END))]
)
_PART_DDL = (
    "conv_id bigint, part int, place bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string,"
    " ends array<struct<entry: int, end: int, cost: bigint, letters: string>>"
)
BEGINS = -1


def _parts(numbered: DataFrame) -> DataFrame:
    """One row for each conversation in each range: faults, outer roles, and the best path between any two stacks.

    Only what opens a range can be the rest of a conversation, so all others are parsed from the bottom of the stack alone.
    """
    narrow = numbered.select("conv_id", "part", "place", F.substring("role", 1, 1).alias("initial"), "fault")

    def parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for (part, conv_id), rows in _runs(batches, "part", "conv_id"):
                symbols, counts, first, last, place = [], dict.fromkeys(COUNTS, 0), None, None, None
                for row in rows:
                    initial, fault = row["initial"], row["fault"]
                    if first is None:
                        first, place = initial, row["place"]
                    elif last + initial not in LEGAL:
                        counts["illegal"] += 1
                    if fault:
                        counts[fault] += 1
                    last = initial
                    symbols.append(Symbol(initial, fault in ("blank", "duplicate"), fault == "truncated"))
                entries = [(BEGINS, BOTTOM, True)] + [(i, node, False) for i, node in enumerate(STACKS) if place == 0]
                ends = [
                    {"entry": entry, "end": STACKS.index(end), "cost": cost, "letters": letters}
                    for entry, node, begins in entries
                    for end, cost, letters in parse(node, symbols, begins)
                ]
                yield {"conv_id": conv_id, "part": part, "place": place, **counts, "first": first, "last": last, "ends": ends}

        return _in_batches(found(), _PART)

    order = ("part", "place")
    return narrow.repartition("part").sortWithinPartitions(*order).mapInArrow(parse_all, _PART_DDL)


_PIECE = pa.struct([("part", pa.int32()), ("place", pa.int64()), ("output", pa.int64()), ("letters", pa.string())])
_REPORT = pa.schema([("conv_id", pa.int64()), *((name, pa.int64()) for name in COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("system", pa.bool_()), ("pieces", pa.list_(_PIECE))])
_REPORT_DDL = (
    "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, system boolean,"
    " pieces array<struct<part: int, place: bigint, output: bigint, letters: string>>"
)


def joined(parts: list[list[dict]]) -> tuple[int, Node, list[str]]:
    """The cheapest way through all parts of a conversation, the least by its letters: cost, last stack, and letters of each part."""
    ways: dict[int, tuple] = {}
    for number, ends in enumerate(parts):
        after: dict[int, tuple] = {}
        for e in ends:
            if number == 0 and e["entry"] == BEGINS:
                cost, letters, pieces = 0, "", ()
            elif number and e["entry"] != BEGINS and (way := ways.get(STACKS[e["entry"]].state)) and way[2] == e["entry"]:
                cost, letters, _, pieces = way
            else:
                continue
            new = (cost + e["cost"], letters + e["letters"], e["end"], (*pieces, e["letters"]))
            state = STACKS[e["end"]].state
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new
        ways = after
    cost, _, end, pieces = min(ways[s] for s in ACCEPTED if s in ways)
    return cost, STACKS[end], list(pieces)


def _reports(parts: DataFrame) -> DataFrame:
    """One row per conversation; what is held of one at a time is the letters of its edits, which are in the result as well."""

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for (conv_id,), rows in _runs(batches, "conv_id"):
                rows = list(rows)
                counts = {name: sum(r[name] for r in rows) for name in COUNTS}
                counts["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))
                cost, end, letters = joined([r["ends"] for r in rows])
                pieces, output = [], 0
                for r, piece in zip(rows, letters):
                    pieces.append({"part": r["part"], "place": r["place"], "output": output, "letters": piece})
                    output += len(piece) - piece.count("D")
                yield {"conv_id": conv_id, **counts, "cost": cost, "audit": "".join(letters), "system": end.state == AFTER_SYSTEM, "pieces": pieces}

        return _in_batches(found(), _REPORT)

    return parts.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part").mapInArrow(put_together, _REPORT_DDL)


# Repaired rows


def _edits(reports: DataFrame) -> DataFrame:
    """(part, place, output, letters, system): the edits at each row, and how many repaired rows come before them."""
    pieces = reports.select("system", F.explode("pieces").alias("p")).select("system", "p.*")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    place, output, own = r["place"] - 1, r["output"], ""
                    for letter in r["letters"]:
                        if letter != "I" and own.strip("I"):
                            yield {"part": r["part"], "place": place, "output": output, "letters": own, "system": r["system"]}
                            output, own = output + len(own) - own.count("D"), ""
                        place += letter != "I"
                        own += letter
                    yield {"part": r["part"], "place": place, "output": output, "letters": own, "system": r["system"]}

        schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("output", pa.int64()), ("letters", pa.string()), ("system", pa.bool_())])
        return _in_batches(found(), schema, 5000)

    return pieces.mapInArrow(split, "part int, place bigint, output bigint, letters string, system boolean")


def _repaired(numbered: DataFrame, reports: DataFrame) -> DataFrame:
    edited = numbered.select("part", "place", "conv_id", "role", "text").join(_edits(reports), ["part", "place"])
    letters = F.filter(F.split("letters", ""), lambda letter: ~letter.isin("D", ""))
    each = edited.select("conv_id", "role", "text", "output", "system", F.posexplode(letters).alias("i", "letter"))
    position = (F.col("output") + F.col("i")).cast("bigint")
    turn = F.when((position - F.col("system").cast("int")) % 2 == 0, "user").otherwise("assistant")
    role = F.when(F.col("letter") == "K", F.col("role")).otherwise(turn)
    text = F.when(F.col("letter") == "I", "").otherwise(F.col("text"))
    return each.select("conv_id", position.alias("position"), role.alias("role"), text.alias("text"), F.col("letter").alias("edit"))


@dataclass(frozen=True)
class Repair:
    """``reports``: one row per conversation; ``rows``: the repaired conversations (conv_id, position, role, text, edit)."""

    reports: DataFrame
    rows: DataFrame


def repair(rows: DataFrame) -> Repair:
    """Repair the conversations in ``rows`` (conv_id, turn, role, text) at the least cost.

    Reports are (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit). Rows follow each other by turn, a missing turn
    first; rows of one turn by role, then by the hash of the text. A missing role or text is one space, so such a row is blank or has a
    role that cannot be kept. Rows without conv_id are one conversation. Repeated rows are duplicates, and blank and
    duplicate rows are always deleted. A conversation without rows has no report; an empty table gives empty results. Other
    columns are ignored. No task holds the texts of a conversation, and a long one is parsed in several tasks.
    """
    numbered = _numbered(with_faults(rows))
    reports = cut_lineage(_reports(_parts(numbered)))
    gap = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    gaps = numbered.groupBy("conv_id").agg(gap).withColumnRenamed("conv_id", "_id")
    with_gaps = reports.join(gaps, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return Repair(with_gaps.select("conv_id", "gaps", *COUNTS, "cost", "audit"), _repaired(numbered, reports))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) over ``role:text`` of the repaired ``rows``, joined by line ends; texts pass by one after the other."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for (conv_id,), run in _runs(batches, "conv_id"):
                total, between = hashlib.sha256(), b""
                for row in run:
                    total.update(between + f"{row['role']}:{row['text']}".encode())
                    between = b"\n"
                yield {"conv_id": conv_id, "sha256": total.hexdigest()}

        return _in_batches(found(), pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())]))

    narrow = rows.select("conv_id", "position", "role", "text")
    ordered = narrow.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "position")
    return ordered.mapInArrow(digest, "conv_id bigint, sha256 string")

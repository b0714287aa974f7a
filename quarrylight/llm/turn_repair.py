"""Repair of conversations by Knuth's lightest derivation over an agenda.

An item says that the first ``i`` rows of a conversation have been dealt with and where in ``(s?(ua)+)?`` their roles stand.
Edits are deductions from item to item: keep, rerole, delete, insert. An item's weight is (cost, audit), the audit being the
edits' initials; every deduction adds to the cost or leaves it, and appends to the audit, so weights never fall and the order
of two weights of an item never changes by a deduction. So items popped from the agenda by weight are final, and the first
goal popped is the cheapest repair with the least audit.

Long conversations are cut into segments of ``SEGMENT`` rows, wherever they lie: a task derives a segment's edges (from each
state to each state), and a second agenda, whose deductions are whole segments, goes over a conversation's edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.shared import staged

SEGMENT = 128
#: White space, as the faults see it.
BLANKS = " \t\n\x0b\x0c\r"
#: Where the roles stand: nothing yet, behind the system row, behind a user row, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # a rerole or an insert
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("", "truncated", "blank", "duplicate")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
Weight = tuple[int, str]


def _code(fault: Column, initial: Column) -> Column:
    """A row in one letter: 4 * fault + initial, from ``a``."""
    i = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(97 + 4 * fault + i)


def _read(code: str) -> tuple[int, str]:
    fault, i = divmod(ord(code) - 97, 4)
    return fault, "sua-"[i]


def deductions(code: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, edit, state) of what can be done with a row."""
    fault, initial = _read(code)
    yield DELETE, "D", state
    if fault < 2:
        if (initial, state) in _KEPT:
            yield TRUNCATED * fault, "K", _KEPT[initial, state]
        yield REROLE + TRUNCATED * fault, "R", _NEXT[state]


@lru_cache(maxsize=50_000)
def lightest(codes: str, start: int, goals: tuple[int, ...], all_goals: bool) -> dict[int, Weight]:
    """The least weight with which ``start`` before the rows becomes each of ``goals`` behind them; only of the lightest goal unless ``all_goals``."""
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    found: dict[int, Weight] = {}
    while agenda:
        cost, audit, i, state = heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(codes) and state in goals:
            found[state] = (cost, audit)
            if not all_goals or len(found) == len(goals):
                break
        if i < len(codes):
            for more, edit, then in deductions(codes[i], state):
                if (i + 1, then) not in final:
                    heappush(agenda, (cost + more, audit + edit, i + 1, then))
        if (i, _NEXT[state]) not in final:
            heappush(agenda, (cost + INSERT, audit + "I", i, _NEXT[state]))
    return found


Edges = dict[tuple[int, int], Weight]


def edges(codes: str, whole: bool) -> Edges:
    """A segment's weight from state to state. ``whole``: it begins a conversation, so only from the start."""
    return {(p, q): w for p in ((START,) if whole else range(4)) for q, w in lightest(codes, p, (0, 1, 2, 3), True).items()}


def over_segments(segments: list[Edges]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the lightest derivation, and for each segment the state before it and its part of the audit."""
    agenda: list[tuple[int, str, int, int, tuple | None]] = [(0, "", 0, START, None)]
    final: set[tuple[int, int]] = set()
    while agenda:
        cost, audit, k, state, back = heappop(agenda)
        if (k, state) in final:
            continue
        final.add((k, state))
        if k == len(segments):
            if state in GOALS:
                parts = []
                while back is not None:
                    before, part, back = back
                    parts.append((before, part))
                return cost, parts[::-1]
            continue
        for (p, q), (more, part) in segments[k].items():
            if p == state and (k + 1, q) not in final:
                heappush(agenda, (cost + more, audit + part, k + 1, q, _Back((state, part, back))))
    raise AssertionError("deleting every row is always a derivation")


class _Back(tuple):
    """A way back; equal to any other, so that weights alone order the agenda."""

    __lt__ = __gt__ = lambda self, other: False


def apply(state: int, audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The (role, text) that the edits make of a segment's rows."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            out.append((_ROLE[state], ""))
            continue
        role, text = rows[at]
        at += 1
        if edit == "R":
            state = _NEXT[state]
            out.append((_ROLE[state], text))
        elif edit == "K":
            state = _KEPT[role[:1], state]
            out.append((role, text))
    return out


# ---- the operator -------------------------------------------------------------------------------------------------


class Repaired(NamedTuple):
    """``report``: a row for each conversation; ``rows``: (key, seg, place, role, text), the repaired conversations, ordered by ``seg`` and ``place``."""

    report: DataFrame
    rows: DataFrame


def _turns(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with the number of their fault, a salt telling equal rows apart; ``some`` and ``at_turn`` order nulls first."""
    space = F.lit(" ")
    rows = conversations.select(
        F.col(key).alias("k"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
        F.col(turn).isNotNull().alias("some"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("at_turn"), F.monotonically_increasing_id().alias("salt"),
    )
    return staged(rows.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "turns")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their letter, in order: ``seg`` ascends along a conversation, ``at`` within a segment. One conversation may lie in any number of tasks."""
    first = rows.groupBy("k", "said").agg(F.min(F.struct("some", "at_turn", "salt")).alias("first"))
    first = first.select(F.col("k").alias("k_"), F.col("said").alias("said_"), F.col("first.salt").alias("first"))
    again = rows.join(first, F.col("k").eqNullSafe(F.col("k_")) & (F.col("said") == F.col("said_"))).withColumn("again", F.col("first") != F.col("salt"))
    solid = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(solid == "", 2).when(F.col("again"), 3).when(F.right(solid, F.lit(1)).isin(*".!?"), 0).otherwise(1)
    # ties go by role and text: their beginnings (keys of bounded size) and a hash
    coded = again.select("k", "role", "text", "some", "at_turn", F.left("role", F.lit(16)).alias("r"), F.left("text", F.lit(64)).alias("x"), F.xxhash64("said").alias("h"), "salt", _code(fault, F.left("role", F.lit(1))).alias("code"))
    order = ["k", "some", "at_turn", "r", "x", "h", "salt"]
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "k", "role", "text", "code")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen, seg, head = None, -1, -1, False  # of the row before: its key (in a tuple), place in its segment, segment, whether that begins a conversation
        for b in batches:
            segs, ats, heads = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int32), np.empty(b.num_rows, bool)
            for n, k in enumerate(b.column(1).to_pylist()):
                if before is None or before[0] != k:
                    head, before, seen, seg = before is not None, (k,), -1, seg + 1  # a task's first rows may go on where another's end
                elif seen + 1 == SEGMENT:
                    head, seen, seg = False, -1, seg + 1
                seen += 1
                segs[n], ats[n], heads[n] = seg, seen, head
            part = b.column(0).to_numpy() << 32
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(part + segs), pa.array(ats), pa.array(heads), *b.columns[2:]], names=["k", "seg", "at", "head", "role", "text", "code"])

    kind = rows.schema["k"].dataType.simpleString()
    return staged(dealt.mapInArrow(cut, f"k {kind}, seg long, at int, head boolean, role string, text string, code string"), "ordered-turns")


_EDGES = "array<struct<p: int, q: int, cost: long, audit: string>>"
_EDGE_TYPE = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PART_TYPE = pa.list_(pa.struct([("seg", pa.int64()), ("state", pa.int32()), ("audit", pa.string())]))


def _derived(segments: DataFrame) -> DataFrame:
    """(k, seg, codes) with each segment's edges."""

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [[{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in edges(codes, head).items()] for codes, head in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, _EDGE_TYPE)], names=["k", "seg", "codes", "edges"])

    kind = segments.schema["k"].dataType.simpleString()
    return segments.mapInArrow(derive, f"k {kind}, seg long, codes string, edges {_EDGES}")


def _counts(segments: list[str]) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated rows and neighbours whose roles may not follow each other."""
    counts, illegal, before = [0] * 4, 0, ""
    for codes in segments:
        for c in codes:
            fault, initial = _read(c)
            counts[fault] += 1
            illegal += before != "" and before + initial not in ("su", "ua", "au")
            before = initial
    return counts[2], counts[3], counts[1], illegal


def _finished(derived: DataFrame) -> DataFrame:
    whole = derived.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("seg", "codes", "edges"))).alias("segments"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(at, 64) for at in range(0, big.num_rows, 64)):
                numbers, audits, parts = [], [], []
                for segments in b.column(1).to_pylist():
                    cost, way = over_segments([{(e["p"], e["q"]): (e["cost"], e["audit"]) for e in s["edges"]} for s in segments])
                    numbers.append((*_counts([s["codes"] for s in segments]), cost))
                    audits.append("".join(part for _, part in way))
                    parts.append([{"seg": s["seg"], "state": state, "audit": part} for s, (state, part) in zip(segments, way, strict=True)])
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)), pa.array(audits), pa.array(parts, _PART_TYPE)], names=["k", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "parts"])

    kind = derived.schema["k"].dataType.simpleString()
    return staged(whole.mapInArrow(finish, f"k {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<seg: long, state: int, audit: string>>"), "audits")


def _repaired(ordered: DataFrame, finished: DataFrame) -> DataFrame:
    said = ordered.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("rows"))
    parts = finished.select("k", F.explode("parts").alias("p")).select("k", "p.seg", "p.state", "p.audit")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for big in batches:
            kind = big.schema.field("k").type
            for b in (big.slice(at, 16) for at in range(0, big.num_rows, 16)):
                out = [(k, seg, n, role, text) for k, seg, state, audit, rows in zip(*(c.to_pylist() for c in b.columns), strict=True) for n, (role, text) in enumerate(apply(state, audit, [(r["role"], r["text"]) for r in rows]))]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], names=["k", "seg", "place", "role", "text"])

    kind = finished.schema["k"].dataType.simpleString()
    return parts.join(said, "seg").select("k", "seg", "state", "audit", "rows").mapInArrow(edit, f"k {kind}, seg long, place int, role string, text string")


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by ``k``, null being a key."""
    return left.join(right.withColumnRenamed("k", "k_"), F.col("k").eqNullSafe(F.col("k_")), "left").drop("k_")


def repair(conversations: DataFrame, every: DataFrame | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Faults and the cheapest repair of each conversation, and its repaired rows.

    The report has (key, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each key of ``conversations`` or, if
    given, of ``every``; those without rows have zeros and an empty audit. A null role or text is one space; a null key is a
    conversation; null turns come first; rows of one turn go by role and the first 64 characters of the text; repeated rows
    are duplicates, all but the first; an empty table gives no rows; other columns are ignored.

    Rows are ordered by range, so one conversation may have any share of them; its audit and its edges, some 16 bytes a row,
    still meet in one task, as the audit is a single string.
    """
    rows = _turns(conversations, key, turn, role, text)
    ordered = _ordered(rows)
    segments = ordered.groupBy("k", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes"), F.max("head").alias("head"))
    finished = _finished(_derived(segments))
    turns = rows.groupBy("k", "turn").agg(F.count("*").alias("n")).groupBy("k").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    keys = (conversations if every is None else every).select(F.col(key).alias("k")).distinct()
    report = _with(_with(keys, turns), finished)
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return Repaired(report.select(F.col("k").alias(key), *numbers, F.coalesce("audit", F.lit("")).alias("audit")), _repaired(ordered, finished).withColumnRenamed("k", key))


def digests(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, repaired_sha256) of repaired rows: ``role:text`` joined by newlines. A conversation's hash goes over all of it in order; its rows pass by, none is kept."""
    dealt = rows.select(F.col(key).alias("k"), "seg", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("k").sortWithinPartitions("k", "seg", "place")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, h, kind = None, None, None

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([x for _, x in done], pa.string())], names=["k", "repaired_sha256"])

        for b in batches:
            kind, done = b.schema.field("k").type, []
            for k, line in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if before is not None and before[0] == k:
                    h.update(b"\n")
                else:
                    if before is not None:
                        done.append((before[0], h.hexdigest()))
                    before, h = (k,), hashlib.sha256()
                h.update(line.encode())
            if done:
                yield out(done)
        if before is not None:
            yield out([(before[0], h.hexdigest())])

    kind = rows.schema[key].dataType.simpleString()
    return dealt.mapInArrow(digest, f"k {kind}, repaired_sha256 string").withColumnRenamed("k", key)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with known faults, by CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its end marks, 3 repeats it, 4 makes its role user."""
    whole = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(whole["conv_id"], F.lit(":"), whole["turn"])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(whole["text"], "[.!?]", "")).otherwise(whole["text"])
    role = F.when(kind == 4, "user").otherwise(whole["role"])
    rows = conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("_times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "_times")).alias("_copy")).drop("_copy")

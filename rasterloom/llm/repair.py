"""Operator 12: repair of conversations by a time-major tensor dynamic program.

A repaired conversation's role initials read ``(s?(ua)+)?``. Its rows may be kept (0), get another role (user or
assistant, 1) or be deleted (2, the only way for blank and duplicate rows), and empty user and assistant rows may be inserted
anywhere (5 each); a truncated row that stays costs 5 more. Four states tell what stands last: nothing, a first
system row, a user row, an assistant row.

Tables are sorted by conversation and turn over ranges, so tasks get even shares however long one conversation is. A task buckets
its conversations by length, and updates the backward costs of all conversations of a bucket turn by turn
(``back``); the stored costs then lead all of them forward at once to the cheapest edits (``trace``), the
ASCII-least of equal ones. A long conversation is cut into blocks that are columns of the same tensors: a block's costs from
state to state are a matrix, min-plus products of these give the costs behind each block, and every block is traced from
all four states. Conversations that reach over a range's end (two a task at most) go the same way with a matrix for each
piece; only these matrices reach the driver. Their digest passes through one task as a stream, since SHA-256 and an edit string are sequential.

A row's first fault counts: blank (nothing but spaces and the control characters 9 to 13), duplicate (role and text
seen earlier in the conversation), truncated (the last other character isn't one of ``.!?``). Null roles and texts are one space, null conversation
ids are one conversation, null turns come first; rows of one turn come by role and the text's SHA-256; empty and
very long texts are texts like any other; repeated rows are duplicates; an empty table gives an empty result. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, tidy

FAR = 1 << 40  # more than any cost
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
CLEAN, BLANK, DUPLICATE, CUT, PAD = range(5)
INTO = np.array([2, 2, 3, 2])  # the state after an inserted or changed row, by state
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # after a kept row, by state and initial (s, u, a, other)
DONE = np.array([0, FAR, FAR, 0])  # a conversation may end where nothing or an assistant row stands last
INITIALS = {"s": 0, "u": 1, "a": 2}
CHUNK_ROWS, CHUNK_CHARS = 1 << 14, 1 << 22
LONG = 1 << 11  # rows from which on a conversation is cut into blocks


def with_inserts(e: np.ndarray) -> np.ndarray:
    """Costs where rows may be inserted first."""
    w = e.copy()
    w[..., 2] = np.minimum(e[..., 2], e[..., 3] + INSERT)
    w[..., 3] = np.minimum(e[..., 3], e[..., 2] + INSERT)
    w[..., :2] = np.minimum(e[..., :2], w[..., 2:3] + INSERT)
    return w


def _price(fault: np.ndarray) -> np.ndarray:
    return np.where(fault == CUT, TRUNCATED, np.where(fault == CLEAN, 0, FAR))


def back(kind: np.ndarray, fault: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs from each turn on, (turns + 1, conversations, states), of conversations (turns, conversations) and the
    costs behind them (conversations, states)."""
    costs = np.empty((len(kind) + 1, *end.shape), np.int64)
    costs[-1] = end
    for t in range(len(kind) - 1, -1, -1):
        after, price = costs[t + 1], _price(fault[t])[:, None]
        to = KEPT[:, kind[t]].T
        keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), FAR) + price
        best = np.minimum(np.minimum(after + DELETE, after[:, INTO] + price + REROLE), keep)
        costs[t] = np.where((fault[t] == PAD)[:, None], after, np.minimum(with_inserts(best), FAR))
    return costs


def trace(kind: np.ndarray, fault: np.ndarray, costs: np.ndarray, state: np.ndarray, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(edits, states behind): the cheapest edits from ``state`` on, (turns + 1, 3, conversations) with up to two
    inserts before each row's own edit; ``last`` allows inserts at the end."""
    turns, n = kind.shape
    edits, every, state = np.zeros((turns + 1, 3, n), np.uint8), np.arange(n), state.copy()
    for t in range(turns + 1):
        now = costs[t]
        after = costs[t + 1] if t < turns else None
        live = fault[t] != PAD if t < turns else np.full(n, last)
        for slot in (0, 1):
            insert = live & (now[every, INTO[state]] + INSERT == now[every, state])
            if after is not None:
                insert &= after[every, state] + DELETE != now[every, state]
            edits[t, slot][insert] = ord("I")
            state = np.where(insert, INTO[state], state)
        if after is None:
            break
        own, to = now[every, state], KEPT[state, kind[t]]
        delete = after[every, state] + DELETE == own
        keep = ~delete & (to >= 0) & (after[every, np.maximum(to, 0)] + _price(fault[t]) == own)
        edits[t, 2] = np.where(live, np.where(delete, ord("D"), np.where(keep, ord("K"), ord("R"))), 0)
        state = np.where(live & ~delete, np.where(keep, to, INTO[state]), state)
    return edits, state


class Blocks:
    """A long stretch of rows as columns of a tensor."""

    def __init__(self, kind: np.ndarray, fault: np.ndarray):
        self.rows = len(kind)
        length = max(1, isqrt(self.rows))
        self.n = max(1, -(-self.rows // length))
        fill = self.n * length - self.rows
        self.kind = np.pad(kind, (0, fill)).reshape(self.n, length).T
        self.fault = np.pad(fault, (0, fill), constant_values=PAD).reshape(self.n, length).T
        ends = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (self.n, 1))
        self.between = back(np.repeat(self.kind, 4, 1), np.repeat(self.fault, 4, 1), ends)[0].reshape(self.n, 4, 4)  # block, to, from

    def transfer(self) -> np.ndarray:
        """Costs (to, from) through the whole stretch."""
        whole = self.between[0]
        for m in self.between[1:]:
            whole = np.minimum((whole[None, :, :] + m[:, :, None]).min(1), FAR)
        return whole

    def solve(self, end: np.ndarray) -> None:
        """Trace every block from every state, with the costs ``end`` behind the stretch."""
        behind = np.empty((self.n + 1, 4), np.int64)
        behind[-1] = end
        for b in range(self.n - 1, -1, -1):
            behind[b] = np.minimum((self.between[b] + behind[b + 1][:, None]).min(0), FAR)
        costs = back(self.kind, self.fault, behind[1:])
        self.costs, self.end = behind[0], end
        self.edits, out = trace(np.repeat(self.kind, 4, 1), np.repeat(self.fault, 4, 1), np.repeat(costs, 4, 1), np.tile(np.arange(4), self.n), last=False)
        self.out = out.reshape(self.n, 4)

    def behind(self, state: int) -> int:
        """The state behind the stretch, from the state before it."""
        for row in self.out:
            state = int(row[state])
        return state

    def walk(self, state: int, last: bool) -> np.ndarray:
        """Edits, (rows + 1, 3), from the state before the stretch on."""
        parts = []
        for b in range(self.n):
            parts.append(self.edits[:-1, :, 4 * b + state])
            state = int(self.out[b][state])
        edits = np.concatenate(parts)[: self.rows]
        none = np.zeros((0, 1), np.int8)
        return np.concatenate([edits, trace(none, none, self.end[None, None, :], np.array([state]), last)[0][:, :, 0]])


def solve(starts: np.ndarray, kind: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(cost, edits (rows + 1, 3)) of whole conversations that begin at ``starts``; one beyond the last is the end."""
    lengths = np.diff(starts)
    costs, edits = np.zeros(len(lengths), np.int64), [np.empty(0)] * len(lengths)
    end = with_inserts(DONE)
    size = np.frexp(np.maximum(lengths - 1, 0))[1]  # buckets: lengths up to 1, 2, 4, 8 and so on
    for bucket in np.unique(size):
        which = np.flatnonzero(size == bucket)
        if lengths[which].max() > LONG:
            for j in which:
                blocks = Blocks(kind[starts[j] : starts[j + 1]], fault[starts[j] : starts[j + 1]])
                blocks.solve(end)
                costs[j], edits[j] = blocks.costs[0], blocks.walk(0, True)
            continue
        turns = int(lengths[which].max())
        at = starts[which] + np.arange(turns)[:, None]
        there = np.arange(turns)[:, None] < lengths[which]
        at = np.where(there, at, 0)
        k, f = kind[at], np.where(there, fault[at], PAD)
        w = back(k, f, np.tile(end, (len(which), 1)))
        found, _ = trace(k, f, w, np.zeros(len(which), np.int64))
        costs[which] = w[0, :, 0]
        for i, j in enumerate(which):
            n = lengths[j]
            edits[j] = np.concatenate([found[:n, :, i], found[turns:, :, i]])
    return costs, edits


def edited(edits: np.ndarray, roles: list[str], texts: list[str], state: int = 0) -> Iterator[tuple[str, int | None, str | None, str | None]]:
    """(edit, row, role, text) of a conversation, deleted rows without role and text, inserted ones without a row."""
    user_last = state == 2
    for place in np.flatnonzero(edits.ravel()):
        edit, row = chr(edits.ravel()[place]), int(place) // 3
        if edit == "D":
            yield edit, row, None, None
            continue
        role = roles[row] if edit == "K" else "assistant" if user_last else "user"
        user_last = role[:1] == "u"
        yield edit, None if edit == "I" else row, role, "" if edit == "I" else texts[row]


def _sort(rows: DataFrame) -> DataFrame:
    """Rows in ranges of (conversation, turn), with the number of their range, written to the shared folder."""
    order = ["k", "turn", "role", "sha", "id"]
    return durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))


def _fault(seen: Column) -> Column:
    text = F.expr("trim(TRAILING ' \t\n\u000b\f\r' FROM text)")
    return F.when(text == "", BLANK).when(seen, DUPLICATE).when(F.right(text, F.lit(1)).isin(".", "!", "?"), CLEAN).otherwise(CUT)


def _prepared(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    one_space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    named = rows.select(F.col(key).alias("k"), F.col(turn).alias("turn"), one_space(role).alias("role"), one_space(text).alias("text"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return named.withColumn("kind", kind).withColumn("fault", _fault(F.lit(False))).withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("id", F.monotonically_increasing_id())


def spanning(ordered: DataFrame) -> list[Any]:
    """Conversations that are in more than one range: two a range at most, of which as many reach the driver."""
    k = F.struct(F.col("k").isNotNull().alias("known"), F.col("k").alias("k"))
    ends = ordered.groupBy("pid").agg(F.min(k).alias("a"), F.max(k).alias("b")).collect()
    held: dict[Any, set[int]] = {}
    for r in ends:
        for side in ("a", "b"):
            held.setdefault(r[side]["k"], set()).add(r["pid"])
    return [k for k, pids in held.items() if len(pids) > 1]


def _one_of(keys: list[Any]) -> Column:
    known = [k for k in keys if k is not None]
    found = F.coalesce(F.col("k").isin(known), F.lit(False)) if known else F.lit(False)
    return found | F.col("k").isNull() if None in keys else found


def _conversations(batches: Iterator[pa.RecordBatch], columns: list[str], chars: bool = True) -> Iterator[tuple[np.ndarray, dict[str, list]]]:
    """Chunks of whole runs of one conversation: (starts and the end, columns)."""
    held: dict[str, list] = {c: [] for c in columns}
    size = 0

    def cut() -> np.ndarray:
        k = held["k"]
        return np.array([0, *(i for i in range(1, len(k)) if k[i] != k[i - 1])])

    for batch in batches:
        for c in columns:
            held[c] += batch.column(c).to_pylist()
        size += batch.column("text").nbytes if chars else 0
        if len(held["k"]) >= CHUNK_ROWS or size >= CHUNK_CHARS:
            starts = cut()
            if len(starts) > 1:  # the last may go on
                end = int(starts[-1])
                yield starts, {c: held[c][:end] for c in columns}
                held, size = {c: held[c][end:] for c in columns}, 0
    if held["k"]:
        yield np.append(cut(), len(held["k"])), held


def _seen(starts: np.ndarray, rows: dict[str, list]) -> np.ndarray:
    """Faults, with duplicates inside each conversation."""
    fault = np.array(rows["fault"], np.int8)
    for a, b in zip(starts[:-1], starts[1:]):
        known = set()
        for i in range(a, b):
            pair = rows["role"][i], rows["text"][i]
            if pair in known and fault[i] != BLANK:
                fault[i] = DUPLICATE
            known.add(pair)
    return fault


_EDIT = "edit string, row_turn {turn}, role string, text string, fault int, kind int"


def _edit_type(df: DataFrame) -> str:
    return f"k {df.schema['k'].dataType.simpleString()}, pid int, n long, " + _EDIT.format(turn=df.schema["turn"].dataType.simpleString())


def _edit_batch(df_types: tuple[pa.DataType, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [df_types[0], pa.int32(), pa.int64(), pa.string(), df_types[1], pa.string(), pa.string(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["k", "pid", "n", "edit", "row_turn", "role", "text", "fault", "kind"])


COLUMNS = ["k", "turn", "role", "text", "kind", "fault"]


def _whole_edits(ordered: DataFrame) -> DataFrame:
    """Edits of conversations inside one range."""
    types = to_arrow_type(ordered.schema["k"].dataType), to_arrow_type(ordered.schema["turn"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, rows in _conversations(batches, COLUMNS):
            fault, kind = _seen(starts, rows), np.array(rows["kind"], np.int8)
            out = []
            for a, b, edits in zip(starts[:-1], starts[1:], solve(starts, kind, fault)[1]):
                for n, (edit, at, role, text) in enumerate(edited(edits, rows["role"][a:b], rows["text"][a:b])):
                    row = (rows["turn"][a + at], role, text, int(fault[a + at]), int(kind[a + at])) if at is not None else (None, role, text, None, None)
                    out.append((rows["k"][a], 0, n, edit, *row))
            yield _edit_batch(types, out)

    return ordered.select(*COLUMNS).mapInArrow(tidy(run), _edit_type(ordered))


_REPORT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT_NAMES = ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_FOLLOWS = np.zeros((4, 4), bool)
_FOLLOWS[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au


def _report_batch(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 5, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["k", *_REPORT_NAMES])


def _whole_reports(ordered: DataFrame) -> DataFrame:
    """Reports of conversations inside one range."""
    key = to_arrow_type(ordered.schema["k"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, rows in _conversations(batches, COLUMNS):
            fault, kind = _seen(starts, rows), np.array(rows["kind"], np.int8)
            counts = [np.add.reduceat(fault == f, starts[:-1]) for f in (BLANK, DUPLICATE, CUT)]
            odd = np.append(False, ~_FOLLOWS[kind[:-1], kind[1:]])
            odd[starts[:-1]] = False
            counts.append(np.add.reduceat(odd, starts[:-1]))
            costs, edits = solve(starts, kind, fault)
            out = []
            for j, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                lines = [f"{role}:{text}" for _, _, role, text in edited(edits[j], rows["role"][a:b], rows["text"][a:b]) if role is not None]
                flat = edits[j].ravel()
                out.append((rows["k"][a], *(int(c[j]) for c in counts), int(costs[j]), flat[flat > 0].tobytes().decode(), hashlib.sha256("\n".join(lines).encode()).hexdigest()))
            yield _report_batch(key, out)

    return ordered.select(*COLUMNS).mapInArrow(tidy(run), f"k {ordered.schema['k'].dataType.simpleString()}, {_REPORT}")


def _piece_edits(hot: DataFrame) -> tuple[DataFrame, dict[Any, int]]:
    """(edits of conversations that are in many ranges, their costs), piece by piece."""
    same = F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.sha") == F.col("b.sha"))
    firsts = hot.groupBy("k", "role", "sha").agg(F.min(F.struct("turn", "id")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    joined = hot.alias("a").join(firsts.alias("b"), same, "left")
    seen = F.coalesce(F.struct("a.turn", "a.id") > F.col("b.first"), F.lit(False))
    marked = joined.withColumn("seen", seen).select("a.k", "a.turn", "a.role", "a.text", "a.kind", "a.sha", "a.id", "seen").withColumn("fault", _fault(F.col("seen"))).drop("seen")
    ordered = _sort(marked)
    key_sql, key = ordered.schema["k"].dataType.simpleString(), to_arrow_type(ordered.schema["k"].dataType)
    types = key, to_arrow_type(ordered.schema["turn"].dataType)
    small = ordered.select("k", "pid", "kind", "fault")

    def pieces(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[Any, int, Blocks, dict[str, list]]]:
        for starts, rows in _conversations(batches, columns, "text" in columns):
            for a, b in zip(starts[:-1], starts[1:]):
                own = {c: rows[c][a:b] for c in columns}
                yield own["k"][0], own["pid"][0], Blocks(np.array(own["kind"], np.int8), np.array(own["fault"], np.int8)), own

    def numbers(batches: Iterator[pa.RecordBatch], what) -> Iterator[pa.RecordBatch]:
        for k, pid, blocks, _ in pieces(batches, ["k", "pid", "kind", "fault"]):
            yield pa.RecordBatch.from_arrays([pa.array([k], key), pa.array([pid], pa.int32()), pa.array([what(k, pid, blocks)], pa.list_(pa.int64()))], names=["k", "pid", "v"])

    schema = f"k {key_sql}, pid int, v array<bigint>"
    found = small.mapInArrow(tidy(lambda b: numbers(b, lambda k, pid, blocks: blocks.transfer().ravel())), schema).collect()
    chains: dict[Any, list[tuple[int, np.ndarray]]] = {}
    for k, pid, v in sorted(found, key=lambda r: r[1]):
        chains.setdefault(k, []).append((pid, np.array(v).reshape(4, 4)))
    ends: dict[tuple[Any, int], np.ndarray] = {}
    total: dict[Any, int] = {}
    for k, chain in chains.items():
        now = with_inserts(DONE)
        for pid, m in chain[::-1]:
            ends[k, pid] = now
            now = np.minimum((m + now[:, None]).min(0), FAR)
        total[k] = int(now[0])

    def exits(k: Any, pid: int, blocks: Blocks) -> list[int]:
        blocks.solve(ends[k, pid])
        return [blocks.behind(s) for s in range(4)]

    found = small.mapInArrow(tidy(lambda b: numbers(b, exits)), schema).collect()
    leads = {(k, pid): v for k, pid, v in found}
    entry: dict[tuple[Any, int], int] = {}
    for k, chain in chains.items():
        state = 0
        for pid, _ in chain:
            entry[k, pid] = state
            state = leads[k, pid][state]
    finals = {(k, chain[-1][0]) for k, chain in chains.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, pid, blocks, rows in pieces(batches, [*COLUMNS, "pid"]):
            blocks.solve(ends[k, pid])
            edits, out = blocks.walk(entry[k, pid], (k, pid) in finals), []
            for n, (edit, at, role, text) in enumerate(edited(edits, rows["role"], rows["text"], entry[k, pid])):
                row = (rows["turn"][at], role, text, rows["fault"][at], rows["kind"][at]) if at is not None else (None, role, text, None, None)
                out.append((k, pid, n, edit, *row))
                if len(out) == CHUNK_ROWS:
                    yield _edit_batch(types, out)
                    out = []
            if out:
                yield _edit_batch(types, out)

    return ordered.select(*COLUMNS, "pid").mapInArrow(tidy(run), _edit_type(ordered)), total


def _streamed_reports(edits: DataFrame, total: dict[Any, int]) -> DataFrame:
    """Reports from edits: each conversation is a stream of batches through one task."""
    key = to_arrow_type(edits.schema["k"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []

        def row() -> tuple:
            k, counts, audit, digest, _ = now
            return (k, *counts, total[k], "".join(audit), digest.hexdigest())

        for batch in batches:
            done = []
            for k, edit, role, text, fault, kind in zip(*(batch.column(c).to_pylist() for c in ("k", "edit", "role", "text", "fault", "kind"))):
                if not now or k != now[0]:
                    if now:
                        done.append(row())
                    now = [k, [0, 0, 0, 0], [], hashlib.sha256(), (None, True)]
                before, first = now[4]
                if kind is not None:
                    if fault:
                        now[1][fault - 1] += 1
                    now[1][3] += before is not None and not _FOLLOWS[before, kind]
                    before = kind
                now[2].append(edit)
                if role is not None:
                    now[3].update((("" if first else "\n") + f"{role}:{text}").encode())
                    first = False
                now[4] = before, first
            if done:
                yield _report_batch(key, done)
        if now:
            yield _report_batch(key, [row()])

    return edits.repartition("k").sortWithinPartitions("k", "pid", "n").mapInArrow(tidy(run), f"k {edits.schema['k'].dataType.simpleString()}, {_REPORT}")


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations with their edits: (key, piece, n, edit, turn, role, text, fault), to be read by
    (piece, n) within a conversation; deleted rows have no role and text, inserted ones no turn and fault."""
    ordered = _sort(_prepared(rows, key, turn, role, text))
    across = spanning(ordered)
    out = _whole_edits(ordered.where(~_one_of(across)))
    if across:
        out = out.unionByName(_piece_edits(ordered.where(_one_of(across)))[0])
    fault = F.element_at(F.array(*[F.lit(x) for x in ("", "blank", "duplicate", "truncated")]), F.col("fault") + 1)
    return out.select(F.col("k").alias(key), F.col("pid").alias("piece"), "n", "edit", F.col("row_turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text), fault.alias("fault"))


def repair_report(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
    ordered = _sort(_prepared(rows, key, turn, role, text))
    across = spanning(ordered)
    out = _whole_reports(ordered.where(~_one_of(across)))
    if across:
        out = out.unionByName(_streamed_reports(*_piece_edits(ordered.where(_one_of(across)))))
    turns = ordered.groupBy("k", "turn").agg(F.lit(1).alias("one")).groupBy("k").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    both = out.alias("a").join(turns.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")))
    return both.select(F.col("a.k").alias(key), F.coalesce("b.gaps", F.lit(0).cast("long")).alias("gaps"), *[F.col(f"a.{c}").alias(c) for c in _REPORT_NAMES])

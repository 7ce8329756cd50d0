"""Conversation repair against every sequence of edits, in one range and over many."""

import functools
import hashlib
import random
import re

import pytest

from rasterloom.llm import repair

BLANKS = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, edits) by trying all edits; rows of (initial, fault)."""

    @functools.lru_cache(None)
    def go(i, state, inserts):
        ways = []
        grown = "a" if state == "u" else "u"
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, ""))
        else:
            initial, fault = rows[i]
            options = [(2, "D", state)]
            if fault in ("", "truncated"):
                more = 5 * (fault != "")
                if (initial == "s" and state == "") or (initial == "u" and state != "u") or (initial == "a" and state == "u"):
                    options.append((more, "K", initial))
                options.append((1 + more, "R", grown))
            for cost, edit, after in options:
                rest = go(i + 1, after, 0)
                ways.append((cost + rest[0], edit + rest[1]))
        if inserts < 3:
            rest = go(i, grown, inserts + 1)
            ways.append((5 + rest[0], "I" + rest[1]))
        return min(ways, default=(1 << 40, ""))

    return go(0, "", 0)


def plain(rows):
    """The report of each conversation; rows of (conv_id, turn, role, text)."""
    rows = [(k, t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    out = {}
    for k in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == k]
        seen, faults = set(), []
        for _, role, text in own:
            end = text.rstrip(BLANKS)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = cheapest(tuple(zip(initials, faults)))
        lines, at = [], 0
        for e in audit:
            last = lines[-1][0] if lines else ""
            if e in "RI":
                lines.append(("assistant" if last[:1] == "u" else "user", "" if e == "I" else own[at][2]))
            elif e == "K":
                lines.append(own[at][1:])
            at += e != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
        out[k] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def made(rng, conversations, longest):
    rows = []
    for k in conversations:
        turn = rng.choice([0, 3])
        for _ in range(rng.randint(1, longest)):
            text = rng.choice(["Yes.", "No!", "Why", "", None, " \n\x0b", "Ünd so?\r\n", "a b ", f"Text {rng.random()}.", f"Cut {rng.random()}"])
            rows.append((k, rng.choice([turn, None]) if rng.random() < 0.1 else turn, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "u"]), text))
            turn += rng.choice([1, 1, 1, 0, 4])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as k", "2 as fault", "3 as pid", "4 as audit")
    return {r[0]: tuple(r)[1:] for r in repair.repair_report(df).collect()}


def test_equals_all_edits(spark):
    rows = made(random.Random(1), [None, *range(150)], 9)
    assert got(spark, rows) == plain(rows)


@pytest.fixture
def many_ranges(spark):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_long_conversations_are_split(spark, many_ranges, monkeypatch):
    rng = random.Random(2)
    rows = made(rng, [7], 500) + made(rng, [7] * 3, 300) + made(rng, [None] * 2, 200) + made(rng, range(8, 20), 30)
    rng.shuffle(rows)
    ordered = repair._sort(repair._prepared(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text"))
    assert 7 in repair.spanning(ordered)
    assert got(spark, rows) == plain(rows)


def test_blocks_equal_one_tensor(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 40, 60)
    starts = np.append(0, np.cumsum(sizes))
    kind, fault = rng.integers(0, 4, starts[-1]).astype(np.int8), rng.choice([0, 0, 1, 2, 3], starts[-1]).astype(np.int8)
    whole = repair.solve(starts, kind, fault)
    monkeypatch.setattr(repair, "LONG", 3)
    cut = repair.solve(starts, kind, fault)
    assert (whole[0] == cut[0]).all() and all((a == b).all() for a, b in zip(whole[1], cut[1]))


def test_repaired_rows(spark, many_ranges):
    rng = random.Random(5)
    rows = made(rng, [1] * 2, 200) + made(rng, range(2, 30), 8)
    edits = repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "piece", "n").collect()
    want = plain(rows)
    for k in want:
        own = [r for r in edits if r["conv_id"] == k]
        assert "".join(r["edit"] for r in own) == want[k][6]
        text = "\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == want[k][7]


def test_empty(spark):
    assert got(spark, []) == {}

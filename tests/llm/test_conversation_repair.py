"""Repaired conversations against a plain dynamic programme over strings."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tallyfold.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
STEPS = {0: "u", 1: "u", 2: "a", 3: "u"}  # what may be put in from each state; a system turn only from the first
AFTER = {"u": 2, "a": 3}


def least(symbols: bytes) -> tuple[int, str]:
    """Costs and letters of all four states, from the last turn to the first."""

    def insert(v):
        for _ in range(4):
            v = [min(v[s], (v[AFTER[STEPS[s]]][0] + 3, "I" + v[AFTER[STEPS[s]]][1])) for s in range(4)]
        return v

    never = (10**9, "")
    v = insert([(0, ""), never, never, (0, "")])
    for c in reversed(symbols):
        kind, role = divmod(c, 4)
        new = []
        for s in range(4):
            ways = [(v[s][0] + 4, "D" + v[s][1])]
            if kind < 2:
                more, onto = 3 * kind, v[AFTER[STEPS[s]]]
                ways.append((onto[0] + 3 + more, "R" + onto[1]))
                if "sua"[role : role + 1] == STEPS[s]:
                    ways.append((onto[0] + more, "K" + onto[1]))
                if role == 0 and s == 0:
                    ways.append((v[1][0] + more, "K" + v[1][1]))
            new.append(min(ways))
        v = insert(new)
    return v[0]


def test_tables_equal_plain_costs():
    rng, t = random.Random(3), cr.tables()
    for n in range(30):
        for _ in range(60):
            symbols = bytes(rng.choice([rng.randrange(16), 1, 2]) for _ in range(n))
            assert t.repair(symbols) == least(symbols)


def expected(rows):
    """Reports of rows (conv_id, turn, role, text) as they are."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows if r[0] == conv))
        symbols, seen, counts = [], set(), [0, 0, 0, 0]
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            kind = 2 if not bare else 3 if (role, text) in seen else 0 if bare[-1] in ".!?" else 1
            seen.add((role, text))
            counts[kind] += 1
            symbols.append(4 * kind + ("sua".index(role[0]) if role and role[0] in "sua" else 3))
        turns = [r[1] for r in own if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = least(bytes(symbols))
        lines, rest, state = [], iter(own), 0
        for letter in audit:
            row = next(rest) if letter != "I" else (0, 0, "", "")
            if letter == "D":
                continue
            if letter == "K" and row[2][:1] == "s":
                state = 1
            else:
                state = AFTER[STEPS[state]]
            lines.append((row[2] if letter == "K" else {2: "user", 3: "assistant"}[state]) + ":" + row[3])
        out[conv] = (gaps, counts[2], counts[3], counts[1], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def reported(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv_id", *cr.COUNTS, "audit", "repaired_sha256").collect()}


def made_rows(seed: int, most: int = 12) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "no", "What? ", "", " \t\n", None, "é!\x0b", "a.b", "ok ", "x" * 3000 + ".", "x" * 3000 + "?"]
    rows = []
    for conv in [None, *range(60)]:
        turn = 0
        for _ in range(rng.randrange(most)):
            turn += rng.choice([0, 1, 1, 1, 2, 5])
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice(texts)))
    return rows + rng.sample(rows, 10)


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_equal_brute_force(spark, seed):
    rows = made_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "text as lead", "1 as symbol", "2 as part", "'x' as audit", "3 as _cr_id", "0 as first").repartition(3)
    assert reported(cr.repair_report(df, df)) == expected(rows)


def test_a_long_conversation_is_spread_and_whole(spark):
    rng = random.Random(9)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{i}.", ""])) for i in range(5000)] + [(i, 0, "user", "q?") for i in range(100, 150)]
    df = spark.createDataFrame(rows, SCHEMA)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "300"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert len({r["part"] for r in cr.pieces(df).where("conv_id = 7").select("part").collect()}) > 1
        assert reported(cr.repair_report(df, df)) == expected(rows)
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_repaired_turns_alternate(spark):
    rows = made_rows(4)
    got = cr.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()
    want = expected(rows)
    for conv in want:
        own = [r for r in got if r["conv_id"] == conv]
        assert "".join(r["edit"] for r in own) == want[conv][6] and [r["place"] for r in own] == list(range(len(own)))
        left = [r for r in own if r["edit"] != "D"]
        assert all(r["role"] is None and r["text"] is None for r in own if r["edit"] == "D")
        initials = "".join(r["role"][0] for r in left).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2) and len(initials) % 2 == 0
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in left).encode()).hexdigest() == want[conv][7]


def test_damage(spark):
    rows = [(c, t, r, x) for c in [None, *range(12)] for t in [None, *range(12)] for r, x in [("system", "One. Two! Three?"), (None, None)]]
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if k == 1 else x.translate({46: None, 33: None, 63: None}) if k == 2 else x
        want += [] if k == 0 else [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    text = lambda rows: sorted(map(repr, rows))
    assert text(tuple(r) for r in cr.damage(spark.createDataFrame(rows, SCHEMA)).collect()) == text(want)
    df = spark.createDataFrame(rows, SCHEMA)
    assert reported(cr.conversation_report(df)).keys() == {r[0] for r in rows}


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.conversation_report(none).collect() == [] and cr.repaired_turns(none).collect() == []
    one = spark.createDataFrame([(1, 2, "user", "x")], SCHEMA)
    assert reported(cr.repair_report(one, none)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}

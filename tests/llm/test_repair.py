"""Conversation repair: the parallel Viterbi against plain forward costs, enumeration, and its twin."""

from __future__ import annotations

import random
from itertools import product

import pytest

from tests.compare import compare
from tests.conftest import SF_SMALL
from tests.llm import brute
from txnlens.llm import queries, repair
from txnlens.llm.oracle import OP13

COLS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, id string, symbols int"
ROLES = ["user", "assistant", "system", "tool", "", None, "u", "User"]
TEXTS = ["Fine.", "Is it?", "cut off", "", " \n", None, "Yes! \t", "Fine.", "a" * 50_000 + "."]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "i", 2) for r in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


def conversations(n: int, long: int) -> list[tuple]:
    rng = random.Random(n)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.7 else rng.choice(ROLES)
            rows.append((conv, rng.choice([turn, turn, turn, turn + 5, None]), role, rng.choice(TEXTS)))
    for turn in range(long):  # a third of all rows and more
        rows.append((10_000, turn, rng.choice(["user", "assistant", "tool"]), rng.choice(TEXTS[:4] + [f"Turn {turn}."] * 9)))
    return rows + [(None, 1, "system", "Be kind."), (None, None, "user", "Hi."), (3, 1, "user", "Fine."), (3, 1, "user", "Fine.")]


@pytest.mark.parametrize("part_rows", [50_000, 40])
def test_report_equals_brute_force(spark, monkeypatch, part_rows):
    monkeypatch.setattr(repair, "PART_ROWS", part_rows)
    rows = conversations(120, 600)
    assert rows_of(queries.repair_check(frame(spark, rows))) == sorted(brute.conversation_repair(rows), key=repr)


def test_query_equals_its_twin(spark, duck_small):
    assert compare(spark, "op13_conversation_repair", queries.op13_conversation_repair, OP13, SF_SMALL, duck_small)["status"] == "ok"


def test_empty_and_wholly_dropped(spark):
    assert queries.repair_check(frame(spark, [])).count() == 0
    rows = [(c, t, "user", "x") for c in range(300) for t in [0] if brute.zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert rows and rows_of(queries.repair_check(frame(spark, rows))) == sorted(brute.conversation_repair(rows), key=repr)


def test_repaired_turns_follow_the_pattern(spark, monkeypatch):
    monkeypatch.setattr(repair, "PART_ROWS", 25)
    rows = conversations(40, 200)
    fixed = repair.repair(frame(spark, rows)).orderBy("conv_id", "place").collect()
    by_conv: dict = {}
    for r in fixed:
        by_conv.setdefault(r.conv_id, []).append(r)
    for turns in by_conv.values():
        said = "".join(t.role[0] for t in turns)
        assert said.lstrip("s").replace("ua", "") == "" and said.count("s") <= 1 and said != "s"
        assert all(t.text == "" and t.turn is None for t in turns if t.edit == "I")
    assert len({r.place for r in fixed if r.conv_id == 10_000}) == len(by_conv[10_000])


def enumerated(rows: list[tuple]) -> tuple[int, str]:
    """Every way to keep, rerole, delete and insert, for a few rows."""
    found = []
    n = len(rows)
    for ops in product("DKR", repeat=n):
        for gaps in product(range(3), repeat=n + 1):
            state, cost, audit = "", 0, ""
            for k in range(n + 1):
                for _ in range(gaps[k] if state is not None else 0):
                    state, cost, audit = brute._DUE[state], cost + 3, audit + "I"
                if k == n or state is None:
                    continue
                (initial, fault), op = rows[k], ops[k]
                audit += op
                if op == "D":
                    cost += 4
                    continue
                cost += 3 * (op == "R") + 3 * (fault == "truncated")
                state = brute._after(state, initial) if op == "K" else brute._DUE[state]
                state = None if fault in ("blank", "duplicate") else state
            if state in ("", "a"):
                found.append((cost, audit))
    return min(found)


def test_plain_costs_equal_enumeration_and_the_operator():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randint(1, 3))]
        least = enumerated(rows)
        assert brute.cheapest_audit(rows) == least
        coded = bytes(4 * "suat".index(r) + ["", "truncated", "blank"].index(f) for r, f in rows)
        before, lost = repair.run_back(coded, 0)
        assert repair.vectors()[0][before[0]][0] + lost == least[0]
        assert repair.trace(coded, bytes(before), 0, repair.NOTHING, True)[0] == least[1]


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    rng = random.Random(2)
    for _ in range(200):
        coded = bytes(rng.randrange(16) for _ in range(rng.randint(1, 60)))
        guess, _ = repair.run_back(coded, 1)
        for true in range(len(repair.vectors()[0])):
            assert repair.run_back(coded, true, bytes(guess)) == repair.run_back(coded, true)


def test_passes_rerun_chunks_until_stitched(spark):
    """Deleting keeps vectors as they are, so a long run of blank rows passes its end's vector through all chunks."""
    pieces = [("c", k, bytes([4 * 1 + 2] * 5)) for k in range(6)] + [("d", 0, bytes([4]))]
    solved = repair.solve(spark.createDataFrame(pieces, repair.CHUNK_SCHEMA))
    rows = {(r.key, r.part): r for r in solved.collect()}
    whole, lost = repair.run_back(b"".join(p for k, _, p in pieces if k == "c"), 0)
    assert len(rows) == 7 and sum(r.lost for (k, _), r in rows.items() if k == "c") == lost
    assert b"".join(rows["c", k].vectors for k in range(6)) == bytes(whole)

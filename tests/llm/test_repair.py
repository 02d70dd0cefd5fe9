"""Conversation repair against brute force over all edits, damaged tables, long conversations and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

pytest.importorskip("spreadloom.llm")

from spreadloom.llm import repair  # noqa: E402

ROWS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def every_repair(rows):
    """(cost, audit, roles) of the cheapest edits, by trying them all (not by an agenda)."""

    @cache
    def best(i, roles):
        out = []
        done = "".join(roles)
        if not re.fullmatch(r"(s|s?(ua)*u?)", done):
            return None
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", done):
            out.append((0, "", ()))
        for r in "ua":
            if len(roles) < 2 * len(rows) + 3:
                nxt = best(i, (*roles, r))
                if nxt:
                    out.append((nxt[0] + 2, "I" + nxt[1], (("I", r), *nxt[2])))
        if i < len(rows):
            initial, fault = rows[i]
            nxt = best(i + 1, roles)
            if nxt:
                out.append((nxt[0] + 3, "D" + nxt[1], (("D", ""), *nxt[2])))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                for x, r, cost in [("K", initial, 0)] * (initial in ("s", "u", "a")) + [("R", "u", 2), ("R", "a", 2)]:
                    nxt = best(i + 1, (*roles, r))
                    if nxt:
                        out.append((nxt[0] + cost + extra, x + nxt[1], ((x, r), *nxt[2])))
        return min(out) if out else None

    return best(0, ())


def test_edits_are_the_cheapest_and_least_of_all():
    rng = random.Random(2)
    cases = [[], *([(a, f)] for a in ("s", "u", "a", "x", "") for f in ("", "truncated", "blank"))]
    cases += [[(rng.choice("ssuuaax"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(2, 5))] for _ in range(120)]
    for rows in cases:
        cost, audit, steps = every_repair(tuple(rows))
        got = repair.repair_rows(rows)
        assert "".join(x for x, _ in got) == audit, rows
        assert tuple(got) == steps
        assert cost == sum({"I": 2, "D": 3, "R": 2, "K": 0}[x] for x, _ in got) + sum(f == "truncated" and x != "D" for (_, f), x in zip(rows, audit.replace("I", ""), strict=True))


def test_runs_that_follow_one_another_give_what_the_whole_gives():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.choice("suaauax"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(1, 30))]
        size = rng.randint(1, 7)
        runs = [rows[i : i + size] for i in range(0, len(rows), size)]
        steps = repair.chain_runs([repair.run_items(r) for r in runs])
        assert "".join(a for _, a in steps) == "".join(x for x, _ in repair.repair_rows(rows))


def expected(rows):
    """The contract, row by row, from the undamaged table."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        say = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        mine += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, facts = set(), []
        for _, role, text in mine:
            bare = text.strip(SPACES)
            facts.append((role[:1], "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        steps = repair.repair_rows(facts)
        lines, own = [], iter(mine)
        cost = 0
        for x, r in steps:
            row = None if x == "I" else next(own)
            if x != "D":
                lines.append({"u": "user:", "a": "assistant:"}[r] + (row[2] if row else "") if x in "IR" else f"{row[1]}:{row[2]}")
        own = iter(facts)
        for x, _ in steps:
            fault = next(own)[1] if x != "I" else ""
            cost += {"I": 2, "D": 3, "R": 2, "K": 0}[x] + (fault == "truncated" and x != "D")
        turns = {t for t, _, _ in mine if t is not None}
        faults = [f for _, f in facts]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(facts)), cost,
            "".join(x for x, _ in steps), hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def odd_rows():
    rng = random.Random(9)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 12)):
            text = rng.choice(["Yes.", "No!", "why", "Ça va?\n", " \n", "", None, "x" * 5000 + ".", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), text))
    return rows + rows[:7]


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_odd_rows_and_long_conversations(spark, tmp_path):
    rows = odd_rows()
    want = expected(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], ROWS + ", seq int").repartition(3)
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    from spreadloom.llm.queries import QUERIES

    assert got(QUERIES["op13_conversation_repair"](spark, str(tmp_path))) == want
    for longest in (1, 3, 5):
        report = got(repair.structure_report(repair.repair_conversations(repair.damaged(df), longest)))
        assert report == {k: v for k, v in want.items() if v[6] or v[7] != hashlib.sha256(b"").hexdigest()}
    assert repair.repair_conversations(df.limit(0)).count() == 0


def test_a_conversation_of_many_rows_is_cut_into_runs(spark):
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"a{t}.", f"b{t}", "same."])) for t in range(6000)] + [(8, t, "user", f"{t}.") for t in range(4)]
    want = expected(rows)
    report = got(repair.structure_report(repair.repair_conversations(repair.damaged(spark.createDataFrame(rows, ROWS)), 500)))
    assert report == want


def test_a_table_of_the_driver(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.op13_conversation_repair(spark, sf)) == expected(rows)

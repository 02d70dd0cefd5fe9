"""Conversation structure repair: the lightest derivation of a legal conversation by Knuth's agenda.

A repair item (i, q) says: the rows from i on can be edited so that they end a legal conversation whose earlier roles have
brought the automaton of `(s?(ua)+)?` to state q. Items are deduced from the end backwards: an edit of row i - 1, or an
insertion before row i, is a hyperedge whose tail is the row's own fact and a finished item. Weights are (cost, rows
covered, audit). Each deduction prepends a letter, which keeps the order of equally dear audits of the same rows, and adds
cost or a row, so the functions are monotone and superior, and an item is final when it leaves the agenda (Knuth 1977). An
audit is kept as its first letter and the place of its rest in the order of finished items, which compares as the string.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import cut, discard, large_keys, meet_large, sorted_groups, table, worker_of

# What edits cost, and what a truncated row that is not deleted adds.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Automaton states: nothing yet, after s, after u, after a. The first and the last may end a conversation.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
BEFORE = {r: [(q, p) for (p, x), q in STEPS.items() if x == r] for r in "sua"}
STATES, ENDS = range(4), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LONGEST = 4096

Rows = list[tuple[str, str]]  # (initial, fault) of each row


def lightest(axioms: Iterable, deduce: Callable, goals: Iterable | None = None) -> dict:
    """Knuth's agenda: finished items, each with its cost and its step (what was added, the item it was deduced from).
    `deduce(item)` gives (cost, rows covered by the new item, letters, new item, what); without goals all items finish."""
    number, agenda, done = count(), [], {}
    left = None if goals is None else set(goals)
    for item in axioms:
        heapq.heappush(agenda, (0, 0, "", 0, next(number), item, None))
    while agenda and left != set():
        cost, _, _, _, _, item, step = heapq.heappop(agenda)
        if item in done:
            continue
        rank = len(done)
        done[item] = (cost, step)
        if left is not None:
            left.discard(item)
        for more, covered, letters, new, what in deduce(item):
            if new not in done:
                heapq.heappush(agenda, (cost + more, covered, letters, rank, next(number), new, (what, item)))
    return done


def _edits(rows: Rows, last_inserts: bool) -> Callable:
    n = len(rows)

    def deduce(item: tuple[int, int]) -> Iterator[tuple]:
        i, q = item
        if i < n or last_inserts:
            for r in ROLES:
                for after, p in BEFORE[r]:
                    if after == q:
                        yield INSERT, n - i, "I", (i, p), ("I", r)
        if i == 0:
            return
        initial, fault = rows[i - 1]
        yield DELETE, n - i + 1, "D", (i - 1, q), ("D", "")
        if fault in ("blank", "duplicate"):
            return
        extra = TRUNCATED if fault == "truncated" else 0
        for r in "sua":
            for after, p in BEFORE[r]:
                if after == q:
                    if initial == r:
                        yield extra, n - i + 1, "K", (i - 1, p), ("K", r)
                    if r != "s":
                        yield RENAME + extra, n - i + 1, "R", (i - 1, p), ("R", r)

    return deduce


def _steps(done: dict, item) -> list:
    out = []
    while done[item][1] is not None:
        what, item = done[item][1]
        out.append(what)
    return out


def repair_rows(rows: Rows) -> list[tuple[str, str]]:
    """The cheapest edits in order, ties by the least audit: (letter, role initial for I and R)."""
    start = (0, 0)
    return _steps(lightest([(len(rows), q) for q in ENDS], _edits(rows, True), [start]), start)


def run_items(rows: Rows) -> list[tuple[int, int, int, str]]:
    """Of a run inside a conversation: (state before, state after, cost, audit) of the lightest edits between any two
    states. Insertions stand before a row, so that no audit of the same rows begins another and strings compare alike
    whatever follows."""
    out = []
    for q in STATES:
        done = lightest([(len(rows), q)], _edits(rows, False))
        out += [(p, q, done[0, p][0], "".join(x for x, _ in _steps(done, (0, p)))) for p in STATES if (0, p) in done]
    return out


def chain_runs(runs: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, str]]:
    """The lightest derivation over runs that follow one another, each given as run_items(): (state before, audit) of each
    run, then of the insertions at the end."""
    n = len(runs)
    last = [(p, cost, letters) for p, cost, letters in ((0, 0, ""), (1, 2 * INSERT, "II"), (2, INSERT, "I"), (3, 0, ""))]

    def deduce(item) -> Iterator[tuple]:
        if item == "end":
            for p, cost, letters in last:
                yield cost, 1, letters, (n, p), (p, letters)
        elif item[0] > 0:
            j, q = item
            for p, after, cost, letters in runs[j - 1]:
                if after == q:
                    yield cost, n - j + 2, letters, (j - 1, p), (p, letters)

    return _steps(lightest(["end"], deduce, [(0, 0)]), (0, 0))


def _roles(audit: str, state: int, initials: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Letter by letter, the edit and the role initial that it gives, from an automaton state on."""
    own = iter(initials)
    for x in audit:
        mine = "" if x == "I" else next(own)
        if x == "D":
            yield x, ""
            continue
        r = mine if x == "K" else "a" if state == 2 else "u"
        state = STEPS[state, r]
        yield x, r


EDITS = "conv_id long, seq long, edit string, fault string, turn long, was string, role string, text string"
_NAMES = [c.split()[0] for c in EDITS.split(", ")]


def _edit_rows(conv, base: int, steps: Iterable[tuple[str, str]], rows: list[tuple]) -> Iterator[tuple]:
    """Rows of EDITS from steps and the rows (fault, turn, role, text) that they edit."""
    own = iter(rows)
    for k, (x, r) in enumerate(steps):
        if x == "I":
            yield conv, base + k, x, None, None, None, ROLES[r], ""
            continue
        fault, turn, role, text = next(own)
        yield conv, base + k, x, fault, turn, role, None if x == "D" else ROLES[r] if x == "R" else role, None if x == "D" else text


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in EDITS.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


ORDER = ["conv_key", "turn", "role", "text"]  # ascending, which puts nulls first


def _facts(rows: DataFrame) -> DataFrame:
    """conv_key (never null), initial and fault (blank, truncated or none; duplicates are told by what went before)."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.withColumn("conv_key", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))).withColumn("initial", F.substring("role", 1, 1)).withColumn("fault", fault)


def repair_conversations(conversations: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Cheapest edits that make the roles of each conversation `(s?(ua)+)?` by their initials: a row of EDITS per row of
    `conversations` (conv_id, turn, role, text; other columns are ignored) and per insertion, in order of `seq`. `role` and
    `text` are the repaired ones, null where the row is deleted; `was` is the role before; inserted rows have no turn.

    Rows stand by turn, nulls first, equal turns by role and text. Null roles and texts are read as one space; an empty
    role has no initial and is never kept. A fault is blank (no character but white space), duplicate (role and text
    stood earlier in the conversation) or truncated (the last character that is no white space is not one of .!?), the
    first that holds. A null conv_id is a conversation of its own. Repeated rows are duplicates; an empty table gives no
    rows.

    Conversations of up to `longest` rows are repaired whole in the task that they are dealt to. Longer ones (counted
    first) are sorted by ranges and cut into runs of `longest` rows; a task gives the lightest edits of its run between
    any two states, an agenda over the runs chooses among them, and the runs are edited where they lie: no task holds more
    of a conversation's text than a run. The choice holds 16 audits of a run, so 16 bytes for each of the conversation's rows.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = _facts(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text")))
    large = large_keys(rows, "conv_key", longest, "long-conversations")
    if large.isEmpty():
        return _short(rows)
    known = cut(meet_large(rows, large, "conv_key", "turn", "left").withColumn("id", F.monotonically_increasing_id()), "conversation-rows")
    discard(large)
    return _short(known.filter("_n is null").drop("_n", "id")).unionByName(_long(known.filter("_n is not null").drop("_n"), longest))


def _short(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("conversations")
        for t, starts in sorted_groups(batches, ["conv_key"]):
            conv, turn, role, text, initial, fault = (t.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "initial", "fault"))
            out: list[tuple] = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                seen: set[tuple[str, str]] = set()
                for i in range(s, e):
                    if fault[i] != "blank" and (role[i], text[i]) in seen:
                        fault[i] = "duplicate"
                    seen.add((role[i], text[i]))
                steps = repair_rows(list(zip(initial[s:e], fault[s:e], strict=True)))
                out += _edit_rows(conv[s], 0, steps, list(zip(fault[s:e], turn[s:e], role[s:e], text[s:e], strict=True)))
            yield _table(out)

    return rows.repartition("conv_key").sortWithinPartitions(*ORDER).select("conv_key", "conv_id", "turn", "role", "text", "initial", "fault").mapInArrow(run, EDITS)


def _long(rows: DataFrame, longest: int) -> DataFrame:
    import pandas as pd

    # The first row of each text of a conversation, by id, which no key makes hot.
    first = rows.groupBy("conv_key", "role", "text").agg(F.min(F.struct(F.coalesce("turn", F.lit(-(1 << 63))), "id")).alias("x")).select(F.col("x.id").alias("id"), F.lit(True).alias("_first"))
    rows = rows.join(first, "id", "left").withColumn("fault", F.when((F.col("fault") != "blank") & F.col("_first").isNull(), "duplicate").otherwise(F.col("fault"))).drop("_first")
    order = [*ORDER, F.col("fault") == "duplicate"]
    ranges = rows.repartitionByRange(ORDER[0], ORDER[1], "role", F.xxhash64("text"), "id").sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    narrow = ranges.select("conv_key", "conv_id", "turn", "role", "text", "initial", "fault", "part")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            keys, at = b.column("conv_key").to_pylist(), []
            for k in keys:
                n = n + 1 if k == last else 0
                last = k
                at.append(n)
            runs = [i // longest for i in at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, pa.int64()), pa.array([i % longest for i in at], pa.int64())], names=[*b.schema.names, "run", "at"])

    turns = cut(narrow.mapInArrow(numbered, "conv_key string, conv_id long, turn long, role string, text string, initial string, fault string, part long, run long, at long"), "conversation-runs")
    runs = ["conv_key", "part", "run"]

    def summed(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("at")
        items = run_items(list(zip(x["initial"], x["fault"], strict=True)))
        return pd.DataFrame([(*key, *i) for i in items], columns=[*runs, "before", "after", "cost", "audit"])

    items = turns.select(*runs, "at", "initial", "fault").groupBy(*runs).applyInPandas(summed, "conv_key string, part long, run long, before int, after int, cost long, audit string")

    def chosen(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        at = list(x.groupby(["part", "run"]))
        steps = chain_runs([list(zip(g["before"], g["after"], g["cost"], g["audit"], strict=True)) for _, g in at])
        *own, (_, end) = steps
        return pd.DataFrame([(key[0], *k, p, audit, end if i == len(at) - 1 else "") for i, ((k, _), (p, audit)) in enumerate(zip(at, own, strict=True))], columns=[*runs, "state", "audit", "end"])

    audits = cut(items.groupBy("conv_key").applyInPandas(chosen, "conv_key string, part long, run long, state int, audit string, `end` string"), "conversation-audits")

    def edited(key: tuple, x: pd.DataFrame, how: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("at")
        state, audit, end = how[["state", "audit", "end"]].iloc[0]
        steps = list(_roles(audit, int(state), x["initial"]))
        if end:
            steps += [("I", "u"), ("I", "a")][-len(end) :]
        turn = [None if pd.isna(t) else int(t) for t in x["turn"]]
        conv = None if pd.isna(x["conv_id"].iloc[0]) else int(x["conv_id"].iloc[0])
        base = (int(key[1]) << 42) + int(key[2]) * 4 * longest
        out = list(_edit_rows(conv, base, steps, list(zip(x["fault"], turn, x["role"], x["text"], strict=True))))
        return pd.DataFrame(out, columns=_NAMES, dtype=object)

    return turns.groupBy(*runs).cogroup(audits.groupBy(*runs)).applyInPandas(edited, EDITS)


def structure_report(edits: DataFrame) -> DataFrame:
    """Per conversation of a table of EDITS: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. Rows come sorted and leave one by one; of a conversation only its audit is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("conversations")
        out: list[tuple] = []
        last: str | None = None
        n: dict = {}

        def close() -> None:
            if last is not None:
                gaps = n["high"] - n["low"] + 1 - n["turns"] if n["turns"] else 0
                out.append((n["conv"], gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], n["cost"], "".join(n["audit"]), n["hash"].hexdigest()))

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conv_key", *_NAMES)]
            for key, conv, _, edit, fault, turn, was, role, text in zip(*columns, strict=True):
                if key != last:
                    close()
                    last = key
                    n = {"conv": conv, "low": 0, "high": 0, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "initial": None, "lines": 0}
                n["audit"].append(edit)
                if edit == "I":
                    n["cost"] += INSERT
                else:
                    if turn is not None and (not n["turns"] or turn != n["high"]):
                        n["low"], n["high"], n["turns"] = turn if not n["turns"] else n["low"], turn, n["turns"] + 1
                    if fault:
                        n[fault] += 1
                    n["cost"] += DELETE if edit == "D" else (RENAME if edit == "R" else 0) + (TRUNCATED if fault == "truncated" else 0)
                    initial = was[:1]
                    n["illegal"] += n["initial"] is not None and n["initial"] + initial not in ("su", "ua", "au")
                    n["initial"] = initial
                if edit != "D":
                    n["hash"].update(("\n" * (n["lines"] > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    n["lines"] += 1
            if len(out) >= 10_000:
                yield _report(out)
                out.clear()
        close()
        yield _report(out)

    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv_key")
    return edits.select(key, *_NAMES).repartition("conv_key").sortWithinPartitions("conv_key", "seq").mapInArrow(run, REPORT)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in REPORT.split(", ")])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of `conversations` with the contract's damage, told by the remainder of crc32(`conv_id:turn`) by 20: 0 drops
    a row, 1 empties its text, 2 takes its `.!?` out, 3 repeats it, 4 makes its role user. Nulls are read as one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = structure_report(repair_conversations(damaged(conversations)))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    j = every.alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    zero = [F.coalesce(f"f.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return j.select("e.conv_id", *zero, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))

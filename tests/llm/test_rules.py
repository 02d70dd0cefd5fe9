"""Quality rules: counts against brute force, the exact binomial bound, the guarantee, SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("spreadloom.llm")

from spreadloom.llm import rules  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines), t.count("!"), sum("A" <= c <= "Z" for c in t)


def odd_texts():
    rng = random.Random(6)
    pieces = ["a", "b", "the", "Straße", "日本", " x", "!!", "#", "|", "\n", "\n\n", " ", "\t\r", "\x0b", "B", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return [None, "", " ", "\n \n", "a b c a b c", "x", "a b", "a\na\na", *texts, "one two three\n" * 90_000]


def test_counts_equal_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, N_WORDS int").repartition(3)
    rows = rules.count_texts(df).collect()
    assert {r.doc_id: tuple(r[c] for c in rules.COUNTS) for r in rows} == {i: brute(t) for i, t in enumerate(texts)}


def test_words_of_one_name_are_told_apart_by_their_bytes(monkeypatch):
    class Confused(rules.ByteHashes):
        def of(self, start, end):
            return super().of(start, end) & np.uint64(3)

    monkeypatch.setattr(rules, "ByteHashes", Confused)
    texts = [t.encode() for t in odd_texts()[1:60]]
    got = rules.counts(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    assert [tuple(r) for r in got.tolist()] == [brute(t.decode()) for t in texts]


def test_binomial_tail_is_exact():
    for n, share in ((1, 0.3), (40, 0.01), (200, 0.1)):
        for k in range(n + 1):
            exact = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
            assert abs(rules.no_more_than(k, n, share) - exact) < 1e-9
    assert rules.certified(0, [0, 0], 0.1, 0.1) == 0
    assert rules.certified(459, [0, 0, 5], 0.01, 0.01) == 2
    assert rules.certified(458, [0], 0.01, 0.01) == 0


def test_false_rejection_stays_within_its_limit():
    """Of ladders whose true false rejection rises past the limit, one past it is chosen no more often than the risk."""
    rng = np.random.default_rng(0)
    rates = [0.002, 0.01, 0.03, 0.06]
    bad = 0
    for _ in range(2000):
        x = rng.random(700)
        n = rules.certified(700, [int((x < r).sum()) for r in rates], 0.03, 0.05)
        bad += n > 2
    assert bad / 2000 < 0.07


def test_rules_of_a_stratum_with_labels_and_one_without(spark):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(60))
    rows = [(i, good(), "en", 1) for i in range(1200)] + [(2000, good().replace(" ", "## "), "en", None), (2001, good().replace(" ", "## "), None, None), (2002, good().upper(), "en", None), (None, good(), "en", None), (2003, None, "xx", None)]
    docs = spark.createDataFrame([r[:3] + (True,) for r in rows], "doc_id long, text string, lang string, kept boolean")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(0, 1), (None, 1)], "doc_id long, quality int")
    out = {r.doc_id: (r.base_failed, r.failed, r.kept) for r in rules.apply_rules(docs, labels).collect()}
    assert out[2000] == (False, "symbols", False)
    assert out[2001] == (False, "", True)
    assert out[2002] == (False, "upper", False)
    assert out[2003] == (True, None, False)
    assert out[None] == (False, "", True)
    assert all(out[i] == (False, "", True) for i in range(1200))
    assert rules.apply_rules(docs.limit(0), labels).count() == 0
    assert rules.apply_rules(docs, labels.limit(0)).filter("not base_failed and not kept").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/{sf}/{name}.parquet'")
    cursor = con.execute(rules.OP11_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=str)
    got = sorted([tuple(r[c] for c in names) for r in rules.op11_quality_rules(spark, f"/root/testdata/{sf}").collect()], key=str)
    assert got == want
    if sf == "sf0.1":
        assert sum(r[names.index("failed")] not in (None, "") for r in got) > 100

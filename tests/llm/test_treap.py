"""Ranked search against brute force: treap cells and maxima, ties, copies, odd rows, many small blocks, SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("spreadloom.llm")

from spreadloom.llm import treap  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    full = [b for _, b in bags if b]
    n_docs, n_terms = len(full), sum(sum(b.values()) for b in full)
    df = Counter(t for b in full for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            score, n = 0, sum(b.values())
            for t in set(terms(text)) & b.keys():
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    words = ["".join(rng.choices("abcdeé日", k=rng.randint(1, 4))) for _ in range(300)]
    text = lambda: " ".join(words[min(299, int(rng.expovariate(0.02)))] + rng.choice(["", "", ",", "\n", "X"]) for _ in range(rng.randint(0, 60)))
    docs = [(i, text()) for i in rng.sample(range(-n, 3 * n), n)]
    docs += [(10_000 + i, docs[3][1]) for i in range(120)]  # a group of copies larger than k
    docs += [(None, docs[3][1]), (None, "abc"), (5, None), (6, ""), (7, "..."), docs[0], (8, "zz " * 30_000)]
    items = [(i, text()) for i in range(12)] + [(50, docs[3][1]), (51, None), (52, ""), (53, "nowhere"), (None, "a b c"), (1, "a e"), (54, "zz a")]
    rng.shuffle(docs)
    return docs, items


def test_cells_and_maxima_of_a_treap():
    rng = np.random.default_rng(1)
    for _ in range(30):
        size = rng.integers(1, 40, 2)
        cells = np.unique(rng.integers(0, size, (rng.integers(1, 200), 2)), axis=0)
        value = rng.integers(1, 1000, len(cells))
        t = treap.Treap(*treap.build(cells[:, 0], cells[:, 1], value))
        grid = np.zeros((1 << t.height,) * 2, int)
        grid[cells[:, 0], cells[:, 1]] = value
        for row in range(int(size[0])):
            bits = ((np.array([row])[None, :] >> np.arange(t.height - 1, -1, -1)[:, None]) & 1).astype(np.int64)
            states = [(0, np.zeros((1, 1), np.int64), np.full((1, 1), t.top))]
            for level in range(t.height):
                states = [(2 * c + h, x, y) for c, node, v in states for h, (x, y) in enumerate(t.halves(np.array([level]), node, v, bits))]
                span = 1 << (t.height - level - 1)
                for c, _, v in states:
                    low = row // span * span
                    assert v[0, 0] == grid[low : low + span, c * span : (c + 1) * span].max()


@pytest.mark.parametrize("block_docs,together", [(16384, 4), (37, 1000), (1, 1000)])
def test_ranks_equal_brute_force(spark, block_docs, together):
    docs, items = corpus(random.Random(block_docs), 300 if block_docs > 1 else 40)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in treap.ranked_search(d, q, 50, block_docs, items_at_once=together).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_small_k_and_empty_tables(spark):
    docs, items = corpus(random.Random(5), 200)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, treap.ranked_search(d, q, 3, 50).collect()), key=str) == brute(docs, items, 3)
    assert treap.ranked_search(d.limit(0), q).count() == treap.ranked_search(d, q.limit(0)).count() == 0
    assert treap.ranked_search(d.filter("text is null"), q).count() == 0


def test_a_search_does_not_walk_all_documents():
    """Of many documents that share a common term, few ranges are opened for a rare one beside it."""
    n = 1 << 12
    rows = np.append(np.zeros(n, int), [4000])
    columns = np.append(np.arange(n), [77])
    t = treap.Treap(*treap.build(rows, columns, np.append(np.arange(n) + 1, [5000])))
    seen = []
    halves = t.halves
    t.halves = lambda level, *x: seen.append(len(level)) or halves(level, *x)
    least = [np.arange(1 << t.height)[:: 1 << (t.height - d)] for d in range(t.height + 1)]
    best = treap.Best(5)
    treap.search(t, np.array([0, 4000]), np.array([1, 10]), np.arange(n), np.ones(n, bool), least, best, 4)
    assert best.doc.tolist() == [77, n - 1, n - 2, n - 3, n - 4]
    assert sum(seen) < 200


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    got = [tuple(r) for r in treap.op12_ranked_search(spark, "/root/testdata/sf0.001").collect()]
    by_item = defaultdict(list)
    for r in got:
        by_item[r[0]].append(r[1])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_item.values())
    assert sorted(got) == sorted(con.execute(treap.OP12_SQL).fetchall())

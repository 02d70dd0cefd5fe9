"""Ids that repeat, vectors of any size, pieces over half a window, long texts in a mix."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("spreadloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from spreadloom.llm import lattice, mixture, packing, suffixes, tokens  # noqa: E402

WORD = tokens.public("word_bpe_49k.json")


def kept(rows):
    """sha256 of what is left of each row: strings held by a smaller doc_id go, rows of one id do not cover each other."""
    first = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        out.append((i, len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_thousands_of_texts_under_one_id(spark):
    rng = random.Random(8)
    shared = ["".join(rng.choices("abcdefgh ", k=80)) for _ in range(40)]
    text = lambda: " ".join(rng.choice([*shared, "".join(rng.choices("ijklm", k=rng.randint(1, 30)))]) for _ in range(rng.randint(1, 4)))
    rows = [(7, text()) for _ in range(3000)] + [(rng.choice([-5, 3, 7, 8, 9, 9, 1 << 62]), text()) for _ in range(400)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.removal_report(docs).collect())
    assert got == kept(rows)


def test_rows_of_a_number_of_their_own(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (0, "c"), (None, "d"), (5, None), (9, "e")]
    out, bits = suffixes.numbered(spark.createDataFrame(rows, "doc_id long, text string"), "k")
    got = out.collect()
    assert bits == 2 and len({r.k for r in got if r.k is not None}) == 5
    assert all((a.k >> bits < b.k >> bits) == (a.doc_id < b.doc_id) for a in got for b in got if None not in (a.k, b.k))


def test_vectors_of_any_size_link_as_directions_do(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    near = base + 0.05 * rng.standard_normal((12, 16))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate((v, s) for k, v in enumerate([*base, *near]) for s in [(1.0, 1e-300, 1e300, 1e-170, 1e200, 3.0)[k % 6]])]
    x = np.array([np.array(v) / np.abs(v).max() for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {i: int((x[i] @ x.T >= 0.95).sum()) - 1 for i, _ in rows}
    assert any(want.values())
    assert {r.vec_id: r.n_links for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == want


def test_pieces_over_half_a_window_complete_windows():
    rng = random.Random(2)
    p, done = packing.Packer(2048), []
    ids = {d: np.arange(d * 4096, d * 4096 + rng.randint(1100, 2000), dtype="<u4") for d in range(3000)}
    for d, own in ids.items():
        for k in range(0, len(own), 512):
            done += p.place((d, k, own[k : k + 512], len(own)))
            assert p.n_open <= packing.OPEN
    whole = len(done)
    done += p.close()
    assert whole > 0.9 * len(done)
    assert all(sum(len(x[2]) for x in w) == 2048 for w in done[:whole])
    back = {}
    for w in done:
        for d, start, part, _ in w:
            back.setdefault(d, {})[start] = part
    assert all(np.array_equal(np.concatenate([v for _, v in sorted(back[d].items())]), own) for d, own in ids.items())


def test_windows_are_cut_to_fit_when_many_are_open():
    p = packing.Packer(64, most=3)
    rng, placed, n = random.Random(1), 0, 0
    for d in range(500):
        size = rng.randint(1, 63)
        n += size
        for w in p.place((d, 0, np.zeros(size, "<u4"), size)):
            assert sum(len(x[2]) for x in w) == 64
            placed += 64
        assert p.n_open <= 3
    assert placed + sum(len(x[2]) for w in p.close() for x in w) == n


def test_documents_of_half_a_window_and_more(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["the", "tree", "of", "life", "grows"], k=rng.randint(1100, 2000)))) for i in range(60)]
    out = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), WORD).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    for i, text in docs:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        part = out[out["doc_id"] == i].sort_values("start")
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in part.itertuples()] == part["ids_crc32"].tolist()
        assert part["length"].sum() == len(ids)


def test_taken_words_are_those_of_the_blocks_in_slots(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 400])), rng.choice(["a", "b", "c", None])) for i in range(200)]
    plan = mixture.mix_plan(spark.createDataFrame(docs, "doc_id long, text string, source string"), block_words=16, shard_slots=32)
    slots = [(r.key, r.block) for r in plan["slots"].collect()]
    placed = plan["documents"].collect()
    axis = {}
    for d in placed:
        for w in range(d.start, d.start + d.size):
            assert axis.setdefault((d.key, w), d.doc_id) == d.doc_id
    want = dict.fromkeys((d.doc_id for d in placed), 0)
    for key, block in slots:
        for w in range(block * 16, block * 16 + 16):
            if (key, w) in axis:
                want[axis[key, w]] += 1
    assert {r.doc_id: r.taken for r in mixture.taken(plan).collect()} == want
    words = mixture.mixed_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"), 16).groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r.doc_id: r.n for r in words} == {k: v for k, v in {r.doc_id: r.taken for r in mixture.taken(mixture.mix_plan(spark.createDataFrame(docs, "doc_id long, text string, source string"), 16)).collect()}.items() if v}


def test_a_text_of_many_words_is_mixed_in_time_that_grows_with_it(spark):
    def seconds(n):
        docs = spark.createDataFrame([(0, "ab " * n, "a"), (1, "cd " * n, "b")], "doc_id long, text string, source string")
        began = time.time()
        mixture.mixed_documents(docs).agg(F.sum(F.length("text"))).collect()
        return time.time() - began

    seconds(1000)
    assert seconds(800_000) < 30

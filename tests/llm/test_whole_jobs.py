"""The training-data operators where a whole job is more than the small one: long inputs, repeated ids, many blocks."""

from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("spreadloom.llm")

import corpus_pipeline  # noqa: E402
from spreadloom.llm import chosenpath, common, lattice, licenses, shards  # noqa: E402


def test_licenses_of_a_file_with_all_notices():
    index = licenses.LicenseIndex({w: sum(w in t.split() for _, t, _ in licenses.TEMPLATES) for w in licenses.VOCABULARY})
    notices = [t for _, t, _ in licenses.TEMPLATES]
    alone = set().union(*(index.scan(t.encode())[5].split(",") for t in notices))
    *_, labels, score, matches = index.scan(" filler ".join(notices).encode())
    assert set(labels.split(",")) == alone >= {label for label, _, _ in licenses.TEMPLATES}
    assert score == 1.0 and matches >= len(notices)
    scattered = " ".join(licenses.VOCABULARY) + " filler " * 50 + notices[-1]
    assert "unlicense" in index.scan(scattered.encode())[5].split(",")


def test_whole_licence_texts_in_pieces():
    index, rng = licenses.LicenseIndex({}), random.Random(3)
    common_words = [*licenses.VOCABULARY, *["cc by", "all rights reserved", "general public license", "zzz", "\u00dcn\u00ef"] * 20]
    for _ in range(150):
        words, want = [rng.choice(common_words) for _ in range(rng.randrange(900))], set()
        for _ in range(rng.randrange(4)):
            label, text, phrases = rng.choice(licenses.TEMPLATES)
            template, keys = text.split(), " ".join(phrases).split()
            for _ in range(rng.randrange(3) if len(template) >= 48 else 0):  # words that the template lacks
                at = rng.choice([k for k, w in enumerate(template) if w not in keys])
                template.insert(at, "extra")
            k = rng.randrange(len(words) + 1) if not want else len(words)
            words[k:k] = template
            want.add(label)
        text = rng.choice([" ", ", ", "\n"]).join(words).encode()
        found = index.report(text)
        assert want <= set(found[5].split(",")) and found[8] <= found[0]
        for size in (60, 700):
            assert index.report(text, size) == found
    for label, text, _ in licenses.TEMPLATES:
        assert index.report(("filler " * 40 + text + " filler" * 40).encode())[8] == len(text.split())
    boost = next(t for label, t, _ in licenses.TEMPLATES if label == "bsl-1.0-text")
    assert index.report(boost.encode())[5] == "bsl-1.0-text"
    many = index.report(b"Released under the MIT License. " * 60_000)
    assert many[0] == 300_000 == many[8] and many[7] == 60_000 and many[5] == "mit"


@pytest.mark.parametrize(("blocks", "pairs"), [(1, 300), (2, 300), (3, 60)])
def test_near_vectors_of_many_blocks(spark, blocks, pairs):
    rng = np.random.default_rng(5)
    x, away = rng.standard_normal((2, pairs, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away -= (away * x).sum(1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * away
    z = np.concatenate([x, y]).astype(np.float32)
    v = spark.createDataFrame([(i, r) for i, r in enumerate(z.tolist())], "vec_id long, embedding array<float>")
    z = z.astype(float) / np.linalg.norm(z.astype(float), axis=1)[:, None]
    links = np.argwhere(np.triu(z @ z.T >= 0.95, 1)).tolist()
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(v, blocks=blocks).collect()}
    assert links == [[i, i + pairs] for i in range(pairs)]
    assert sum(got[i] for i, _ in links) >= len(links) - 1 and max(got.values()) == 1


def test_tables_keep_the_promise():
    h, p = lattice.meeting_rates(0.95, 1.5, 4)
    assert [lattice.tables_needed(b, 0.95, 1.5, 4, 1e-3) for b in (1, 2, 3)] == sorted(lattice.tables_needed(b, 0.95, 1.5, 4, 1e-3) for b in (1, 2, 3))
    for b in (1, 2, 3):
        assert (1 - h**b - b * h ** (b - 1) * (p - h)) ** lattice.tables_needed(b, 0.95, 1.5, 4, 1e-3) <= 1e-3


def test_near_duplicates_of_repeated_ids(spark):
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10_000, n))
    old, twin, own = prose(100), prose(100), [prose(80) for _ in range(4)]
    texts = [(1, old), (7, old + " more"), (7, own[0]), (7, own[1]), (8, twin), (8, twin + " more"), (8, twin), (9, own[2]), (9, ""), (None, old), (5, own[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    found = [(r.doc_id, r.n_links, r.class_id, r.kept) for r in chosenpath.jaccard_join(docs).collect()]
    free = [(7, 0, 7, True)] * 2 + [(9, 0, 9, True)] * 2 + [(None, 0, None, True), (5, 0, 5, True)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(found, key=key) == sorted([(1, 1, 1, True), (7, 1, 1, False), (8, 2, 8, True), (8, 2, 8, False), (8, 2, 8, False), *free], key=key)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(left) == 8 and set(left) - {(8, twin), (8, twin + " more")} == {(1, old), (7, own[0]), (7, own[1]), (9, own[2]), (9, ""), (None, old), (5, own[3])}


def test_written_shards_of_a_repeated_id(spark, tmp_path):
    texts = [(1, "x" * (50 + i)) for i in range(60)] + [(1, None), (None, "n")] + [(i, f"t{i} " * 20) for i in range(2, 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    shards.write_shards(docs, f"file://{tmp_path}/s", 1000)
    folders = list((tmp_path / "s").glob("shard=*"))
    got = []
    for f in folders:
        rows = spark.read.schema("doc_id long, text string").parquet(f"file://{f}").collect()
        assert 0 < sum(len(r.text or "") for r in rows) <= 1000
        got += [(r.doc_id, r.text) for r in rows]
    assert sorted(got, key=str) == sorted(texts, key=str)
    assert len([f for f in folders if "-" in f.name]) > 1


@pytest.mark.parametrize("broadcast", [1 << 17, 0])
def test_block_pairs_meet_each_pair_of_a_hot_key(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "MOST_BROADCAST", broadcast)
    rows = [(1, i) for i in range(40)] + [(2, i) for i in range(5)] + [(3, 0)]
    members = spark.createDataFrame(rows, "key long, cid long")
    met: dict = {}
    for r in common.block_pairs(members, "key", "cid", 8).collect():
        met.setdefault((r.key, r.b1, r.b2), []).append((r.cid, r._b))
    pairs = [(k, *sorted((x, y))) for (k, b1, b2), ids in met.items() for n, (x, bx) in enumerate(ids) for y, by in ids[n + 1 :] if b1 == b2 or bx != by]
    assert len(pairs) == len(set(pairs)) == 40 * 39 // 2 + 5 * 4 // 2
    assert max(map(len, met.values())) < 40
    large = common.large_keys(members, "key", 8, "test-large")
    assert [tuple(r) for r in large.collect()] == [(1, 40)]
    left = common.meet_large(members, large, "key", "cid", "left_anti")
    assert left.columns == ["key", "cid"] and sorted(map(tuple, left.collect())) == sorted(rows[40:])
    assert common.large_keys(members.limit(0), "key", 8, "test-large").count() == 0

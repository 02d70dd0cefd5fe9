"""The training-data operators against brute force, on a small table of awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("spreadloom.llm")

from spreadloom.llm import chosenpath, hamming, lattice, licenses, mixture, packing, quality, shards, suffixes, tokenfile  # noqa: E402
from spreadloom.llm.tokens import public  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string"


def corpus() -> list[tuple]:
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdeéñ", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = prose(60)
    texts = [prose(rng.randint(1, 200)) for _ in range(40)] + [None, "", " ", "one", "a  b\n \n c", "漢字 " * 30, prose(6000), "<|endoftext|> x | y"]
    texts += [prose(20) + "\n" + passage + " " + prose(20) for _ in range(5)] + [passage] * 3
    base = prose(150).split()
    for _ in range(6):
        w = list(base)
        w[rng.randrange(150)] = "zzz"
        texts.append(" ".join(w))
    texts += ["Licensed under CC BY-NC 4.0.\nAll rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "all rights all rights reserved"]
    return [(i, t, "en", [None, "a", "b", "c"][min(i % 7, 3)], len(t or ""), "s", "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, t, *_ in corpus():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted(k for p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(at), at[0] if at else None, at[-1] if at else None)
        assert 0 <= got[i].score <= 1
    n = len(corpus())
    assert [got[i].labels for i in range(n - 4, n)] == ["cc-by,cc-by-nc,reserved", "gpl,gpl-3.0", "mit", "reserved"]
    assert licenses.scan_licenses(empty).count() == 0


def test_suffixes(docs, empty):
    first: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    for i, b in data:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    got = {r.doc_id: r for r in suffixes.removal_report(docs).collect()}
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), gone.sum(), hashlib.sha256(kept).hexdigest())
    assert suffixes.removal_report(empty).count() == 0 == suffixes.without_repeats(empty).count()
    assert suffixes.without_repeats(docs).columns == docs.columns


def tokens(name: str, end: int) -> dict[int, np.ndarray]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public(name))
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for i, x, *_ in corpus()}


def test_token_files(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/t"
    tokenfile.write_tokens(docs, path, public("byte_bpe_50k.json"))
    want, at = tokens("byte_bpe_50k.json", 0), 0
    got = {r.doc_id: r for r in tokenfile.read_tokens(spark, path).join(tokenfile.starts(spark, path), ["part", "chunk"]).collect()}
    ids = {r.doc_id: r.ids for r in tokenfile.read_ids(spark, path).collect()}
    for i, x in sorted(want.items()):
        assert (got[i].base + got[i].inside, got[i].n_tokens, got[i].ids_crc32) == (at, len(x), zlib.crc32(x.tobytes())) and ids[i] == x.tolist()
        at += len(x)
    tokenfile.write_tokens(empty, path + "0", public("byte_bpe_50k.json"))
    assert tokenfile.read_tokens(spark, path + "0").count() == 0


def test_simple8b():
    rng = random.Random(1)
    for n in (0, 1, 1023, 1024, 1025, 3000):
        v = np.array([rng.randrange(1 << rng.choice([1, 4, 8, 16, 31, 60, 64])) for _ in range(n)], np.uint64)
        words, blocks, escapes = tokenfile.pack(v)
        assert (tokenfile.unpack(words, escapes) == v).all()
        if n > 2048:
            assert (tokenfile.unpack(words[blocks[1] : blocks[2]], escapes) == v[1024:2048]).all()


def test_packing(docs, empty):
    want = tokens("word_bpe_49k.json", 1)
    got = packing.pack_documents(docs, public("word_bpe_49k.json")).toPandas().sort_values(["doc_id", "start"])
    for i, p in got.groupby("doc_id"):
        at = 0
        for r in p.itertuples():
            assert r.start == at and r.doc_tokens == len(want[i]) and zlib.crc32(want[i][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(want[i])
    assert set(got["doc_id"]) == set(want)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"].to_numpy() == s["length"].cumsum().to_numpy() - s["length"].to_numpy()).all()
        assert int(s["length"].sum()).bit_count() == 1 and s["length"].sum() <= 2048
    assert packing.pack_documents(empty, public("word_bpe_49k.json")).count() == 0


def test_mixing(docs, empty):
    got = mixture.taken(mixture.mix_plan(docs, block_words=16)).toPandas()
    assert len(got) == len(corpus()) and (got["taken"] <= 3 * got["size"]).all()
    sizes: dict = {}
    for _, t, _, s, *_ in corpus():
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, target, open_ = {s: i % 3 + 1 for i, s in enumerate(order)}, float(sum(sizes.values())), {}, set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] if s in over else weight[s] * level for s in open_}
        if not over:
            break
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    for (size, goal), part in got.groupby(["source_size", "target"]):
        assert any(sizes[s] == size and abs(target[s] - goal) < 1e-6 for s in sizes)
        assert abs(part["taken"].sum() - goal) <= max(32, 0.02 * goal)
    again = mixture.taken(mixture.mix_plan(docs.repartition(5), block_words=16)).toPandas()
    assert sorted(got.itertuples(index=False)) == sorted(again.itertuples(index=False))
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixture.mixed_documents(docs, 16).collect())
    assert words == got["taken"].sum()
    assert mixture.taken(mixture.mix_plan(empty)).count() == 0


def test_mix_shards(docs):
    plan = mixture.mix_plan(docs, block_words=16, shard_slots=8)
    slots, counts = plan["slots"].toPandas(), plan["counts"].toPandas()
    assert slots.groupby(["shard", "key"]).size().to_dict() == counts.set_index(["shard", "key"])["slots"].to_dict()
    per_shard = slots.sort_values(["shard", "slot"]).groupby("shard")["slot"].apply(list)
    assert all(s == list(range(len(s))) and len(s) == 8 for s in per_shard[:-1]) and per_shard.iloc[-1] == list(range(len(per_shard.iloc[-1])))
    assert counts.groupby("key")["slots"].sum().sort_index().tolist() == [r.n_slots for r in plan["sources"].filter("n_slots > 0").orderBy("key").collect()]
    assert slots.groupby(["key", "block"]).size().max() <= 3 and (slots["block"] >= 0).all()
    pieces = mixture.mixed_shards(plan).toPandas()
    assert pieces["words"].sum() == mixture.taken(plan).agg({"taken": "sum"}).first()[0] and (pieces["first_word"] >= 0).all()
    assert pieces.groupby(["shard", "slot"])["words"].sum().max() <= 16


def test_jaccard(docs, empty):
    sets = {}
    for i, t, *_ in corpus():
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = {i: {j for j in sets if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    got = {r.doc_id: r for r in chosenpath.jaccard_join(docs, most=4).collect()}
    assert {i: got[i].n_links for i in sets} == {i: len(x) for i, x in links.items()}
    assert all(got[i].class_id == got[j].class_id for i in links for j in links[i])
    assert chosenpath.jaccard_join(empty).count() == 0


def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 16))
    x[60:90] = x[:30] + 0.05 * rng.standard_normal((30, 16))
    x[90:95] = x[5]
    rows = [(i, [float(v) for v in np.float32(r)], 1) for i, r in enumerate(x)] + [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, [1.0, 2.0], 1)]
    return np.float32(x).astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_near_vectors(spark):
    x, v = vectors(spark)
    y = x / np.linalg.norm(x, axis=1)[:, None]
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in lattice.near_vectors(v, most=8).collect()}
    assert [got[i].n_links for i in range(120)] == link.sum(1).tolist()
    assert all(got[i].component_id == got[j].component_id for i, j in zip(*np.nonzero(link), strict=True))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(200, 205))
    assert lattice.near_vectors(v.filter("false")).count() == 0


def test_hamming(spark):
    _, v = vectors(spark)
    codes = hamming.binary_codes(v).cache()
    all_codes = {r.vec_id: r.code for r in codes.collect()}
    got: dict[int, list] = {}
    for r in hamming.top_k_hamming(codes, codes.filter("vec_id % 100 = 0"), 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.vec_id))
    for q in (0, 100):
        want = sorted(((all_codes[q] ^ c) & (1 << 64) - 1).bit_count() * 1000 + i for i, c in all_codes.items() if i != q)[:7]
        assert [d * 1000 + i for _, d, i in sorted(got[q])] == want
    assert hamming.top_k_hamming(codes.filter("false"), codes.filter("false")).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(scored) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert quality.score_quality(empty, quality.fit_quality(empty, labels)).count() == 0
    data = "/root/testdata/sf0.01"
    got = quality.op5_quality(spark, data).filter("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    assert got.filter("predicted = quality").count() >= 0.95 * got.count()


def test_shards(docs, empty):
    got = shards.extendible_shards(docs, 2000).toPandas()
    assert len(got) == len(corpus())
    for _, s in got.groupby(["depth", "prefix", "page"]):
        assert s["n_bytes"].sum() == s["shard_bytes"].iloc[0] and (s["n_bytes"].sum() <= 2000 or len(s) == 1)
    same = docs.selectExpr("1L doc_id", "coalesce(text, '') text").filter("octet_length(text) < 1500")
    paged = shards.extendible_shards(same, 3000)
    assert paged.groupBy("page").sum("n_bytes").filter("`sum(n_bytes)` > 3000").count() == 0 and paged.count() == same.count()
    assert shards.extendible_shards(empty, 10).count() == 0

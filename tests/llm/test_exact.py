"""Exactness where shortcuts would show: texts built to clash, repeated and null ids, clashing column names, long texts,
pairs at the threshold, and the pipeline's stages."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("spreadloom.llm")

import corpus_pipeline  # noqa: E402
from spreadloom.llm import chosenpath, hamming, lattice, licenses, mixture, packing, quality, shards, suffixes, tokenfile, tokens  # noqa: E402

WORD = tokens.public("word_bpe_49k.json")
BYTE = tokens.public("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n: int) -> tuple[str, str]:
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def clashing() -> list[str]:
    return [f"one {w} two" for n in (1024, 2048) for w in thue_morse(n)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


def test_tokens_of_texts_that_polynomials_confuse(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = clashing()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokenfile.write_tokens(docs, f"file://{tmp_path}/t", BYTE)
    got = {r.doc_id: r.ids for r in tokenfile.read_ids(spark, f"file://{tmp_path}/t").collect()}
    packed = packing.pack_documents(docs, WORD).toPandas().sort_values(["doc_id", "start"])
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for i, t in enumerate(texts):
        assert got[i] == [*byte.encode(t, add_special_tokens=False).ids, 0]
        want, part = np.array([*word.encode(t, add_special_tokens=False).ids, 1], "<u4"), packed[packed["doc_id"] == i]
        assert [zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in part.itertuples()] == part["ids_crc32"].tolist()
    assert [r.n_links for r in chosenpath.jaccard_join(docs).collect()] == [0] * len(texts)


def test_chunks_of_one_name_are_told_apart_by_their_bytes():
    class Confused(tokens.TextEncoder):
        def named(self, data, start, end):
            return super().named(data, start, end) & np.uint64(7)

    rng = random.Random(3)
    texts = [prose(rng, 200).encode() for _ in range(20)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    for path in (BYTE, WORD):
        e = Confused(path)
        for _ in range(2):
            ids, counts = e.encode(data, at)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.plain(t.decode()).tolist() for t in texts]


def brute_spans(rows: list[tuple[int, bytes]]) -> dict[int, np.ndarray]:
    first: dict[bytes, int] = {}
    for i, b in sorted(rows):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        out[i] = gone
    return out


def awkward_texts() -> list[tuple[int, str]]:
    rng = random.Random(5)
    long, shared = prose(rng, 110_000), prose(rng, 30)
    cuts = [long[k : k + rng.randint(45, 400)] for k in range(1000, len(long), 60_000)]
    texts = [long, " ".join(cuts), shared, shared[:70] + "x" + shared[71:], "q" * 300, "q" * 120 + "r", shared[3:60] + "é" * 40, "é" * 40, "b" + "é" * 30]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def test_spans_of_long_and_awkward_texts(spark):
    rows = awkward_texts()
    assert len(rows[0][1]) > 2 * suffixes.PIECE
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_spans([(i, t.encode()) for i, t in rows])
    for r in suffixes.removal_report(docs).collect():
        gone, data = want[r.doc_id], np.frombuffer(dict(rows)[r.doc_id].encode(), np.uint8)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), gone.sum(), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest())


def test_all_positions_and_single_ones_have_the_same_rank():
    data = np.random.default_rng(0).integers(97, 100, 500).astype(np.uint8)
    at = np.arange(450)
    assert (suffixes.all_ranks(data)[at] == suffixes.ranks(data, at, 20)).all()
    text = data.tobytes()
    for length in suffixes.LENGTHS:
        assert len(np.unique(suffixes.ranks(data, at, length))) == len({text[k : k + length] for k in at})


def test_pairs_just_above_the_threshold(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        words = prose(rng, 130).split()
        texts.append(words)
        other = list(words)
        for at in rng.sample(range(10, 120, 11), rng.choice([2, 2, 3])):
            other[at] = "zz"
        texts.append(other)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    alike = [len(sets[2 * p] & sets[2 * p + 1]) / len(sets[2 * p] | sets[2 * p + 1]) for p in range(60)]
    assert sum(0.8 <= a < 0.88 for a in alike) >= 30 and sum(a < 0.8 for a in alike) >= 5
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for most in (8, 512):
        got = {r.doc_id: r.n_links for r in chosenpath.jaccard_join(docs, most=most).collect()}
        assert [got[2 * p] for p in range(60)] == [got[2 * p + 1] for p in range(60)] == [int(a >= 0.8) for a in alike]


def odd_rows(spark):
    """Rows that repeat an id, null ids, null and empty texts, and columns named like those that operators use inside."""
    rng = random.Random(8)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a, "s"), (1, a, "s"), (1, b, None), (None, a, "t"), (None, None, None), (2, "", "s"), (3, None, "t"), (4, a + " tail", "t"), (5, b, "s")]
    names = ["_id", "_check", "_spans", "_h", "_row", "row", "uses", "start", "key", "words", "shard", "Score", "predicted", "_n", "_b"]
    schema = f"{DOCS}, " + ", ".join(f"`{n}` string" for n in names)
    return rows, spark.createDataFrame([(i, t, "en", s, len(t or ""), *[f"{n}!" for n in names]) for i, t, s in rows], schema).repartition(2), names


def test_repeated_ids_and_clashing_columns(spark, tmp_path):
    rows, docs, names = odd_rows(spark)
    n = len(rows)
    assert licenses.scan_licenses(docs).count() == n == suffixes.removal_report(docs).count()
    assert sorted(r.n_words for r in licenses.scan_licenses(docs).collect()) == sorted(len((t or "").split()) for _, t, _ in rows)
    left = suffixes.without_repeats(docs)
    assert left.columns == docs.columns and left.filter("_spans <> '_spans!' or _id <> '_id!'").count() == 0
    # A row of id 4 keeps its tail; that of id 5 goes; rows of one id do not cover each other.
    assert sorted((r.doc_id, len(r.text)) for r in left.filter("doc_id is not null and text <> ''").collect()) == sorted([(1, len(rows[0][1])), (1, len(rows[0][1])), (1, len(rows[2][1])), (4, 5)])
    mixed = mixture.mixed_documents(docs, 16)
    assert mixed.columns == docs.columns and mixed.filter("uses <> 'uses!' or row <> 'row!' or key <> 'key!'").count() == 0
    assert sum(len(r.text.split()) for r in mixed.collect()) == mixture.taken(mixture.mix_plan(docs, 16)).agg({"taken": "sum"}).first()[0]
    assert mixture.taken(mixture.mix_plan(docs, 16)).count() == n == chosenpath.jaccard_join(docs).count()
    scored = quality.score_quality(docs, quality.Trees(np.zeros((1, 1), int), np.zeros((1, 1)), np.zeros((1, 2)), 0.0, 1))
    assert scored.count() == n and [c.lower() for c in scored.columns].count("score") == 1
    shards.write_shards(docs, f"file://{tmp_path}/s", 700)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == n
    tokenfile.write_tokens(docs, f"file://{tmp_path}/t", BYTE)
    assert tokenfile.read_tokens(spark, f"file://{tmp_path}/t").count() == n
    pieces = packing.pack_documents(docs, WORD).toPandas()
    assert pieces.loc[pieces["start"] == 0].shape[0] == n


def test_vectors_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4, 32))
    rows = [(1, x[0].tolist()), (1, x[1].tolist()), (2, (x[1] * 2 + 1e-9).tolist()), (2, x[1].tolist()), (None, x[0].tolist()), (3, None), (100, x[0].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(-1 if c is None else c for c in r) for r in lattice.near_vectors(v).collect())
    assert got == sorted([(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (-1, 0, -1, True), (3, 0, 3, True), (100, 1, 1, False)])
    codes = hamming.binary_codes(v)
    near = hamming.top_k_hamming(codes, codes.filter("vec_id = 100"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.distance) for r in near][0] == (1, 0) and len(near) == 2


def test_cosine_is_taken_in_doubles(spark):
    x = np.zeros(16)
    x[0] = 1.0
    rows = [(1, x.tolist())]
    for i, c in ((2, 0.95 + 2e-9), (3, 0.95 - 2e-9)):
        y = np.zeros(16)
        y[0], y[i] = c, np.sqrt(1 - c * c)
        rows.append((i, y.tolist()))
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), miss=1e-9).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_trees_against_a_plain_walk():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.boost(x, y, rounds=15, depth=3)
    for row, score in zip(x[:60], trees.score(x[:60]), strict=True):
        total = trees.bias
        for t in range(len(trees.feature)):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + (2 if row[trees.feature[t, node]] > trees.threshold[t, node] else 1)
            total += trees.leaf[t, node - (2**trees.depth - 1)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_first_split_against_all_splits():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 20, (300, 3)).astype(float)
    y = (x[:, 1] > 7).astype(float)
    trees = quality.boost(x, y, rounds=1, depth=1)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(f: int, cut: float) -> float:
        low = x[:, f] <= cut
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1.0) for m in (low, ~low))

    best = max(((f, c) for f in range(3) for c in range(19)), key=lambda s: gain(*s))
    assert (int(trees.feature[0, 0]), int(trees.threshold[0, 0])) == best == (1, 7)


def test_statistics_of_a_plain_text():
    text = b"One two two.\nOne two two.\n\nX9!"
    got = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
    assert (got["repeated_next"], got["longest_word"], round(got["repeated_lines"], 6)) == (0.0, 4, round(1 / 3, 6))
    assert (round(got["digits"] * len(text)), round(got["upper"] * len(text)), round(got["exclaims"] * len(text))) == (1, 3, 1)
    assert quality.statistics(b"") == [0.0] * len(quality.STATISTICS)


def test_licence_labels_against_every_placement(spark):
    rng = random.Random(2)
    files = []
    for label, text, _ in licenses.TEMPLATES:
        words = text.split()
        files.append((label, prose(rng, 30) + " " + text.title().replace(" ", ", ") + ". " + prose(rng, 30)))
        if len(words) > 12:  # one word of a long notice is missing, but none of its key phrases
            keys = " ".join(k for _, t, ks in licenses.TEMPLATES if t == text for k in ks).split()
            loose = [k for k, w in enumerate(words) if w not in keys]
            files.append((label, " ".join(w for k, w in enumerate(words) if k != loose[-1])))
    files.append(("", prose(rng, 300)))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, (label, text) in enumerate(files):
        found = set(got[i].labels.split(",")) - {""}
        low = licenses.words_of(text.encode())
        whole = {name for name, t, _ in licenses.TEMPLATES for k in range(len(low)) if low[k : k + len(t.split())] == t.encode().split()}
        assert whole <= found and ({label} - {""}) <= found
        if not label:
            assert not found and got[i].score == 0


def test_pipeline_stages(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, data)
    model = quality.fit_quality(docs, spark.read.parquet(f"{data}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if model.score(np.array([quality.statistics((r.text or "").encode())]))[0] >= 0.3}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == corpus_pipeline.COLUMNS
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    gone = brute_spans(list(texts.items()))
    left = {r.doc_id: r for r in corpus_pipeline.repeats(spark, docs.select(*corpus_pipeline.COLUMNS), data).collect()}
    for i, b in texts.items():
        if b.isascii():
            rest = np.frombuffer(b, np.uint8)[~gone[i]].tobytes().decode()
            assert (left[i].text, left[i].n_chars) == (rest, len(rest)) if rest else i not in left
    pieces = corpus_pipeline.run(spark, data).toPandas()
    assert pieces.columns.tolist() == [c.split()[0] for c in packing.PIECE.split(", ")]
    assert set(pieces["doc_id"]) <= want and (pieces.groupby("sequence_id")["length"].sum() <= 2048).all()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, data)
        assert empty.count() == 0

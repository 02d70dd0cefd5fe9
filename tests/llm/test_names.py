"""Names of chunks and places of pieces: what op10_pack and op3_token_files spend their time on."""

from __future__ import annotations

import time

import numpy as np

from spreadloom.llm.common import ByteHashes
from spreadloom.llm.packing import Packer
from spreadloom.llm.tokens import TextEncoder, public


def pieces(n=200_000, seed=3):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 12, n)
    size[:3] = 1, 9000, 70_000
    start = np.cumsum(size) - size
    return rng.integers(0, 256, int(size.sum())).astype(np.uint8), start, start + size


def test_names_tell_pieces_apart_and_do_not_depend_on_place():
    enc = TextEncoder(public("word_bpe_49k.json"))
    data, start, end = pieces()
    raw = [data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    seen: dict[bytes, int] = {}
    for x, name in zip(raw, enc.named(data, start, end).tolist(), strict=True):
        assert seen.setdefault(x, name) == name
    assert len(set(seen.values())) == len(seen)
    turned = np.frombuffer(b"".join(raw[::-1]), np.uint8)
    size = (end - start)[::-1]
    at = np.cumsum(size) - size
    assert enc.named(turned, at, at + size).tolist() == [seen[x] for x in raw[::-1]]
    zeros = np.zeros(6, np.uint8)  # 0, 00 and 000 have names of their own
    assert len(set(enc.named(zeros, np.array([0, 1, 3]), np.array([1, 3, 6])).tolist())) == 3


def test_names_cost_less_than_sums_over_all_bytes():
    enc = TextEncoder(public("word_bpe_49k.json"))
    data, start, end = pieces()

    def least(f):
        out = []
        for _ in range(5):
            at = time.process_time()
            f()
            out.append(time.process_time() - at)
        return min(out)

    assert least(lambda: enc.named(data, start, end)) * 1.5 < least(lambda: ByteHashes(data).of(start, end))


def test_a_piece_goes_where_the_sum_of_squares_grows_least():
    rng = np.random.default_rng(8)
    p = Packer(64, most=40)
    for doc, size in enumerate(rng.integers(1, 65, 3000).tolist()):
        n = p.level
        grown = {}
        for h in range(64 - size + 1):
            if h == 0 or n[h]:
                after = n.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 64
                grown[h] = int((after[1:] ** 2).sum() - (n[1:] ** 2).sum())
        best = min(grown.values())
        want = max(h for h, x in grown.items() if x == best) if size < 64 else 0
        assert p._least(size) == want
        p.place((doc, 0, np.zeros(size, "<u4"), size))

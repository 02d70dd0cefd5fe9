"""Exact, cached use of the tokenizers library over many texts.

Byte-pair merges never cross the pieces a pre-tokenizer cuts, and both public vocabularies cut before a space that
stands before no other white space. So the ids of a text are the ids of its chunks (a space and what follows it, up to
the next space), one after another. Texts come as Arrow's byte buffers; numpy finds the chunks and names them by 64-bit
hashes, and the library encodes each chunk that a worker has not met. A name only finds a chunk: its bytes are then
compared with the chunk's that was encoded. A text with two chunks of one name, with white space beside a space, or with
a special token's string, goes to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from spreadloom.llm.common import kept_by_worker, mix, worker_of

MARK = "|"


class TextEncoder:
    """Ids of `encode(text, add_special_tokens=False)`. `keep` and `keep_bytes` bound the chunks remembered (about 40 bytes
    each) and their text; beyond them they are forgotten and learnt anew."""

    def __init__(self, path: str, keep: int = 1_000_000, keep_bytes: int = 1 << 25):
        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.keep_bytes = keep, keep_bytes
        vocab = self.tokenizer.get_vocab()
        self.spaced = self.tokenizer.normalizer is None  # byte-level: a chunk's first token holds the space before it
        if self.spaced:
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[[i for t, i in vocab.items() if t[0] == "Ġ"]] = True
        else:
            self.mark = vocab[MARK + "</w>"]
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.names = np.zeros(0, np.uint64)  # sorted
        self.at, self.len = np.zeros(0, np.int32), np.zeros(0, np.int32)  # in pool; length -1: only right in its text
        self.raw_at, self.raw_len = np.zeros(0, np.int32), np.zeros(0, np.int32)  # in raw
        self.pool, self.used = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ids(self, chunks: list[str], run: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, and how many each has (-1: only right in its text)."""
        length, begin = np.zeros(len(chunks), np.int32), np.zeros(len(chunks), np.int64)
        found, used = [np.zeros(0, np.uint32)], 0
        joined, lone = [], []
        for i, c in enumerate(chunks):
            if "<|" in c or self.spaced and c[0] == " " and (len(c) == 1 or c[1].isspace()):
                length[i] = -1
            elif not self.spaced and c[1:].isalpha() and c[0] == " " and max(c) < "\u0100":
                lone.append(i)  # letters alone are one word, and a word has one closing token
            elif self.spaced and c[0] != " " or not self.spaced and MARK in c:
                found.append(self.plain(c))
                length[i], begin[i], used = len(found[-1]), used, used + len(found[-1])
            else:
                joined.append(i)
        runs = [(which, which[i : i + run]) for which in (joined, lone) for i in range(0, len(which), run)]
        texts = ["".join([chunks[i] for i in r]) if self.spaced or which is lone else "".join([f" {MARK} {chunks[i]}" for i in r]) for which, r in runs]
        for (which, r), e in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, np.uint32)
            if which is lone:
                starts = np.append(0, np.flatnonzero(self.closes[ids]) + 1)
                starts, end = starts[:-1], starts[-1]
            else:
                starts, end = np.flatnonzero(self.opens[ids] if self.spaced else ids == self.mark), len(ids)
            if len(starts) != len(r) or end != len(ids):
                raise AssertionError("each chunk's first token must be told from the others")
            ends = np.append(starts[1:], len(ids))
            starts = starts + (not self.spaced and which is joined)
            length[r], begin[r], used = ends - starts, used + starts, used + len(ids)
            found.append(ids)
        return _gathered(np.concatenate(found), begin, np.maximum(length, 0).astype(np.int64)), length

    def _learn(self, names: np.ndarray, raw: list[bytes]) -> None:
        ids, length = self._ids([c.decode("utf-8", "replace") for c in raw])
        where = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, where, names)
        raw_len = np.fromiter(map(len, raw), np.int32, len(raw))
        self.pool, at = _appended(self.pool, self.used, ids, np.maximum(length, 0))
        self.raw, raw_at = _appended(self.raw, self.raw_used, np.frombuffer(b"".join(raw), np.uint8), raw_len)
        self.used, self.raw_used = self.used + len(ids), self.raw_used + int(raw_len.sum())
        for name, new in (("at", at), ("len", length), ("raw_at", raw_at), ("raw_len", raw_len)):
            setattr(self, name, np.insert(getattr(self, name), where, new))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the texts data[offsets[i]:offsets[i + 1]]: all ids, and the number of each text's ids."""
        n = len(offsets) - 1
        if len(self.names) > self.keep or self.raw_used > self.keep_bytes:
            self.forget()
        base, end = int(offsets[0]), int(offsets[-1])
        data, offsets = data[base:end], np.asarray(offsets, np.int64) - base
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        cuts = data == 32
        cuts[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cuts)
        size = np.diff(np.append(starts, len(data)))
        names, first, which = np.unique(self.named(data, starts, starts + size), return_index=True, return_inverse=True)
        wrong = ~_same_bytes(data, starts, size, data, starts[first][which], size[first][which])
        at = np.searchsorted(self.names, names)
        new = np.ones(len(names), bool)
        inside = at < len(self.names)
        new[inside] = self.names[at[inside]] != names[inside]
        if new.any():
            raw, f = data.tobytes(), first[new]
            self._learn(names[new], [raw[s : s + z] for s, z in zip(starts[f].tolist(), size[f].tolist(), strict=True)])
            at = np.searchsorted(self.names, names)
        wrong |= ~_same_bytes(data, starts[first], size[first], self.raw, self.raw_at[at], self.raw_len[at])[which]
        length, place = self.len[at][which].astype(np.int64), self.at[at][which].astype(np.int64)
        length[wrong] = -1
        doc = np.searchsorted(offsets, starts, "right") - 1
        whole = np.unique(doc[length < 0])
        length = np.maximum(length, 0)
        ids = _gathered(self.pool, place, length).astype(np.uint32)
        counts = np.bincount(doc, weights=length, minlength=n).astype(np.int64)
        if len(whole):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in whole.tolist():
                parts[i] = self.plain(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts

    def named(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit names of the pieces [start, end), which cover `data` one after another: sums of a byte times an odd factor of
        its place in the piece."""
        factor, size = _factors(int((end - start).max())), end - start
        place = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        place -= np.repeat(start.astype(place.dtype), size)
        terms = factor[place]
        terms *= data.astype(np.uint64) + np.uint64(1)
        return mix(np.add.reduceat(terms, start))


_FACTORS: dict[str, np.ndarray] = kept_by_worker("factors", {})


def _factors(n: int) -> np.ndarray:
    """An odd number for each of n places and more, kept up to 2**20 of them."""
    have = _FACTORS.get("odd", np.zeros(0, np.uint64))
    if len(have) < n:
        have = mix(np.arange(1, max(1 << 12, 1 << (n - 1).bit_length()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        if n <= 1 << 20:
            _FACTORS["odd"] = have
    return have


def _gathered(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[at:at + size] of each place, one after another."""
    stop = np.cumsum(size)
    return pool[np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


def _appended(pool: np.ndarray, used: int, more: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool with `more` behind its first `used` entries, and where each part of it starts."""
    if used + len(more) > len(pool):
        pool = np.concatenate([pool[:used], np.zeros(used + 2 * len(more), pool.dtype)])
    pool[used : used + len(more)] = more
    return pool, (used + np.cumsum(size, dtype=np.int64) - size).astype(np.int32)


def _same_bytes(a: np.ndarray, a_at: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Whether a[a_at:a_at + a_len] equals b[b_at:b_at + b_len], for each place."""
    out = a_len == b_len
    size = np.where(out, a_len, 0).astype(np.int64)
    stop = np.cumsum(size)
    if len(stop) and stop[-1]:
        step = np.arange(stop[-1], dtype=np.int32 if stop[-1] < 1 << 31 else np.int64)
        start = stop - size
        differ = a[step + np.repeat((a_at - start).astype(step.dtype), size)] != b[step + np.repeat((b_at - start).astype(step.dtype), size)]
        if differ.any():
            out[np.unique(np.searchsorted(stop, np.flatnonzero(differ), "right"))] = False
    return out


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary or string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about `most` bytes (a longer text alone), so that working memory does not depend on the batch."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, int(offsets[i]) + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_ENCODERS: dict[str, TextEncoder] = kept_by_worker("encoders", {})


def encoder(path: str) -> TextEncoder:
    """One per Python worker: what it has learnt serves all of the worker's tasks."""
    worker_of(f"tokens of {path}")
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def public(name: str) -> str:
    """Where an installed public vocabulary lies; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)

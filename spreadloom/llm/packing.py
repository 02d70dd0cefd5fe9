"""Sum-of-squares packing: documents' tokens into windows of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import table
from spreadloom.llm.tokens import encoder, public, slices, texts

WINDOW, OPEN = 2048, 512
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Online sum-of-squares packing (Csirik et al. 2006) of pieces shorter than a window.

    level[h] counts the open windows filled to h; a piece goes where the sum of squared counts grows least (the fullest
    of equals). While `most` windows are open, a piece is cut to fill the fullest of them instead, so that no more ever
    are. `close()` ends the stream: what lies in open windows is laid end to end and cut into full windows, and the last
    part into runs of power-of-two lengths, which need no padding.
    """

    def __init__(self, window: int = WINDOW, most: int = OPEN):
        self.window, self.most, self.level, self.n_open = window, most, np.zeros(window + 1, np.int64), 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]  # level -> windows -> pieces

    def place(self, piece: tuple) -> list[list[tuple]]:
        """Put a piece (doc_id, start, ids, doc_tokens); the pieces of each window that it completes."""
        doc, start, ids, total = piece
        done: list[list[tuple]] = []
        while len(ids) and self.n_open >= self.most:
            h = int(np.flatnonzero(self.level)[-1])
            part = ids[: self.window - h]
            self._put(h, (doc, start, part, total), done)
            start, ids = start + len(part), ids[len(part) :]
        if len(ids):
            self._put(self._least(len(ids)), (doc, start, ids, total), done)
        return done

    def _least(self, size: int) -> int:
        """The level at which a piece makes the sum of squares grow least; 0 opens a window."""
        n, rest = self.level, self.window - size
        held = np.flatnonzero(n[1 : rest + 1]) + 1  # levels of open windows with room; 512 at most
        if not len(held):
            return 0
        cost = 2 * (n[held + size] - n[held]) + 2
        if held[-1] == rest:
            cost[-1] = 1 - 2 * n[rest]
        best = len(held) - 1 - int(np.argmin(cost[::-1]))
        return int(held[best]) if cost[best] <= 2 * n[size] + 1 else 0

    def _put(self, h: int, piece: tuple, done: list[list[tuple]]) -> None:
        held = self.open[h].pop() if h else []
        if h:
            self.level[h] -= 1
            self.n_open -= 1
        held.append(piece)
        h += len(piece[2])
        if h == self.window:
            done.append(held)
        else:
            self.level[h] += 1
            self.n_open += 1
            self.open[h].append(held)

    def close(self) -> Iterator[list[tuple]]:
        pieces = [p for h in range(self.window, 0, -1) for held in self.open[h] for p in held]
        left = sum(len(p[2]) for p in pieces)
        room = min(self.window, 1 << max(left, 1).bit_length() - 1)
        held: list[tuple] = []
        for doc, start, ids, total in pieces:
            while len(ids):
                held.append((doc, start, ids[:room], total))
                used = len(held[-1][2])
                room, left, start, ids = room - used, left - used, start + used, ids[used:]
                if not room:
                    yield held
                    held, room = [], min(self.window, 1 << max(left, 1).bit_length() - 1)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each input partition is one stream packed where it lies, without a shuffle: full windows are cut off a document
    first; what remains is cut into pieces of a quarter of a window at most, since pieces over half of one never meet, and
    packed. A lost task packs the same split again, with the same result. Sequence ids hold the partition in their upper
    bits. State is the level array and OPEN windows at most, whatever the partition's size. Null text is empty (the end id
    alone); null doc_id is kept; rows that repeat are documents of their own; other columns are ignored; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, piece = encoder(vocabulary), Packer(window), max(1, window // 4)
        state = {"sequence": None}
        rows: list[tuple] = []

        def emit(pieces: list[tuple]) -> None:
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, state["sequence"], at))
                at += len(ids)
            state["sequence"] += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in PIECE.split(", ")])

        for b in batches:
            data, at = texts(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            if state["sequence"] is None and len(ids):
                state["sequence"] = b.column("part")[0].as_py() << 40
            for i, j in slices(at):
                tokens, counts = enc.encode(data, at[i : j + 1])
                ends = np.cumsum(counts)
                tokens = np.insert(tokens, ends, end_id).astype("<u4")
                e = 0
                for doc, n in zip(ids[i:j], (counts + 1).tolist(), strict=True):
                    s, e = e, e + n
                    full = n - n % window
                    for k in range(0, full, window):
                        emit([(doc, k, tokens[s + k : s + k + window], n)])
                    for k in range(full, n, piece):
                        for done in packer.place((doc, k, tokens[s + k : min(e, s + k + piece)].copy(), n)):
                            emit(done)
                yield out()
        for done in packer.close():
            emit(done)
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, PIECE)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"))

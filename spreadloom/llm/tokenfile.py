"""Token-id files: Simple-8b words in shards that decode by vector operations.

A file is Parquet; each row is one run of whole documents in ascending doc_id order:
part, chunk    place of the run: files in order of part, runs in order of chunk
n_ids          ids in the run
doc_ids, lengths   of its documents: int64 and uint32, little-endian (ids include the end id)
has_id         a bit per document, packed: 0 where doc_id is null
words          the Simple-8b words, uint64: selector in the top 4 bits, 60 payload bits
blocks         uint32: index of the first word of each block of BLOCK ids, so that any block decodes alone
escapes        uint64: values over 60 bits; their word has selector 0 and the index of its escape as payload
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.llm.common import partitions, scratch, table
from spreadloom.llm.tokens import encoder, public, slices, texts

# Bits of each id under selectors 1 to 14; a word holds 60 // bits ids.
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = 60 // BITS
BLOCK = 1024


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, block offsets and escapes of unsigned values. Greedy within each block, all blocks advancing together."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    need = np.append(np.searchsorted(np.uint64(1) << BITS.astype(np.uint64), v, "right"), len(BITS)).astype(np.int8)
    at = np.arange(0, n, block)
    stop = np.minimum(at + block, n)
    all_at, all_sel = [], []
    while len(at):
        sel = np.full(len(at), -1, np.int8)  # index into BITS; -1: escape
        live, high, have = np.arange(len(at)), need[at], 1
        for s in range(len(BITS) - 1, -1, -1):
            while have < COUNTS[s] and len(live):
                inside = at[live] + have < stop[live]
                live, high = live[inside], high[inside]
                high = np.maximum(high, need[at[live] + have])
                have += 1
            fit = high <= s
            live, high = live[fit], high[fit]
            if not len(live):
                break
            sel[live] = s
        all_at.append(at)
        all_sel.append(sel)
        at = at + np.where(sel < 0, 1, COUNTS[sel])
        more = at < stop
        at, stop = at[more], stop[more]
    at, sel = np.concatenate(all_at), np.concatenate(all_sel)
    order = np.argsort(at, kind="stable")
    at, sel = at[order], sel[order]
    words = (sel.astype(np.int64) + 1).astype(np.uint64) << np.uint64(60)
    for s, (bits, count) in enumerate(zip(BITS.tolist(), COUNTS.tolist(), strict=True)):
        w = np.flatnonzero(sel == s)
        for k in range(count if len(w) else 0):
            words[w] |= v[at[w] + k] << np.uint64(k * bits)
    escaped = np.flatnonzero(sel < 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, np.searchsorted(at, np.arange(0, n, block)).astype(np.uint32), v[at[escaped]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of a run of words: one vector operation per selector and place in the word."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.append(1, COUNTS)[sel]
    end = np.cumsum(count)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint64)
    start = end - count
    for s, (bits, n) in enumerate(zip(BITS.tolist(), COUNTS.tolist(), strict=True)):
        w = np.flatnonzero(sel == s + 1)
        mask = np.uint64((1 << bits) - 1)
        for k in range(n if len(w) else 0):
            out[start[w] + k] = (words[w] >> np.uint64(k * bits)) & mask
    e = np.flatnonzero(sel == 0)
    out[start[e]] = escapes[words[e].astype(np.int64)]
    return out


FILE = "part int, chunk int, n_ids long, doc_ids binary, lengths binary, has_id binary, words binary, blocks binary, escapes binary"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, n_parts: int | None = None) -> None:
    """Tokenize whole texts (doc_id, text; other columns are ignored) and write the files.

    Range partitions of (doc_id, hash of text) are sorted and encoded where they lie, in runs of about 1 MB of text, so a
    task's memory does not depend on its partition; rows of one repeated doc_id can spread over partitions. Null text is
    empty, null doc_id comes first, each document ends in `end_id`, an empty table gives files without rows.
    """
    n = n_parts or partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, chunk = encoder(vocabulary), 0
        for b in batches:
            data, at = texts(b.column("text"))
            ids, part = b.column("doc_id"), b.column("part")
            for i, j in slices(at):
                tokens, counts = enc.encode(data, at[i : j + 1])
                ends = np.cumsum(counts)
                tokens = np.insert(tokens, ends, end_id)
                words, blocks, escapes = pack(tokens)
                own = ids.slice(i, j - i)
                raw = [own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), (counts + 1).astype("<u4"), np.packbits(own.is_valid().to_numpy(zero_copy_only=False)), words.astype("<u8"), blocks.astype("<u4"), escapes.astype("<u8")]
                yield pa.RecordBatch.from_arrays([pa.array([part[0].as_py()], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(tokens)], pa.int64()), *(pa.array([r.tobytes()], pa.binary()) for r in raw)], names=[c.split()[0] for c in FILE.split(", ")])
                chunk += 1

    rows.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(encode, FILE).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: doc_id, part, chunk (its run), nth (in the run), inside (ids before it in the run), n_tokens,
    ids_crc32 (of all its ids). read_ids() gives the ids themselves."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["escapes"], "<u8")).astype("<u4")
                length = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(length)
                valid = np.unpackbits(np.frombuffer(r["has_id"], np.uint8), count=len(length)).astype(bool)
                raw, starts = memoryview(ids.tobytes()), ends - length
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(length)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=~valid), pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["chunk"], np.int32)), pa.array(np.arange(n)), pa.array(starts), pa.array(length), pa.array(np.array(crc, np.int64))], names=["doc_id", "part", "chunk", "nth", "inside", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILE).parquet(path)
    return files.mapInArrow(decode, "doc_id long, part int, chunk int, nth long, inside long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids themselves: doc_id, ids (array of int), in ascending order within each run."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["escapes"], "<u8")).astype(np.int32)
                length = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                valid = np.unpackbits(np.frombuffer(r["has_id"], np.uint8), count=len(length)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=~valid), pa.ListArray.from_arrays(np.append(0, np.cumsum(length)).astype(np.int32), pa.array(ids))], names=["doc_id", "ids"])

    return spark.read.schema(FILE).parquet(path).mapInArrow(decode, "doc_id long, ids array<int>")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, chunk, base: ids before each run. Sums of parts (a row per file) are ordered first, then runs within a part."""
    runs = spark.read.schema(FILE).parquet(path).select("part", "chunk", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = runs.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "chunk", (F.col("base") + F.col("own")).alias("base"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public("byte_bpe_50k.json"))
    docs = read_tokens(spark, path).join(starts(spark, path), ["part", "chunk"])
    return docs.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")

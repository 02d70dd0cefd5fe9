"""Removal of repeated byte strings by distributed prefix doubling over sampled suffixes.

Ranks are names: equal strings, and only they, have equal names (Karp, Miller and Rosenberg 1972), here 64-bit hashes. The
rank of a longer string is the pair of two earlier ranks, one at its start and one at an offset: 8 bytes are their own
rank, then 16 and 20, and in the rounds below 40 (offset 20) and 50 (offset 10, where the threshold ends the doubling).

Dense doubling would sort a row for every byte of the corpus in every round. A first round over all positions is only
needed to find the unique ones, and for that a sample chosen by content is enough: every 50-byte string holds a smallest
20-byte rank (its leftmost minimum), equal strings hold it at equal places, and about one position in 16 is such a minimum.

Round 1   sorts sampled positions by the rank of 20 bytes; ranks of a single document are unique and dropped.
Round 2   sorts what is left by that rank and the rank of the whole stretch around it whose 50-byte strings share the
          sampled position: a pair of ranks of 40 bytes, at its start and end. Where an earlier document holds the same
          stretch, all its strings are past the threshold and settled.
Round 3   reranks the other stretches in runs of 11 strings: their common 40 bytes are sorted by the pair of ranks at
          offsets 0 and 20; unique ones are dropped.
Round 4   reranks each string that is left by the pair of 40-byte ranks at offsets 0 and 10: the smallest document of each
          rank keeps it, and it is settled in the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import cut, discard, mix, pair, running_start, sorted_groups, table, unused, worker_of
from spreadloom.llm.tokens import slices, texts

LENGTHS = (20, 40, 50)
SEED, CORE, LENGTH = LENGTHS
REACH, RUN = LENGTH - SEED + 1, LENGTH - CORE + 1
SINGLE, SHARED, WITNESS, SETTLED = range(4)
PIECE, TOGETHER = 1 << 18, 8 << 20

Batches = Iterator[pa.RecordBatch]


def _pack(lo: np.ndarray, back: np.ndarray | int, count: np.ndarray | int, kind: np.ndarray | int) -> np.ndarray:
    """First start, sampled position from there (5 bits), number of strings less 1 (5), kind (2) in one long."""
    return (lo.astype(np.int64) << 12) | (np.int64(1) * back << 7) | ((np.int64(1) * count - 1) << 2) | kind


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 12, (place >> 7) & 31, ((place >> 2) & 31) + 1


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position: a view, not aligned."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def all_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the SEED bytes at each position."""
    w = _words(data).astype(np.uint64)
    n = len(data) - SEED + 1
    return pair(pair(w[:n], w[8 : 8 + n]), w[12 : 12 + n])


def ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings of one of LENGTHS at the given positions."""
    if length == SEED:
        w = _words(data)
        return pair(pair(w[at], w[at + 8]), w[at + 12])
    first, second = rank_pairs(data, at, length)
    return pair(first, second)


def rank_pairs(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The two earlier ranks that make the rank of `length` bytes."""
    before = LENGTHS[LENGTHS.index(length) - 1]
    return ranks(data, at, before), ranks(data, at + length - before, before)


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of 50-byte strings of one text that share their sampled position: text, first start, number, sampled
    position from the first start, its rank, rank of the stretch. For up to 2**20 bytes."""
    base, end = int(offsets[0]), int(offsets[-1])
    data, offsets = data[base:end], np.asarray(offsets, np.int64) - base
    n = len(data)
    if n < LENGTH:
        return (*(np.zeros(0, np.int64),) * 4, *(np.zeros(0, np.uint64),) * 2)
    seeds = all_ranks(data)
    bits = np.uint64(20)
    low = (seeds >> bits << bits) | np.arange(len(seeds), dtype=np.uint64)
    span = 1
    while 2 * span <= REACH:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (REACH - span)], low[REACH - span :])
    anchor = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    out = np.zeros(n + 1, np.int32)  # starts too near the end of their text
    np.add.at(out, np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1]), 1)
    np.add.at(out, offsets[1:], -1)
    inside = np.cumsum(out)[: len(anchor)] == 0
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor))
    keep = inside[first]
    first, last = first[keep], last[keep]
    anchor = anchor[first]
    back, count = anchor - first, last - first
    name = pair(pair(ranks(data, first, CORE), ranks(data, last - 1 + RUN - 1, CORE)), mix((back << 8 | count).astype(np.uint64)))
    doc = np.searchsorted(offsets, first, "right") - 1
    return doc, first - offsets[doc], count, back, seeds[anchor], name


def _pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """stretches() of all texts, some together; a long text in pieces that overlap by 49 bytes, so that each string is in
    one of them and memory does not depend on a text's length."""
    for i, j in slices(at, PIECE):
        begin, size = int(at[i]), int(at[j] - at[i])
        if j > i + 1 or size <= 2 * PIECE:
            doc, lo, *rest = stretches(data, at[i : j + 1])
            yield i + doc, lo, *rest
        else:
            for s in range(0, size - LENGTH + 1, PIECE):
                doc, lo, *rest = stretches(data, np.array([begin + s, begin + min(size, s + PIECE + LENGTH - 1)]))
                yield i + doc, s + lo, *rest


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of overlapping or touching intervals of each row."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.append(True, doc[1:] != doc[:-1])
    group = np.cumsum(new) - 1
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    new[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], np.append(reach[heads[1:] - 1], reach[-1])


def _grouped(*keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys and doc; in that order, whether a row begins a group, and each row's smallest doc in its group."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        v = k[order]
        new[1:] |= v[1:] != v[:-1]
    group = np.cumsum(new) - 1
    return order, new, doc[order][new][group] if len(order) else doc


ROWS = "high long, low long, doc_id long, place long"


def _batch(columns: list[np.ndarray], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, pa.int64()) for c in columns], names=[c.split()[0] for c in names.split(", ")])


def _settled_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans that need no further rank: dealt out by a hash of their own, `low` holds the end."""
    doc, start, end = _merge(doc, start, end)
    return _batch([mix(doc.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64)), end, doc, _pack(start, 0, 1, SETTLED)], ROWS)


def _shared(doc: np.ndarray, new: np.ndarray, bits: int) -> np.ndarray:
    """Of rows in order, whether several documents hold their group's rank."""
    heads, group = np.flatnonzero(new), np.cumsum(new) - 1
    return (np.minimum.reduceat(doc, heads) >> bits != np.maximum.reduceat(doc, heads) >> bits)[group]


def _round1(bits: int) -> Callable[[Batches], Batches]:
    """Rows to sort: high is the rank, low the stretch. What TOGETHER bytes of texts settle by themselves leaves them as
    spans; a rank that several of their documents hold leaves them as one witness, and its rows trade high and low, so
    that a string that a third of the corpus holds gives one row for all of them."""

    def run(batches: Batches) -> Batches:
        worker_of("suffixes")
        for b in batches:
            data, at = texts(b.column("text"))
            at = np.asarray(at, np.int64)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            held: list[tuple[np.ndarray, ...]] = []
            for part in _pieces(data, at):
                held.append(part)
                if sum(len(p[0]) for p in held) >= TOGETHER // 16:
                    yield from _rows1(held, ids, bits)
                    held = []
            if held:
                yield from _rows1(held, ids, bits)

    return run


def _rows1(held: list[tuple[np.ndarray, ...]], ids: np.ndarray, bits: int) -> Batches:
    row, lo, count, back, seed, name = (np.concatenate(c) for c in zip(*held, strict=True))
    if not len(row):
        return
    doc = ids[row]
    order, _, least = _grouped(seed, name, doc=doc)
    row, doc, lo, count, back, seed, name = (x[order] for x in (row, doc, lo, count, back, seed, name))
    settled = doc >> bits > least >> bits
    new = np.append(True, seed[1:] != seed[:-1])
    many = _shared(doc, new, bits)
    first = ~settled
    place = _pack(lo, back, count, np.where(many, SHARED, SINGLE))
    yield _batch([np.where(many, name, seed)[first], np.where(many, seed, name)[first], doc[first], place[first]], ROWS)
    w = np.flatnonzero(new & many)
    if len(w):
        yield _batch([seed[w], seed[w], doc[w], np.full(len(w), WITNESS)], ROWS)
    if settled.any():
        yield _settled_rows(doc[settled], lo[settled], lo[settled] + count[settled] - 1 + LENGTH)


def _pairs(length: int, bits: int) -> Callable[[Batches], Batches]:
    """Rank pairs of the listed places of each text. Before the last round a rank that several documents of a batch hold
    is sent as one witness, and its rows are spread out, as in round 1; in the last round a batch settles its own."""

    def run(batches: Batches) -> Batches:
        worker_of("suffixes")
        for b in batches:
            data, at = texts(b.column("text"))
            at = np.asarray(at, np.int64)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            lists = b.column("places")
            flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(len(ids)), size)
            step = 1 << 15
            for s in range(0, len(flat), step):
                row = of[s : s + step]
                lo, back, count = _unpack(flat[s : s + step])
                if length < LENGTH:
                    # Runs of the offsets 0-10, 11-21 and 22-30 from the sampled position; x: where their common bytes begin.
                    least, most = back - count + 1, back
                    n = most // RUN - least // RUN + 1
                    each = np.repeat(np.arange(len(row)), n)
                    k = (least // RUN)[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    anchor, low, high = (lo + back)[each], np.maximum(least[each], RUN * k), np.minimum(most[each], RUN * k + RUN - 1)
                    x, start, count = anchor - RUN * k, anchor - high, high - low + 1
                else:
                    each = np.repeat(np.arange(len(row)), count)
                    start = x = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                    count = 1
                if len(each):
                    row = row[each]
                    first, second = rank_pairs(data, at[row] + x, length)
                    yield from _rows(length, first, second, ids[row], start, count, bits)

    return run


def _rows(length: int, first: np.ndarray, second: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray | int, bits: int) -> Batches:
    order, new, least = _grouped(first, second, doc=doc)
    count = np.broadcast_to(count, len(doc))
    first, second, doc, start, count = (x[order] for x in (first, second, doc, start, count))
    if length < LENGTH:
        many = _shared(doc, new, bits)
        spread = mix(doc.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64))
        yield _batch([np.where(many, spread, first), second, doc, _pack(start, 0, count, np.where(many, SHARED, SINGLE))], ROWS)
        w = np.flatnonzero(new & many)
        if len(w):
            yield _batch([first[w], second[w], doc[w], np.full(len(w), WITNESS)], ROWS)
    else:
        settled = doc >> bits > least >> bits
        keep = ~settled
        yield _batch([first[keep], second[keep], doc[keep], _pack(start, 0, count, SINGLE)[keep]], ROWS)
        if settled.any():
            yield _settled_rows(doc[settled], start[settled], start[settled] + LENGTH)


def _in_order(batches: Batches, keys: list[str], wait: bool, bits: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Rows sorted by the keys and doc_id, a batch at a time, with the smallest document of each row's group and whether
    several hold it. Groups may be of any size: only where `wait` is set do rows wait, and only while all rows of their
    group are of one document."""
    last: tuple = ()
    least, many = np.int64(0), False
    held: list[pa.RecordBatch] = []
    for b in _then_none(batches):
        if b is not None and not b.num_rows:
            continue
        parts = [*held, *([b] if b is not None else [])]
        held = []
        if not parts:
            continue
        t = pa.Table.from_batches(parts).combine_chunks()
        c = {x: t.column(x).combine_chunks().to_numpy() for x in t.column_names}
        doc, kind = c["doc_id"], c["place"] & 3
        new = np.zeros(len(doc), bool)
        new[0] = last != tuple(c[k][0] for k in keys)
        for k in keys:
            new[1:] |= c[k][1:] != c[k][:-1]
        group = np.cumsum(new)
        smallest = np.append(least, doc[new])[group]
        several = np.bincount(group, (doc >> bits != smallest >> bits) | (kind == WITNESS), group[-1] + 1) > 0
        several[0] |= many
        stop = len(doc)
        if wait and b is not None and not several[-1]:
            stop = int(np.searchsorted(group, group[-1]))
            held = t.slice(stop).combine_chunks().to_batches()
            if group[-1] > 0:
                last, many = (), False
        else:
            last, least, many = tuple(c[k][-1] for k in keys), smallest[-1], bool(several[-1])
        if stop:
            yield {k: v[:stop] for k, v in c.items()}, smallest[:stop], several[group[:stop]]


def _then_none(batches: Batches) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _drop_unique(keys: list[str], bits: int) -> Callable[[Batches], Batches]:
    """Leaves out the ranks that one document alone holds. Rows that traded high and low in round 1 get them back."""

    def run(batches: Batches) -> Batches:
        worker_of("suffixes")
        for c, _, several in _in_order(batches, keys, True, bits):
            kind = c["place"] & 3
            keep = (kind == SHARED) | (kind == SETTLED) | ((kind == SINGLE) & several)
            traded = (kind == SHARED)[keep]
            high, low = c["high"][keep], c["low"][keep]
            yield _batch([np.where(traded, low, high), np.where(traded, high, low), c["doc_id"][keep], c["place"][keep]], ROWS)

    return run


JUDGED = "doc_id long, place long, end long"


def _settle(length: int | None, bits: int) -> Callable[[Batches], Batches]:
    """Rows whose rank an earlier document holds become settled spans; others stay open before the last round, and go in it."""

    def run(batches: Batches) -> Batches:
        worker_of("suffixes")
        for c, least, _ in _in_order(batches, ["high", "low"], False, bits):
            doc, place = c["doc_id"], c["place"]
            lo, _, count = _unpack(place)
            ready = (place & 3) == SETTLED
            later = ~ready & (doc >> bits > least >> bits)
            gone = ready | later
            end = np.where(ready, c["low"], lo + count - 1 + LENGTH)
            d, s, e = _merge(doc[gone], lo[gone], end[gone])
            yield _batch([d, _pack(s, 0, 1, SETTLED), e], JUDGED)
            if length is None:
                yield _batch([doc[~gone], place[~gone], end[~gone]], JUDGED)

    return run


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id")


def numbered(docs: DataFrame, key: str) -> tuple[DataFrame, int]:
    """`docs` with a long of its own for each row, in order of doc_id, in the column `key`; and the number of its lowest
    bits that tell rows of one doc_id apart (null where the row takes no part). Where no doc_id repeats it is the doc_id
    itself, of which only a count is made. Else the ids are ranked (sorted by ranges), and the rows of an id counted off in
    buckets, so that no task gets an id's rows."""
    takes = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    counts = docs.filter(takes).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return docs.withColumn(key, F.when(takes, F.col("doc_id").cast("long"))), 0
    row, match, value = unused(docs, "_row", "_match", "_value")
    copy = cut(docs.withColumn(row, F.monotonically_increasing_id()), "suffix-rows")
    own = copy.filter(takes).select(F.col("doc_id").cast("long").alias("_id"), F.col(row).alias("_row"))
    ranges = cut(counts.select(F.col("doc_id").alias("_id")).repartitionByRange("_id").withColumn("_range", F.spark_partition_id()), "suffix-ids")
    ranks = running_start(ranges.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1)), "_all", "_range", [F.col("_id")], "_one", "_rank").select("_id", "_rank")
    nth = running_start(own.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(4096))).withColumn("_one", F.lit(1)), "_id", "_bucket", [F.col("_row")], "_one", "_nth")
    nth = cut(nth.select("_id", "_row", "_nth"), "suffix-counts")
    bits = int(most - 1).bit_length()
    if ranges.count().bit_length() + bits > 62:
        raise ValueError("doc_ids and their repeats are beyond 62 bits")
    keys = cut(nth.join(ranks, "_id").select(F.col("_row").alias(match), F.shiftleft("_rank", bits).bitwiseOR(F.col("_nth")).alias(value)), "suffix-keys")
    discard(ranges, nth)
    out = copy.join(keys.hint("merge"), copy[row] == keys[match], "left").drop(row, match).withColumnRenamed(value, key)
    out = cut(out, "suffix-numbered")
    discard(copy, keys)
    return out, bits


def repeated_spans(docs: DataFrame, key: str, bits: int) -> DataFrame:
    """doc_id (that is, a row's number in the column `key`, see numbered()), spans: of each row that has any, the disjoint
    byte spans covered by a 50-byte string that a document of smaller doc_id holds too, as int64 pairs (start, end) in order.

    `docs` has text and the key; other columns are ignored. Strings are judged on the input. Rows without a number take no
    part; rows that share a doc_id do not cover each other; texts under 50 bytes have no spans; an empty table gives no
    rows.
    """
    base = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = F.col("place").bitwiseAND(F.lit(3))
    rows = cut(_sorted(base.mapInArrow(_round1(bits), ROWS), "high").mapInArrow(_drop_unique(["high"], bits), ROWS), "suffix-round1")
    judged = cut(_sorted(rows, "high", "low").mapInArrow(_settle(None, bits), JUDGED), "suffix-round2")
    discard(rows)
    open_places, settled = judged.filter(kind != SETTLED), judged.filter(kind == SETTLED)
    for number, length in enumerate(LENGTHS[1:], 3):
        lists = open_places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))  # of one text
        rows = base.join(lists.hint("merge"), "doc_id").select("doc_id", "text", "places").mapInArrow(_pairs(length, bits), ROWS)
        if length < LENGTH:
            open_places = cut(_sorted(rows, "high", "low").mapInArrow(_drop_unique(["high", "low"], bits), ROWS), f"suffix-round{number}")
        else:
            last = cut(_sorted(rows, "high", "low").mapInArrow(_settle(length, bits), JUDGED), f"suffix-round{number}")
            discard(open_places)
            settled = settled.unionByName(last)

    def united(batches: Batches) -> Batches:
        worker_of("suffixes")
        for t, starts in sorted_groups(batches, ["doc_id"], 1 << 17):
            doc, place, end = (t.column(c).combine_chunks().to_numpy() for c in ("doc_id", "place", "end"))
            doc, start, end = _merge(doc, _unpack(place)[0], end)
            heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            raw = np.stack([start, end], 1).astype("<i8").tobytes()
            ends = np.append(heads[1:], len(doc)) * 16
            yield pa.RecordBatch.from_arrays([pa.array(doc[heads], pa.int64()), pa.array([raw[s:e] for s, e in zip((heads * 16).tolist(), ends.tolist(), strict=True)], pa.binary())], names=["doc_id", "spans"])

    out = cut(settled.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(united, "doc_id long, spans binary"), "suffix-spans")
    discard(judged, last)
    return out


def _with_spans(docs: DataFrame, spans: str) -> DataFrame:
    """`docs` with the spans of its rows in a column of the given name."""
    key, number = unused(docs, "_key", "_number")
    rows, bits = numbered(docs, key)
    found = repeated_spans(rows, key, bits).select(F.col("doc_id").alias(number), F.col("spans").alias(spans))
    return rows.join(found.hint("merge"), rows[key] == found[number], "left").drop(key, number)


def _removed(data: bytes, spans: bytes | None, whole_characters: bool = False) -> list[tuple[int, int]]:
    """Removed spans of one text, in order."""
    if not spans:
        return []
    out = [(s, e) for s, e in np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()]
    if whole_characters:
        inner = lambda p: p < len(data) and data[p] & 0xC0 == 0x80
        fixed = []
        for s, e in out:
            while inner(s):
                s += 1
            while inner(e):
                e -= 1
            if s < e:
                fixed.append((s, e))
        return fixed
    return out


def _kept(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in removed:
        parts.append(data[at:s])
        at = e
    return b"".join([*parts, data[at:]])


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; a null text counts as empty. Rows that repeat a
    doc_id are reported one by one and do not cover each other."""

    def run(batches: Batches) -> Batches:
        worker_of("suffixes")
        for b in batches:
            out = []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                data = text.as_py() or b""
                gone = _removed(data, spans)
                out.append((len(data), sum(e - s for s, e in gone), len(gone), hashlib.sha256(_kept(data, gone)).hexdigest()))
            if out:
                n, r, k, h = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, r, k)), pa.array(h)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), "spans")
    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated bytes cut out of its text, and n_chars, if there, counted anew. A character goes only if
    all its bytes do. Rows whose whole text was a repeat are left out; other columns stay, whatever their names."""
    names = docs.columns
    where = names.index("text")

    def run(batches: Batches) -> Batches:
        worker_of("suffixes")
        for b in batches:
            text, keep = [], []
            for t, spans in zip(b.column(where), b.column(len(names)).to_pylist(), strict=True):
                data = t.as_py()
                if data is not None and spans is not None:
                    raw = data.encode("utf-8", "surrogatepass")
                    gone = _removed(raw, spans, True)
                    if gone:
                        data = _kept(raw, gone).decode("utf-8", "replace") or None
                    keep.append(data is not None)
                else:
                    keep.append(True)
                text.append(data)
            columns = list(b.columns[: len(names)])
            columns[where] = pa.array(text, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in text], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    own, = unused(docs, "_spans")
    return _with_spans(docs, own).select(*names, own).mapInArrow(run, docs.schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))

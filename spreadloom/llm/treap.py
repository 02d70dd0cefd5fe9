"""Ranked lexical search in K2-treaps over the term-document grid.

The documents of an input split form blocks. A block's grid has a row for each of its terms, by powers of two of their
frequency and then by their first document, and a column for each document, the shortest first; a cell holds the term's
impact in the document. The grid is kept as a K2-tree (k = 2, Brisaboa et al. 2014): each level has a bit mask of the
non-empty quarters of its nodes and, as the drop from the parent, the largest impact in each node. An item's rows go down
together: a state is a range of documents with the node of each row that covers it, its bound the weighted sum of their
maxima, and the states of the largest bounds are halved first, until no bound reaches the k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.llm.common import cut, discard, table, worker_of
from spreadloom.llm.rules import identities, spans
from spreadloom.llm.tokens import slices, texts

# What a term is made of, and how a score is put together.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K1_MILLE, SCALE, WEIGHT_SCALE = 1000, 1_000_000_000, 1000
TOP = 50

_IN_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
NO_ID = np.iinfo(np.int64).max


def _spread(x: np.ndarray) -> np.ndarray:
    """A zero bit before each bit (up to 32 of them)."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """A K2-treap of different cells: its largest value, the masks of levels 0 to h - 1 and the drops of levels 1 to h.
    Nodes of a level stand in the order of their cells along the z-curve, so children follow one another."""
    height = max(1, int(max(rows.max(), columns.max())).bit_length())
    code = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(code)
    code, v = code[order].astype(np.int64), values[order]
    masks, drops = [], []
    for _ in range(height):
        parent = code >> 2
        heads = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        top = np.maximum.reduceat(v, heads)
        drop = np.repeat(top, np.diff(np.append(heads, len(code)))) - v
        drops.append(drop.astype(np.min_scalar_type(int(drop.max()))))
        masks.append(np.add.reduceat(np.left_shift(1, code & 3), heads).astype(np.uint8))
        code, v = parent[heads], top
    return int(v[0]), masks[::-1], drops[::-1]


class Treap:
    """A built treap, ready to be walked: nodes of all levels in one array, an empty one at its end."""

    def __init__(self, top: int, masks: list[np.ndarray], drops: list[np.ndarray]):
        self.height, self.top = len(masks), top
        inner = np.concatenate(masks)
        n = 1 + sum(map(len, drops)) + 1
        self.mask, self.first, self.drop = np.zeros(n, np.uint8), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.mask[: len(inner)] = inner
        children = np.bitwise_count(inner)
        self.first[: len(inner)] = 1 + np.cumsum(children, dtype=np.int64) - children
        self.drop[1 : n - 1] = np.concatenate(drops)
        self.empty = n - 1

    def halves(self, level: np.ndarray, node: np.ndarray, value: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes and values of the lower and of the upper half of each state's range. `bits`: (level, row) the row's bit."""
        mask, first = self.mask[node], self.first[node]
        upper = 2 * bits[level]
        for half in (0, 1):
            quarter = (upper + half).astype(np.uint8)
            there = (mask >> quarter) & 1 == 1
            child = np.where(there, first + np.bitwise_count(mask & ((np.uint8(1) << quarter) - np.uint8(1))), self.empty)
            yield child, np.where(there, value - self.drop[child], 0)


class Best:
    """The k best (score, document) of an item: higher scores first, then smaller ids. `floor` is a score and an id that k
    documents are known to reach."""

    def __init__(self, k: int, floor: tuple[int, int] = (0, NO_ID)):
        self.k, self.floor = k, floor
        self.score, self.doc, self.named = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def may_enter(self, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        score, doc = self.floor
        return (bound > score) | ((bound == score) & (least <= doc) & (bound > 0))

    def add(self, score: np.ndarray, doc: np.ndarray, named: np.ndarray) -> None:
        score, doc, named = np.append(self.score, score), np.append(self.doc, doc), np.append(self.named, named)
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc, self.named = score[order], doc[order], named[order]
        if len(order) == self.k:
            self.floor = max(self.floor, (int(self.score[-1]), int(self.doc[-1])), key=lambda x: (x[0], -x[1]))


def search(treap: Treap, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, named: np.ndarray, least: list[np.ndarray], best: Best, together: int = 512) -> None:
    """Best-first descent of an item's rows over document ranges, `together` states at a time; the documents found go into
    `best`. `least[level]`: the smallest id in each range of that level."""
    h = treap.height
    bits = ((rows[None, :] >> np.arange(h - 1, -1, -1)[:, None]) & 1).astype(np.int64)
    level, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
    node, value = np.zeros((1, len(rows)), np.int64), np.full((1, len(rows)), treap.top, np.int64)
    bound, low = value @ weights, least[0]
    while True:
        fit = best.may_enter(bound, low)
        if not fit.all():
            level, column, node, value, bound, low = (x[fit] for x in (level, column, node, value, bound, low))
        if not len(bound):
            return
        if len(bound) > together:
            order = np.argpartition(-bound, together)
            now, later = order[:together], order[together:]
        else:
            now, later = slice(None), slice(0, 0)
        halves = [[x[later] for x in (level, column, node, value, bound, low)]]
        down = level[now] + 1
        for half, (child, worth) in enumerate(treap.halves(level[now], node[now], value[now], bits)):
            at, total = 2 * column[now] + half, worth @ weights
            some = np.flatnonzero(total > 0)
            child, worth, at, total, new = child[some], worth[some], at[some], total[some], down[some]
            done = new == h
            if done.any():
                best.add(total[done], ids[at[done]], named[at[done]])
                child, worth, at, total, new = (x[~done] for x in (child, worth, at, total, new))
            mine = np.empty(len(at), np.int64)
            for d in np.unique(new):
                mine[new == d] = least[d][at[new == d]]
            halves.append([new, at, child, worth, total, mine])
        level, column, node, value, bound, low = (np.concatenate(x) for x in zip(*halves, strict=True))


BLOCK = "block long, n_docs int, ids binary, named binary, terms binary, frequencies binary, top int, masks array<binary>, drops array<binary>"
BLOCK_DOCS, BLOCK_BYTES = 1 << 14, 4 << 20


def term_counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of the texts data[at[i]:at[i + 1]], in lower case: (text, term, occurrences) of each term in each text, and the terms."""
    data, at = _LOWER[data[int(at[0]) : int(at[-1])]], np.asarray(at, np.int64) - int(at[0])
    start, end = spans(_IN_TERM[data], at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    which = identities(data, start, end)
    n = int(which.max()) + 1
    pair, times = np.unique((np.searchsorted(at, start, "right") - 1) * n + which, return_counts=True)
    used, first = np.unique(which, return_index=True)
    raw = data.tobytes()
    terms = [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    return pair // n, np.searchsorted(used, pair % n), times, terms


class _Blocks:
    """Documents of a split, gathered to blocks."""

    def __init__(self, n_texts: int, n_terms: int):
        self.n_texts, self.n_terms = n_texts, n_terms
        self.clear()

    def clear(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.ids: list[np.ndarray] = []
        self.named: list[np.ndarray] = []
        self.n_docs = self.bytes = 0

    def add(self, data: np.ndarray, at: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        text, term, times, terms = term_counts(data, at)
        mine = self.vocabulary
        number = np.fromiter((mine.setdefault(t, len(mine)) for t in terms), np.int64, len(terms))
        self.parts.append(tuple(x.astype(np.int32) for x in (text + self.n_docs, number[term], times)))
        self.ids.append(ids)
        self.named.append(named)
        self.n_docs += len(ids)
        self.bytes += int(at[-1] - at[0])

    def close(self, block: int) -> dict | None:
        """The block as a row of BLOCK; None where no document has a term."""
        doc, term, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts.clear()
        ids, named = np.concatenate(self.ids), np.concatenate(self.named)
        if not len(doc):
            return None
        length = np.bincount(doc, times, len(ids)).astype(np.int64)
        order = np.lexsort((ids, length))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        held = np.bincount(term, minlength=len(self.vocabulary))
        # Terms of one document or few stand beside those that begin there too, so that empty quarters are large.
        begins = np.full(len(held), len(ids))
        np.minimum.at(begins, term, place[doc])
        by_frequency = np.lexsort((begins, -np.frexp(held)[1]))
        row = np.empty(len(held), np.int64)
        row[by_frequency] = np.arange(len(held))
        size = np.array([50 + 50 * n * self.n_texts // self.n_terms for n in length.tolist()], np.int64)
        times = times.astype(np.int64)
        impact = (SCALE * times // (K1_MILLE * times + 20 * size[doc])).astype(np.int32)
        top, masks, drops = build(row[term], place[doc], impact)
        words = list(self.vocabulary)
        return {
            "block": block, "n_docs": len(ids), "ids": ids[order].tobytes(), "named": named[order].tobytes(), "terms": b" ".join([words[i] for i in by_frequency.tolist()]),
            "frequencies": held[by_frequency].astype(np.int32).tobytes(), "top": top, "masks": [m.tobytes() for m in masks], "drops": [d.tobytes() for d in drops],
        }


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("ranked index")
        some = every = 0
        for b in batches:
            data, at = texts(b.column("text"))
            for i, j in slices(at):
                own = np.asarray(at[i : j + 1], np.int64) - int(at[i])
                n = np.bincount(np.searchsorted(own, spans(_IN_TERM[data[at[i] : at[j]]], own)[0], "right") - 1, minlength=j - i)
                some, every = some + int((n > 0).sum()), every + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([every])], names=["some", "every"])

    total = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "some long, every long").agg(F.sum("some"), F.sum("every")).first()
    return total[0] or 0, total[1] or 0


def index_documents(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """The treaps of all documents and all their terms, a row of BLOCK per `block_docs` documents or `block_bytes` of text at
    most of one input split, written out; and the numbers of documents with a term and of terms. Nothing is shuffled.
    `docs` has doc_id and text; other columns are ignored. Documents without terms (null and empty texts) are left out of
    no count but that of documents with a term."""
    n_texts, n_terms = corpus_size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("ranked index")
        held, block = _Blocks(n_texts, max(1, n_terms)), None
        schema = pa.schema([("block", pa.int64()), ("n_docs", pa.int32()), *((c, pa.binary()) for c in ("ids", "named", "terms", "frequencies")), ("top", pa.int32()), ("masks", pa.list_(pa.binary())), ("drops", pa.list_(pa.binary()))])

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal block
            row = held.close(block)
            block += 1
            held.clear()
            if row:
                yield pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            if not b.num_rows:
                continue
            block = b.column("part")[0].as_py() << 40 if block is None else block
            data, at = texts(b.column("text"))
            ids, named = b.column("doc_id").fill_null(NO_ID).to_numpy(), np.asarray(b.column("doc_id").is_valid())
            for i, j in slices(at):
                for s in range(i, j, block_docs):
                    e = min(j, s + block_docs)
                    if held.n_docs and (held.n_docs + e - s > block_docs or held.bytes + int(at[e] - at[s]) > block_bytes):
                        yield from closed()
                    held.add(data, at[s : e + 1], ids[s:e], named[s:e])
        if held.n_docs:
            yield from closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.spark_partition_id().cast("long").alias("part"))
    return cut(rows.mapInArrow(run, BLOCK), "treaps"), n_texts, n_terms


def _opened(block: dict) -> tuple[Treap, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A row of BLOCK as treap, ids, whether they are ids, and the smallest id in each range of each level."""
    masks = [np.frombuffer(m, np.uint8) for m in block["masks"]]
    drops = []
    for m, d in zip(masks, block["drops"], strict=True):
        n = int(np.bitwise_count(m).sum())
        drops.append(np.frombuffer(d, f"u{len(d) // n}"))
    treap = Treap(block["top"], masks, drops)
    ids, named = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["named"], bool)
    lows = np.full(1 << treap.height, NO_ID)
    lows[: len(ids)] = ids
    least = [lows]
    for _ in range(treap.height):
        least.append(np.minimum(least[-1][::2], least[-1][1::2]))
    return treap, ids, named, least[::-1]


@contextmanager
def _block_by_block(spark: SparkSession) -> Iterator[None]:
    """Blocks are read and sent to Python one at a time, so that a task holds one, however many a file has."""
    own = {"spark.sql.parquet.enableVectorizedReader": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
    was = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


HIT = "item int, doc_id long, named boolean, score long"


def _search_blocks(index: DataFrame, items: list[dict[bytes, int]], k: int, floors: list[tuple[int, int]]) -> DataFrame:
    """The k best documents of each item among the blocks of each task; `items`: weight by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("ranked search")
        best = [Best(k, f) for f in floors]
        wanted = frozenset(chain.from_iterable(items))
        for b in batches:
            for r in range(b.num_rows):
                block = {c: b.column(c)[r].as_py() for c in ("ids", "named", "terms", "top", "masks", "drops")}
                row = {t: i for i, t in enumerate(block["terms"].split(b" ")) if t in wanted}
                treap, ids, named, least = _opened(block)
                for item, found in zip(items, best, strict=True):
                    mine = [(row[t], w) for t, w in item.items() if t in row]
                    if mine:
                        rows, weights = (np.array(x, np.int64) for x in zip(*mine, strict=True))
                        search(treap, rows, weights, ids, named, least, found)
        n = [len(x.score) for x in best]
        columns = [np.repeat(np.arange(len(items), dtype=np.int32), n), *(np.concatenate([getattr(x, c) for x in best]) for c in ("doc", "named", "score"))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in HIT.split(", ")])

    return index.select("ids", "named", "terms", "top", "masks", "drops").mapInArrow(run, HIT)


def _frequencies(index: DataFrame, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the wanted terms; a number per term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("ranked search")
        total: dict[bytes, int] = {}
        for b in batches:
            for terms, held in zip(b.column("terms").to_pylist(), b.column("frequencies").to_pylist(), strict=True):
                for t, n in zip(terms.split(b" "), np.frombuffer(held, np.int32).tolist(), strict=True):
                    if t in wanted:
                        total[t] = total.get(t, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    rows = index.select("terms", "frequencies").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in rows.collect()}


ITEMS, SEED_BLOCKS = 1024, 4


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES, items_at_once: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of `docs` (doc_id, text) with a score above 0 of each row of `items`
    (item_id, text), exact; fewer where fewer score. Other columns are ignored.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. With N documents
    that have terms, L terms in them, n in one and df documents of a term: its weight is floor(1000 ln((2N + 2) / (2 df + 1))),
    its impact 10^9 tf div (1000 tf + 20 m), m = 50 + (50 n N) div L, and a score sums weight times impact over an item's
    terms, once each. Equal scores stand by doc_id, null ids last; rows that repeat an id or an item count as rows. Null and
    empty texts have no terms; an empty table gives no rows.

    All documents and all their terms are indexed in two readings, where they lie. Items come to the driver and go to the
    tasks `items_at_once` at a time, whatever their number. A first search of SEED_BLOCKS blocks gives each item a score
    that k documents reach, below which the search of all blocks goes down nowhere; a task sends k documents an item.
    """
    spark = docs.sparkSession
    index, n_texts, _ = index_documents(docs, block_docs, block_bytes)
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    stated = items.select("item_id", F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("terms")).toLocalIterator()
    first = [r["block"] for r in index.select("block").orderBy(F.xxhash64("block"), "block").limit(SEED_BLOCKS).collect()]
    item_type = items.schema["item_id"].dataType.simpleString()
    by_item = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("named").desc(), "doc_id")
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    while some := list(islice(stated, items_at_once)):
        with _block_by_block(spark):
            held = _frequencies(index, frozenset(t.encode() for r in some for t in r["terms"]))
            weight = {t: math.floor(WEIGHT_SCALE * math.log((2 * n_texts + 2) / (2 * n + 1))) for t, n in held.items()}
            weights = [{t: weight[t] for t in (x.encode() for x in r["terms"]) if weight.get(t)} for r in some]
            best = lambda rows: rows.withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= k)
            seed = best(_search_blocks(index.filter(F.col("block").isin(first)), weights, k, [(0, NO_ID)] * len(some))).filter(F.col("rank") == k).collect()
            floors = [(0, NO_ID)] * len(some)
            for r in seed:
                floors[r["item"]] = r["score"], r["doc_id"]
            found = cut(best(_search_blocks(index, weights, k, floors)), "ranked-items")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], f"item int, item_id {item_type}")
        # As many names as items that are searched at once.
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "score"))
    discard(index)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS row, * FROM documents)),
wanted AS (
  SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS item, * FROM benchmark)),
held AS (SELECT row, doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM terms GROUP BY row, doc_id, term),
sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY row),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY term, docs),
impacts AS (SELECT h.row, doc_id, h.term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)) AS impact FROM held h JOIN sizes s ON h.row = s.row, corpus),
scores AS (
  SELECT item, item_id, row, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM wanted q JOIN weights v ON q.term = v.term JOIN impacts i ON q.term = i.term GROUP BY item, item_id, row, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""

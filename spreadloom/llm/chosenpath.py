"""N-gram Jaccard join by chosen paths: sets are split again and again on tokens that they share, small buckets are
compared by brute force, and independent runs are repeated until the target recall."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import block_pairs, components, cut, discard, large_keys, local_roots, meet_large, sorted_groups, table, worker_of
from spreadloom.llm.shingles import MinHash, set_names, shingle_sets
from spreadloom.llm.tokens import slices, texts

WIDTH, DEPTH, CHILDREN = 64, 4, 2


def signatures(docs: DataFrame, k: int, row: str | None = None) -> DataFrame:
    """row (that column, or a number), doc_id, name and check (of the shingle set, null without words), size, sig (array
    of WIDTH sampled tokens). Numbers given here hold only once the rows are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("jaccard join")
        hashes = MinHash(WIDTH)
        for b in batches:
            data, at = texts(b.column("text"))
            for i, j in slices(at, 1 << 20):
                sets, counts = shingle_sets(data, at[i : j + 1], k)
                sig = hashes.of(sets, counts).view(np.int32)
                names = [pa.array(x, mask=counts == 0) for x in set_names(sets, counts)]
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, j - i), b.column("doc_id").slice(i, j - i), *names, pa.array(counts), pa.ListArray.from_arrays(np.arange(0, (j - i + 1) * WIDTH, WIDTH, dtype=np.int32), pa.array(sig.ravel()))], names=["row", "doc_id", "name", "check", "size", "sig"])

    number = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "row long, doc_id long, name long, check long, size long, sig array<int>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """name, check, tokens (the set, sorted, 64-bit little-endian) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("jaccard join")
        for b in batches:
            data, at = texts(b.column("text"))
            for i, j in slices(at, 1 << 20):
                sets, counts = shingle_sets(data, at[i : j + 1], k)
                raw, ends = sets.tobytes(), (8 * np.cumsum(counts)).tolist()
                parts = [raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, set_names(sets, counts)), pa.array(parts, pa.binary())], names=["name", "check", "tokens"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "name long, check long, tokens binary")


def leaves(classes: DataFrame, runs: int, most: int) -> DataFrame:
    """key, cid: the buckets that are left to brute force, of two classes or more, written out.

    Each run splits all sets on one sampled token. A bucket of more than `most` sets is split again on CHILDREN tokens
    chosen by its path (1 / threshold would do on average; two keep a pair together more surely), DEPTH times at most.
    A bucket of which half or more would stay together is a group of sets alike: splitting it further only repeats it,
    so it is left whole, as is what remains large at the end, and dealt out in block pairs.
    """
    sigs = classes.select("cid", "sig")
    token = F.element_at("sig", (F.col("coord") + 1).cast("int"))
    nodes = sigs.withColumn("coord", F.explode(F.array(*[F.lit(r) for r in range(runs)]))).select("cid", F.xxhash64(F.col("coord"), token).alias("key"))
    out, spent = [], []
    for depth in range(DEPTH + 1):
        nodes = cut(nodes, f"path-level{depth}")
        spent.append(nodes)
        hot = large_keys(nodes, "key", most, f"path-large{depth}")
        spent.append(hot)
        small = meet_large(nodes, hot, "key", "cid", "left_anti")
        several = small.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        out.append(small.join(several, "key", "left_semi").select("key", "cid"))
        large = meet_large(nodes, hot, "key", "cid", "inner").withColumnRenamed("_n", "n")
        if depth == DEPTH:
            out.append(large.select("key", "cid"))
            break
        split = large.withColumn("child", F.explode(F.array(*[F.lit(c) for c in range(CHILDREN)]))).withColumn("coord", F.pmod(F.xxhash64("key", "child"), F.lit(WIDTH)))
        split = cut(split.join(sigs, "cid").select("cid", F.col("key").alias("parent"), "n", F.xxhash64("key", "child", token).alias("key")), f"path-split{depth}")
        spent.append(split)
        if split.isEmpty():
            break
        shares = split.groupBy("parent", "key", "n").agg(F.count("*").alias("m")).groupBy("parent").agg(F.max(F.col("m") / F.col("n")).alias("share"))
        alike = cut(shares.filter("share >= 0.5").select("parent"), f"path-alike{depth}")
        spent.append(alike)
        out.append(meet_large(split, alike, "parent", "cid", "left_semi").select(F.col("parent").alias("key"), "cid").distinct())
        nodes = meet_large(split, alike, "parent", "cid", "left_anti").select("cid", "key")
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    found = cut(found.distinct(), "join-buckets")
    discard(*spent)
    return found


def _candidates(sig: np.ndarray, size: np.ndarray, keys: list[np.ndarray], block: np.ndarray, cross: bool, key: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of one bucket that may reach `least` and whose smallest common bucket this is.

    The share of equal samples of a pair at the threshold lies 5 standard deviations below it once in millions.
    """
    n = len(sig)
    bar = math.ceil(WIDTH * (least - 5 * math.sqrt(least * (1 - least) / WIDTH)))
    found_i, found_j = [], []
    for i in range(n - 1):
        ok = (np.minimum(size[i], size[i + 1 :]) >= least * np.maximum(size[i], size[i + 1 :]) - 1e-9) & ((sig[i] == sig[i + 1 :]).sum(1) >= bar)
        if cross:
            ok &= block[i + 1 :] != block[i]
        j = i + 1 + np.flatnonzero(ok)
        found_i.append(np.full(len(j), i))
        found_j.append(j)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    if len(i):
        # Keys smaller than this one, as columns: a pair that shares any of them was met there.
        low = [k[k < key] for k in keys]
        names, which = np.unique(np.concatenate(low), return_inverse=True)
        if len(names):
            row = np.repeat(np.arange(n), [len(x) for x in low])
            first = _common(row, which, n, (i, j)) == 0
            i, j = i[first], j[first]
    return i, j


def _common(row: np.ndarray, col: np.ndarray, n: int, at: tuple[np.ndarray, np.ndarray], step: int = 1 << 13) -> np.ndarray:
    """How many columns the rows of each pair have in common, of the cells (row, col), in slices of the columns."""
    count = np.bincount(col)
    keep = count[col] > 1  # a column of one row only is in no intersection
    name = np.cumsum(count > 1) - 1
    row, col = row[keep], name[col[keep]]
    total = np.zeros(len(at[0]), np.int64)
    for c in range(0, int(name[-1]) + 1 if len(name) else 0, step):
        inside = (col >= c) & (col < c + step)
        has = np.zeros((n, int(min(step, name[-1] + 1 - c))), np.float32)
        has[row[inside], col[inside] - c] = 1
        total += (has @ has.T)[at].astype(np.int64)
    return total


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs (i, j)."""
    if len(i) <= 4:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    need = np.unique(np.concatenate([i, j]))
    which = np.unique(np.concatenate([sets[k] for k in need]), return_inverse=True)[1]
    row = np.repeat(np.arange(len(need)), [len(sets[k]) for k in need])
    return _common(row, which, len(need), (np.searchsorted(need, i), np.searchsorted(need, j)))


def jaccard_join(docs: DataFrame, k: int = 5, least: float = 0.8, recall: float = 0.99999, most: int = 512, row: str | None = None) -> DataFrame:
    """One row per document (doc_id, text; other columns are ignored): doc_id, n_links, class_id, kept, and the column
    `row` (long, one value per row) where it is named.

    n_links: other documents whose sets of k-word shingles have Jaccard similarity `least` or more with its own.
    class_id: the smallest doc_id that links reach; kept: true of one row that has it, for each group of linked rows.
    Texts with equal sets (told by two 64-bit names) are one class throughout, which goes by a number of its own. Candidates
    are verified on whole sets, so every link is right. Runs choose among WIDTH shared samples, so they are independent only
    as far as those are; a pair at the threshold is lost with a probability of about 1 - `recall`, more similar ones far
    less often, and tests hold all pairs just above the threshold against brute force.

    Null and wordless texts, and rows with a null doc_id, link with nothing and are kept. Rows that repeat a doc_id count
    as documents of their own, linked by their texts alone. An empty table gives no rows.
    """
    rows = cut(signatures(docs, k, row), "join-signatures")
    usable = rows.filter("name is not null and doc_id is not null")
    classes = usable.groupBy("name", "check").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n"), F.any_value("size").alias("size"), F.any_value("sig").alias("sig"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "join-classes")
    stay = least * (1 - (1 - least) ** CHILDREN) ** DEPTH  # least chance that a run keeps a pair at the threshold together
    runs = math.ceil(math.log(1 - recall) / math.log(1 - stay))
    buckets = leaves(classes, runs, most)
    own_keys = buckets.groupBy("cid").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    info = classes.select("cid", "rep", "n", "size", "sig").join(own_keys, "cid")
    dealt = block_pairs(buckets, "key", "cid", most).join(info, "cid")
    order = ["key", "b1", "b2"]
    columns = [*order, "_b", "cid", "rep", "n", "size", "sig", "keys"]
    dealt = dealt.repartition(*order).sortWithinPartitions(*order).select(*columns)

    def groups(batches: Iterator[pa.RecordBatch]):
        """For each bucket: its slice of the columns and its candidate pairs."""
        worker_of("jaccard join")
        for t, starts in sorted_groups(batches, order):
            c = {x: t.column(x).combine_chunks().to_numpy() for x in (*order, "_b", "cid", "rep", "n", "size")}
            sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
            lists = t.column("keys").combine_chunks()
            flat, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s > 1:
                    keys = [flat[at[r] : at[r + 1]] for r in range(s, e)]
                    i, j = _candidates(sig[s:e], c["size"][s:e], keys, c["_b"][s:e], bool(c["b1"][s] != c["b2"][s]), int(c["key"][s]), least)
                    if len(i):
                        yield t, c, s, e, i, j

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, s, _, i, j in groups(batches):
            rows = t.take(pa.array(s + np.unique(np.concatenate([i, j]))))
            yield from rows.combine_chunks().to_batches()

    schema = "key long, b1 long, b2 long, _b long, cid long, rep long, n long, size long, sig array<int>, keys array<long>"
    # A bucket's members that have a candidate meet again, now with their whole sets.
    members = cut(dealt.mapInArrow(needed, schema), "join-members")
    wanted = members.select(F.col("rep").alias("_rep")).distinct()
    sources = docs.join(wanted, docs["doc_id"].cast("long") == wanted["_rep"], "left_semi")
    named = members.select("cid").distinct().join(classes.select("cid", "name", "check"), "cid")
    sets = _sets(sources, k).join(named, ["name", "check"]).groupBy("cid").agg(F.any_value("tokens").alias("tokens"))
    ready = members.join(sets, "cid").repartition(*order).sortWithinPartitions(*order).select(*columns, "tokens")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, c, s, e, i, j in groups(batches):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("tokens").slice(s, e - s)]
            both = _intersections(sets, i, j)
            size = c["size"][s:e]
            right = both >= least * (size[i] + size[j] - both) - 1e-9
            i, j = i[right], j[right]
            if len(i):
                n = c["n"][s:e]
                links = np.bincount(np.concatenate([i, j]), np.concatenate([n[j], n[i]]), e - s).astype(np.int64)
                own, root = np.flatnonzero(links), local_roots(e - s, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c["cid"][s + own], links[own], c["cid"][s + root[own]])], names=["cid", "links", "root"])

    found = cut(ready.mapInArrow(linked, "cid long, links long, root long"), "join-links")
    discard(members, buckets)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), "join")
    known = classes.select("cid", "name", "check", "first", "n").join(links, "cid", "left").join(joined, F.col("cid") == F.col("id"), "left").withColumn("component", F.coalesce("component", "cid"))
    heads = known.groupBy(F.col("component").alias("id")).agg(F.min("first").alias("head"))
    known = known.drop("id").join(heads, F.col("component") == F.col("id"))
    known = known.select(F.col("name").alias("_name"), F.col("check").alias("_check"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "head")
    out = rows.select("row", "doc_id", "name", "check").join(known, (F.col("name") == F.col("_name")) & (F.col("check") == F.col("_check")) & F.col("doc_id").isNotNull(), "left")
    columns = ["doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("head.doc_id", "doc_id").alias("class_id"), F.coalesce(F.col("row") == F.col("head.row"), F.lit(True)).alias("kept")]
    return out.select(*columns, *([F.col("row").alias(row)] if row else []))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))

"""Near-duplicate embeddings by E8 lattice hashing."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import block_pairs, components, cut, discard, local_roots, mix, sorted_groups, table, worker_of


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) == 1]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer vectors of even sum: round, and where the sum is odd move the worst-rounded entry the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    off = x[odd] - r[odd]
    worst = np.abs(off).argmax(1)
    r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of the integer and the half-integer coset (Conway and Sloane 1982)."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class LatticeHash:
    """Keys of unit vectors in several tables. A key names the E8 points nearest to `blocks` random 8-dimensional
    projections; a vector's probes are the keys with one of those points moved to one of its nearest neighbours."""

    def __init__(self, dim: int, tables: int, blocks: int, probes: int, scale: float, seed: int = 5):
        self.tables, self.blocks, self.probes = tables, blocks, probes
        rng = np.random.default_rng([seed, dim])
        self.axes = rng.standard_normal((tables, blocks, dim, 8)) / scale
        self.coins = rng.integers(1, 1 << 62, (tables, blocks, 8)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = dim * 1_000_003
        self.roots = e8_roots()

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home keys (n, tables) and probe keys (n, tables, blocks * probes)."""
        n = len(x)
        home = np.zeros((n, self.tables), np.uint64)
        probe = np.zeros((n, self.tables, self.blocks * self.probes), np.uint64)
        for t in range(self.tables):
            names, moved = [], []
            for b in range(self.blocks):
                p = x @ self.axes[t, b]
                h = e8_nearest(p)
                near = np.argpartition(-((p - h) @ self.roots.T), self.probes, axis=1)[:, : self.probes]
                name = lambda q, b=b: ((2 * q).astype(np.int64).astype(np.uint64) * self.coins[t, b]).sum(-1, dtype=np.uint64)
                names.append(name(h))
                moved.append(name(h[:, None, :] + self.roots[near]))
            total = np.sum(names, axis=0, dtype=np.uint64) + np.uint64(((t + 1) * 0x9E3779B97F4A7C15 + self.salt) % (1 << 64))
            home[:, t] = mix(total)
            for b in range(self.blocks):
                probe[:, t, b * self.probes : (b + 1) * self.probes] = mix((total - names[b])[:, None] + moved[b])
        return home.view(np.int64), probe.view(np.int64)


@functools.cache
def meeting_rates(least: float, scale: float, probes: int, n: int = 40_000) -> tuple[float, float]:
    """Least rates at which two unit vectors of cosine `least` share a block's E8 point, and at which they share it or one
    has the other's among its probes: measured on the pair's projections (normal, correlated by `least`, whatever the
    dimension), less 5 standard errors."""
    rng, roots = np.random.default_rng(11), e8_roots()
    home = met = 0
    for _ in range(n // 4000):
        u, v = rng.standard_normal((2, 4000, 8)) / scale
        v = least * u + math.sqrt(1 - least * least) * v
        a, b = e8_nearest(u), e8_nearest(v)
        same = (a == b).all(1)
        either = same
        for x, h, other in ((u, a, b), (v, b, a)):
            near = np.argpartition(-((x - h) @ roots.T), probes, axis=1)[:, :probes]
            either = either | (h[:, None, :] + roots[near] == other[:, None, :]).all(2).any(1)
        home, met = home + int(same.sum()), met + int(either.sum())
    low = lambda k: max(0.0, k / n - 5 * math.sqrt(k / n * (1 - k / n) / n))
    return low(home), low(met)


def tables_needed(blocks: int, least: float, scale: float, probes: int, miss: float) -> int:
    """Tables in which a pair at the threshold misses in all with probability `miss` at most. A probe moves one block only,
    so a pair meets in a table where all blocks agree at home, or all but one do and that one meets by a probe."""
    h, p = meeting_rates(least, scale, probes)
    rate = h**blocks + blocks * h ** (blocks - 1) * (p - h)
    if rate <= 0:
        raise ValueError(f"pairs of cosine {least} hardly ever meet at scale {scale} with {probes} probes")
    return max(1, math.ceil(math.log(miss) / math.log(max(1 - rate, miss))))


SKETCH = 128


def _sketches(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """(n, 2): the signs of SKETCH random projections."""
    return np.packbits(x @ axes > 0, axis=1).view(np.uint64)


def _unit(flat: np.ndarray, rows: int) -> np.ndarray:
    """Rows of length 1. They are divided by their largest component first, whose square may be beyond a double's range."""
    x = flat.reshape(rows, -1).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_vectors(vectors: DataFrame, least: float = 0.95, scale: float = 1.5, probes: int = 4, miss: float = 1e-3, most: int = 512, blocks: int | None = None) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding; other columns are ignored): vec_id, n_links, component_id, kept.

    Equal vectors (told by two 64-bit names) are one class, hashed once. Classes meet where one's home key is the other's
    home or probe key in some table. What meets first is narrow: a key, a class and a sketch of SKETCH signs, by which
    members without a possible partner drop out (a pair at the threshold does so once in millions). The others fetch their
    vectors and meet again: each pair is verified by its cosine in double precision and counted at its first meeting
    only. Large cells are cut into block pairs; tasks give sums and stars of links, never pairs. The number of E8 points in
    a key grows with the logarithm of the number of vectors so that cells stay small (unless `blocks` gives it), and the
    number of tables with it, so that a pair at the threshold is missed with probability `miss` at most (tables_needed).

    Null vectors, zero vectors and those holding null or non-finite components, and rows with a null vec_id, link with
    nothing: they are kept with 0 links. Rows that repeat a vec_id are vectors of their own. Vectors of different lengths
    never link. An empty table gives no rows.
    """
    real = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{real}>").alias("embedding"))
    # Adding 0 makes -0 and 0 equal.
    e = F.transform("embedding", lambda x: x + F.lit(0).cast(real))
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.select("vec_id", F.when(fine, e).alias("embedding"))
    rows = cut(rows.withColumns({"name": F.xxhash64("embedding"), "check": F.xxhash64(F.lit(1), "embedding")}), "vectors")
    classes = rows.filter("embedding is not null").groupBy("name", "check").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    count = classes.count()
    blocks = blocks or max(1, math.ceil(math.log(max(count, 1) / 64) / math.log(3000)))
    tables = tables_needed(blocks, least, scale, probes, miss)
    n_keys = tables * (1 + blocks * probes)
    turned = math.acos(min(1.0, least)) / math.pi
    bar = math.floor(SKETCH * turned + 5 * math.sqrt(SKETCH * turned * (1 - turned)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("near vectors")
        hashes: dict[int, tuple[LatticeHash, np.ndarray]] = {}
        for b in batches:
            column = b.column("embedding")
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            at = np.append(0, np.cumsum(size))
            cid = b.column("cid").to_numpy()
            for dim in np.unique(size).tolist():
                if dim not in hashes:
                    hashes[dim] = LatticeHash(dim, tables, blocks, probes, scale), np.random.default_rng([17, dim]).standard_normal((dim, SKETCH))
                pick = np.flatnonzero(size == dim)
                for s in range(0, len(pick), 1000):
                    own = pick[s : s + 1000]
                    x = _unit(flat[at[own][:, None] + np.arange(dim)], len(own))
                    home, probe = hashes[dim][0].keys(x)
                    keys = np.concatenate([home[:, :, None], probe], 2).reshape(len(own), -1)
                    sketch = np.repeat(_sketches(x, hashes[dim][1]).view(np.int64), n_keys, axis=0)
                    at_home = np.tile(np.arange(n_keys) % (1 + blocks * probes) == 0, len(own))
                    columns = [keys.ravel(), at_home, np.repeat(cid[own], n_keys), sketch[:, 0].copy(), sketch[:, 1].copy()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "home", "cid", "s0", "s1"])

    order = ["cell", "b1", "b2"]
    met = cut(classes.select("cid", "embedding").mapInArrow(hashed, "cell long, home boolean, cid long, s0 long, s1 long"), "vector-keys")
    dealt = block_pairs(met, "cell", "cid", most).repartition(*order).sortWithinPartitions(*order)
    dealt = dealt.select(*order, "_b", "home", "cid", "s0", "s1")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("near vectors")
        for t, starts in sorted_groups(batches, order):
            home = t.column("home").combine_chunks().to_numpy(zero_copy_only=False)
            block, b1, b2, s0, s1 = (t.column(c).combine_chunks().to_numpy() for c in ("_b", "b1", "b2", "s0", "s1"))
            keep = np.zeros(t.num_rows, bool)
            homes = np.add.reduceat(home.astype(int), starts[:-1])
            for g in np.flatnonzero((homes > 0) & (np.diff(starts) > 1)).tolist():
                s, e = int(starts[g]), int(starts[g + 1])
                a, b, h = s0[s:e].view(np.uint64), s1[s:e].view(np.uint64), home[s:e]
                near = np.bitwise_count(a[:, None] ^ a).astype(np.int16) + np.bitwise_count(b[:, None] ^ b) <= bar
                near &= h[:, None] | h
                np.fill_diagonal(near, False)
                if b1[s] != b2[s]:
                    near &= block[s:e, None] != block[s:e]
                keep[s:e] = near.any(1)
            yield from t.select([*order, "_b", "home", "cid"]).filter(pa.array(keep)).combine_chunks().to_batches()

    members = cut(dealt.mapInArrow(likely, "cell long, b1 long, b2 long, _b long, home boolean, cid long"), "vector-members")
    ready = members.join(classes.select("cid", "n", "embedding").hint("merge"), "cid").repartition(*order).sortWithinPartitions(*order)
    ready = ready.select(*order, "_b", "home", "cid", "n", "embedding")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("near vectors")
        hashes: dict[int, LatticeHash] = {}
        for t, starts in sorted_groups(batches, order):
            home = t.column("home").combine_chunks().to_numpy(zero_copy_only=False)
            cell, block, b1, b2, cid, n = (t.column(c).combine_chunks().to_numpy() for c in ("cell", "_b", "b1", "b2", "cid", "n"))
            column = t.column("embedding").combine_chunks()
            size = np.diff(column.offsets.to_numpy())
            flat, at = column.flatten().to_numpy(), np.append(0, np.cumsum(size))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s < 2 or size[s:e].min() != size[s:e].max():  # vectors of two lengths share a cell by a clash of names
                    continue
                x = _unit(flat[at[s] : at[e]], e - s)
                i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
                i, j = s + i, s + j
                fit = home[i] | home[j]
                if b1[s] != b2[s]:
                    fit &= block[i] != block[j]
                found.append((i[fit], j[fit]))
            if not found:
                continue
            i, j = (np.concatenate(c) for c in zip(*found, strict=True))
            need = np.unique(np.concatenate([i, j]))
            keys = np.zeros((len(need), tables, 1 + blocks * probes), np.int64)
            for dim in np.unique(size[need]).tolist():
                if dim not in hashes:
                    hashes[dim] = LatticeHash(dim, tables, blocks, probes, scale)
                own = np.flatnonzero(size[need] == dim)
                at_home, probe = hashes[dim].keys(_unit(flat[at[need[own]][:, None] + np.arange(dim)], len(own)))
                keys[own] = np.concatenate([at_home[:, :, None], probe], 2)
            first = _first_meetings(keys, np.searchsorted(need, i), np.searchsorted(need, j), cell[i])
            i, j = i[first], j[first]
            if len(i):
                links = np.bincount(np.concatenate([i, j]), np.concatenate([n[j], n[i]]), len(cid)).astype(np.int64)
                own, root = np.flatnonzero(links), local_roots(len(cid), i, j)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cid[own], links[own], cid[root[own]])], names=["cid", "links", "root"])

    found = cut(ready.mapInArrow(linked, "cid long, links long, root long"), "vector-links")
    discard(met, members)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), "vectors")
    known = classes.select("cid", "name", "check", "rep", "n").join(links, "cid", "left").join(joined, F.col("cid") == F.col("id"), "left").withColumn("component", F.coalesce("component", "cid")).drop("id")
    heads = known.groupBy(F.col("component").alias("id")).agg(F.min("rep").alias("head"))
    known = known.join(heads, F.col("component") == F.col("id")).select(F.col("name").alias("_name"), F.col("check").alias("_check"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "head")
    out = rows.join(known, (rows["name"] == known["_name"]) & (rows["check"] == known["_check"]) & rows["embedding"].isNotNull(), "left")
    component = F.coalesce("head", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _first_meetings(keys: np.ndarray, i: np.ndarray, j: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Of pairs that meet in the given cells, those that met in no earlier table and count in this cell of theirs."""
    before, first = np.zeros(len(i), bool), np.zeros(len(i), bool)
    for u in range(keys.shape[1]):
        hi, hj = keys[i, u, 0], keys[j, u, 0]
        same = hi == hj
        i_at_j = (keys[i, u, 1:] == hj[:, None]).any(1)
        j_at_i = (keys[j, u, 1:] == hi[:, None]).any(1)
        chosen = np.where(same, hi, np.where(i_at_j & j_at_i, np.minimum(hi, hj), np.where(i_at_j, hj, hi)))
        met = same | i_at_j | j_at_i
        first |= met & ~before & (chosen == cell)
        before |= met
    return first


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))

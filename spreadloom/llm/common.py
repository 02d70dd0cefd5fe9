"""Helpers shared by the training-data operators: tables, scratch space, row numbering and byte hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that are no column of `df`, in whatever case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


_OWNER = [""]
_FORGET: dict[str, list] = {}


def worker_of(owner: str) -> None:
    """Called by a task: when a Python worker turns to another operator, the tables that the one before kept are dropped
    and freed memory goes back to the system, so that a worker's size is that of one operator."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for kept in _FORGET.values():
            for x in kept:
                x.clear()
        release()


def kept_by_worker(name: str, table: dict) -> dict:
    """Register a table that a worker keeps between tasks."""
    _FORGET.setdefault(name, []).append(table)
    return table


def release() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


ARROW_BYTES = 8 << 20


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: later stages restart from files, not from lineage.

    The shuffle files behind a written table are of no more use, so they are released with the write. Python is sent
    batches of ARROW_BYTES, so that a worker's size does not follow that of the texts in 10,000 rows.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}
    was = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_start(df: DataFrame, key: str, bucket: str, order: list[Column], amount: str, out: str) -> DataFrame:
    """Exclusive running sum of `amount` within `key`, in order of (`bucket`, *order).

    A key may hold a third of all rows, so no task sees a whole key: rows are summed within (key, bucket), the bucket
    sums (one small row each) get their own running sum, and the two are added.
    """
    sums = df.groupBy(key, bucket).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_k"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return rows.join(sums, rows[key].eqNullSafe(sums["_k"]) & (rows[bucket] == sums["_b"])).withColumn(out, (F.col("_base") + F.col("_inside")).cast("long")).drop("_k", "_b", "_base", "_inside")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    b = second * np.uint64(0xA0761D6478BD642F)
    return mix((first * np.uint64(0xD6E8FEB86659FD93)) ^ (b << np.uint64(32)) ^ (b >> np.uint64(32)))


PRIME = (1 << 61) - 1
_P, _L30, _L31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
_BASE = 0x1B3F5A9D7C24E681 % PRIME
_POWERS: dict[int, np.ndarray] = kept_by_worker("powers", {})
PIECE = 1 << 20


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    x -= _P * (x >= _P)
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, in halves of 31 bits."""
    a0, a1, b0, b1 = a & _L31, a >> _31, b & _L31, b >> _31
    mid = a1 * b0 + a0 * b1
    return _fold(a0 * b0 + ((a1 * b1) << np.uint64(1)) + (mid >> _30) + ((mid & _L30) << _31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**61 - 1, kept up to PIECE of them."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    if len(have) <= n:
        while len(have) <= n:
            have = np.concatenate([have, times(have, np.uint64(pow(base, len(have), PRIME)))])
        if n <= PIECE:
            _POWERS[base] = have
    return have[: n + 1]


class ByteHashes:
    """Hashes of any substrings of one buffer, each in constant time: running polynomial sums modulo the prime 2**61 - 1.

    Two given strings of n bytes are confused by n in 2**61 of all bases at most. Where a name decides that texts are
    equal, the caller compares bytes or a second name too.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        step = _powers(_BASE, min(n, PIECE))
        carry, scale = np.uint64(0), np.uint64(1)
        for s in range(0, n, PIECE):  # sums of 2**20 halves stay below 2**61
            part = data[s : s + PIECE].astype(np.uint64) + np.uint64(1)
            power = step[: len(part)]
            low, high = np.cumsum((power & _L31) * part), np.cumsum((power >> _31) * part)
            own = _fold(low + ((high & _L30) << _31) + (high >> _30))
            own = own if s == 0 else times(own, scale)
            self.sums[s + 1 : s + 1 + len(part)] = _fold(own + carry)
            carry = self.sums[s + len(part)]
            scale = times(scale, step[PIECE]) if len(part) == PIECE else scale
        self.undo = _powers(pow(_BASE, -1, PRIME), n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(times(_fold(self.sums[end] + (_P - self.sums[start])), self.undo[start]))


def components(edges: DataFrame, label: str, rounds: int = 40) -> DataFrame:
    """Smallest reachable id of every vertex of `edges` (a long, b long): columns id, component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Both steps re-point neighbours at a minimum and
    never join a vertex's neighbours with each other; each round is written out. Minima are aggregated before they are
    shuffled and written before they are joined: Spark splits a skewed side (a vertex with very many neighbours) only where
    both sides come straight from a shuffle.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, f"{label}-edges")
    last = None
    for i in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{label}-low{i}")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a <> b").distinct(), f"{label}-large{i}")
        low2 = cut(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-low2{i}")
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        was, e = e, cut(small.filter("a <> b").distinct(), f"{label}-star{i}")
        discard(was, low, large, low2)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(e.groupBy("b").agg(F.min("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def sorted_groups(batches, keys: list[str], most_rows: int = 1 << 14, most_bytes: int = 32 << 20):
    """Tables of whole groups, from Arrow batches that are sorted by `keys`; small groups come several to a table, until
    there are `most_rows` or `most_bytes` of them.

    Yields (table, starts): group g is rows starts[g]:starts[g + 1]. A group that runs over a batch's end waits for its rest.
    """
    import pyarrow as pa

    held: list = []

    def heads(t) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) < most_rows and sum(x.nbytes for x in held) < most_bytes:
            continue
        t = pa.Table.from_batches(held)
        s = heads(t)
        if len(s) > 1:
            yield t.slice(0, int(s[-1])).combine_chunks(), s
            held = t.slice(int(s[-1])).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(heads(t), t.num_rows)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index in each vertex's component, of the edges (i, j) on 0..n-1."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == was).all():
            break
    return root


MOST_BROADCAST, SALTS = 1 << 17, 256


def large_keys(rows: DataFrame, key: str, most: int, label: str) -> DataFrame:
    """Keys of more than `most` rows with their number, `_n`, written out: rows / `most` of them at most. Counts are added
    up before they are shuffled."""
    return cut(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most), label)


def meet_large(rows: DataFrame, large: DataFrame, key: str, id_col: str, how: str) -> DataFrame:
    """Join of `rows` with some of their large_keys(), in which no task gets the whole of a key: up to MOST_BROADCAST keys (counted
    first; 16 bytes each) are broadcast, more are merged by key and one of SALTS hashes of the id."""
    if large.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(large), key, how)
    salt = F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(SALTS))
    salted = large.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", salt).join(salted.hint("merge"), [key, "_salt"], how).drop("_salt")


def block_pairs(members: DataFrame, key: str, id_col: str, most: int) -> DataFrame:
    """`members` (key, id and other narrow columns, best a written table, which is read twice) dealt to (key, b1, b2): all
    pairs of a key's rows meet once, in tasks of at most about 2 * `most` rows; `_b` is a row's own block. A key of one row
    comes as a group of one.

    A key with more than `most` rows is cut into blocks by a hash of the id; each row goes to the pairs of its block with
    every block, so a large group is spread over many tasks and no task, and no row of output, grows with its square.
    Rows learn of a large key's number by meet_large(), so they are never dealt by the key alone.
    """
    large = large_keys(members, key, most, "large-keys")
    blocks = F.coalesce(F.expr(f"(_n + {most - 1}) div {most}"), F.lit(1).cast("long"))
    rows = meet_large(members, large, key, id_col, "left").withColumn("_nb", blocks).withColumn("_b", F.pmod(F.xxhash64(id_col), F.col("_nb")))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    return rows.withColumn("b1", F.least("_b", "_o")).withColumn("b2", F.greatest("_b", "_o")).drop("_n", "_nb", "_o")

"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.llm.common import cut, discard, table, worker_of

BITS = 64


def binary_codes(vectors: DataFrame, seed: int = 11) -> DataFrame:
    """vec_id, code: the signs of 64 random projections of a vector, as a long. Vectors that are null, hold null or
    non-finite components, or have a null id get no code and take no part; a zero vector's code is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("binary codes")
        axes: dict[int, np.ndarray] = {}
        for b in batches:
            ids, codes = [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                x = np.array(v.as_py() if v.is_valid else [None], float)
                if i is None or not len(x) or not np.isfinite(x).all():
                    continue
                if len(x) not in axes:
                    axes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((BITS, len(x)))
                ids.append(i)
                codes.append(np.packbits(axes[len(x)] @ x > 0).view(">i8")[0])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(codes, np.int64))], names=["vec_id", "code"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, code long")


SAMPLE = 1024
BATCH = 4096


def _segments(distinct: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment: as many as leave about four codes to a segment value, since a probe costs more
    than a comparison."""
    m = max(2, min(8, round(BITS / max(1.0, math.log2(max(distinct, 2)) - 2))))
    edges = [BITS * s // m for s in range(m + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:], strict=False)]


def _value(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))


def _flipped(df: DataFrame, width: int, radius: int) -> DataFrame:
    """`value` with every choice of `radius` of its bits flipped, from the highest bit down: a row for each."""
    df = df.withColumn("_low", F.lit(width))
    for _ in range(radius):
        df = df.withColumn("_low", F.explode(F.when(F.col("_low") > 0, F.sequence(F.lit(0), F.col("_low") - 1))))
        df = df.withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, _low)")))
    return df.drop("_low")


def _steps(segments: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """(segment, radius) in the order of search, one segment growing at a time; steps of few probes share a job."""
    every = [(s, r) for r in range(max(w for _, w in segments) + 1) for s, (_, w) in enumerate(segments) if r <= w]
    out: list[list[tuple[int, int]]] = []
    size = BATCH
    for s, r in every:
        n = math.comb(segments[s][1], r)
        if size + n > BATCH or len(out[-1]) == len(segments):
            out.append([])
            size = 0
        out[-1].append((s, r))
        size += n
    return out


def top_k_hamming(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest rows of `codes` (vec_id, code) of each row of `queries` (same columns) by Hamming distance, ties by
    vec_id, the query's own id left out: query_id, rank, vec_id, distance. Fewer rows only where `codes` has fewer.

    Incremental multi-index hashing (Norouzi, Punjani and Fleet 2012). Codes are indexed by each of m segments, with
    m about 64 / (log2 of the number of distinct codes - 2), so that a segment value holds a few. The search radii of the
    segments grow one at a time; a code that segments searched up to radii r_1..r_m have not met differs in r_s + 1 bits
    or more of each, so a query is finished once its k-th verified distance is at most the sum of r_s + 1, less 1.
    A bound on the k-th distance goes into the join of probes with the index, so that only codes that may still count come
    out of it: at first the distance within which SAMPLE codes hold k others, then the k-th distance found so far. That
    sample only saves work; every code is indexed and every query goes on until it is covered.

    Equal codes are one index entry of their k + 1 smallest ids, and equal query codes one search, so a very common code
    costs no more than another. Ids are fetched for the last k + 1 codes of a query alone. Probes and entries meet in
    merge joins, of which Spark splits skewed ones; nothing is broadcast. Each job is written out. Null codes or ids take
    no part; an id that repeats counts as one row per code; an empty table gives no rows.
    """
    spark = codes.sparkSession
    known = codes.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("code").cast("long").alias("code")).filter("vec_id is not null and code is not null")
    # Each task keeps a code's k + 1 smallest ids before they are shuffled, so a hot code is never gathered whole.
    smallest = Window.partitionBy("code").orderBy("vec_id")
    near = known.select("code", "vec_id").distinct().withColumn("nth", F.row_number().over(smallest)).filter(F.col("nth") <= k + 1)
    entries = cut(near.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("first", F.col("ids")[0]).withColumn("n", F.size("ids")), "codes")
    distinct = entries.count()
    segments = _segments(distinct)
    place = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _value(F.col("code"), low, width).alias("value")) for s, (low, width) in enumerate(segments)]))
    index = cut(entries.select("code", "first", "n", place.alias("at")).select("at.segment", "at.value", "code", "first", "n"), "code-index")
    stated = cut(queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("code").cast("long").alias("query_code")).filter("query_id is not null and query_code is not null").distinct(), "code-queries")
    # SAMPLE codes, 8 kB, travel as a constant.
    sample = [r.code for r in entries.orderBy(F.xxhash64("code")).limit(SAMPLE).select("code").collect()]
    far = F.lit(BITS)
    if len(sample) > k:
        away = F.expr("array_sort(transform(array(" + ",".join(f"{c}L" if c > -(1 << 63) else "(-9223372036854775807L - 1L)" for c in sample) + "), c -> bit_count(c ^ query_code)))")
        far = F.element_at(away, k + 1)
    asked = cut(stated.select("query_code").distinct().withColumn("bound", far.cast("int")), "code-open")
    best, done = None, []
    by_distance = Window.partitionBy("query_code").orderBy("distance", "first")
    reached = [-1] * len(segments)
    for job, batch in enumerate(_steps(segments)):
        probes = None
        for s, r in batch:
            own = _flipped(asked.select("query_code", "bound", F.lit(s).alias("segment"), _value(F.col("query_code"), *segments[s]).alias("value")), segments[s][1], r)
            probes = own if probes is None else probes.unionByName(own)
            reached[s] = r
        distance = F.bit_count(F.col("code").bitwiseXOR(F.col("query_code")))
        p, x = probes.alias("p"), index.hint("merge").alias("x")
        met = p.join(x, (F.col("p.segment") == F.col("x.segment")) & (F.col("p.value") == F.col("x.value")) & (distance <= F.col("p.bound"))).select("query_code", "code", distance.alias("distance"), "first", "n")
        if best is not None:
            met = met.unionByName(best)
        ranked = met.distinct().withColumn("nth", F.row_number().over(by_distance)).filter(F.col("nth") <= k + 1).drop("nth")
        ranked = cut(ranked, f"code-found{job}")
        # The k-th other id lies within the codes whose ids, own id included, number k + 1.
        before = F.coalesce(F.sum("n").over(by_distance.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        state = ranked.withColumn("_before", before).filter(F.col("_before") <= k).groupBy("query_code").agg(F.sum("n").alias("found"), F.count("*").alias("codes"), F.max("distance").alias("worst"))
        covered = sum(r + 1 for r in reached) - 1
        over = ((F.col("found") > k) & (F.col("worst") <= covered)) | (F.col("codes") >= distinct)
        state = cut(asked.join(state.hint("merge"), "query_code", "left").select("query_code", F.when(F.col("found") > k, F.least("bound", "worst")).otherwise(F.col("bound")).alias("bound"), F.coalesce(over, F.lit(covered >= BITS)).alias("over")), f"code-state{job}")
        done.append(ranked.join(state.filter("over").select("query_code").hint("merge"), "query_code", "left_semi"))
        discard(asked)
        asked, best = state.filter("not over").select("query_code", "bound"), ranked.join(state.filter("not over").select("query_code").hint("merge"), "query_code", "left_semi")
        asked = cut(asked, f"code-open{job}")
        if asked.isEmpty():
            break
    discard(index)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    rows = stated.join(out.hint("merge"), "query_code").join(entries.select("code", "ids").hint("merge"), "code").select("query_id", "query_code", "distance", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    last = Window.partitionBy("query_id", "query_code").orderBy("distance", "vec_id")
    return rows.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op9_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = cut(binary_codes(table(spark, sf_dir, "embeddings")), "binary-codes")
    return top_k_hamming(codes, codes.filter("vec_id % 100 = 0"))

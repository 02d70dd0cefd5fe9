"""Stretches of two legs' prices as arrays: a row per signal or position, not per bar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

SPAN = 64  # bars of a chunk


def price_chunks(prices: DataFrame) -> DataFrame:
    """symbol, chunk, bars: the logs of SPAN bars at a time, in order, as (bar_idx, l)."""
    bars = F.sort_array(F.collect_list(F.struct("bar_idx", F.log("close").alias("l"))))
    return prices.groupBy("symbol", F.expr(f"bar_idx div {SPAN}").alias("chunk")).agg(bars.alias("bars"))


def leg_arrays(x: DataFrame, chunks: DataFrame, key: str, first: Column, last: Column) -> DataFrame:
    """The rows of `x` (key, a, b, ...) with `bars`: (bar_idx, la, lb) of the bars from `first` to `last` that both legs have.
    A leg meets one row per chunk of its bars; rows without a common bar go."""
    need = x.select(key, F.explode(F.array(F.struct(F.lit("a").alias("leg"), F.col("a").alias("symbol")), F.struct(F.lit("b").alias("leg"), F.col("b").alias("symbol")))).alias("_x"), first.alias("_first"), last.alias("_last"))
    need = need.filter("_first <= _last").select(key, "_x.leg", "_x.symbol", "_first", "_last", F.explode(F.expr(f"sequence(_first div {SPAN}, _last div {SPAN})")).alias("chunk"))
    own = F.filter("bars", lambda b: b["bar_idx"].between(F.col("_first"), F.col("_last")))
    met = need.join(chunks, ["symbol", "chunk"]).select(key, "leg", F.struct("chunk", own.alias("bars")).alias("_p"))
    side = lambda n: F.flatten(F.sort_array(F.collect_list(F.when(F.col("leg") == n, F.col("_p"))))["bars"]).alias(f"_{n}")
    both = met.groupBy(key).agg(side("a"), side("b"))
    at = lambda n: F.col(f"_{n}")["bar_idx"]
    common = F.array_intersect(at("a"), at("b"))
    fit = lambda n: F.when(at("a") == at("b"), F.col(f"_{n}")).otherwise(F.filter(f"_{n}", lambda b: F.array_contains(common, b["bar_idx"])))
    zipped = F.zip_with("_a", "_b", lambda p, q: F.struct(p["bar_idx"].alias("bar_idx"), p["l"].alias("la"), q["l"].alias("lb")))
    bars = both.select(key, fit("a").alias("_a"), fit("b").alias("_b")).select(key, zipped.alias("bars")).filter(F.size("bars") > 0)
    return x.join(bars, key)


def moments(values: Column) -> Column:
    """n, mean and m2 (sum of squares about the mean) of an array of doubles, nulls left out (Welford)."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, v: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (v - s["mean"]) / n
        return F.when(v.isNull(), s).otherwise(F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (v - s["mean"]) * (v - mean)).alias("m2")))

    return F.aggregate(values, zero, step)


def steps(values: Column, n: Column | int) -> Column:
    """Differences of the last `n` entries of an array, the first of them without one."""
    own = F.slice(values, -F.least(F.size(values), F.lit(n) if isinstance(n, int) else n), F.size(values))
    return F.zip_with(F.slice(own, 2, F.size(own)), F.slice(own, 1, F.size(own) - 1), lambda x, y: x - y)


def rolling_z(x: DataFrame, window: Column | int, least: int = 10) -> DataFrame:
    """A row per bar, from bar `from_bar` on, of the rows of `x` (bars, hedge, from_bar and others, which stay but for bars):
    bar_idx and z of the spread la - hedge * lb over the trailing `window` of the row's bars; null while flat or short. Every
    frame has its own mean, so nothing cancels. A row comes alone, so memory is its bars times the window."""
    x = x.withColumn("_window", F.lit(window) if isinstance(window, int) else window.cast("int")).withColumns({c: F.col("bars")[c] for c in ("bar_idx", "la", "lb")}).drop("bars")
    others = [f for f in x.schema.fields if not isinstance(f.dataType, ArrayType) and f.name != "_window"]
    schema = StructType([*others]).add("bar_idx", LongType()).add("z", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                bar, la, lb = (b.column(c)[r].values.to_numpy(zero_copy_only=False).astype(float) for c in ("bar_idx", "la", "lb"))
                n, hedge, start = b.column("_window")[r].as_py(), b.column("hedge")[r].as_py(), b.column("from_bar")[r].as_py()
                s = la - (np.nan if hedge is None else hedge) * lb
                at = int(np.searchsorted(bar, start))
                if at == len(bar):
                    continue
                padded = np.concatenate([np.full(max(0, n - 1 - at), np.nan), s[max(0, at - n + 1) :]])
                frames = np.lib.stride_tricks.sliding_window_view(padded, n)
                there = np.isfinite(frames)
                count = there.sum(1)
                with np.errstate(all="ignore"):
                    mean = np.where(there, frames, 0).sum(1) / count
                    std = np.sqrt((np.where(there, frames - mean[:, None], 0) ** 2).sum(1) / (count - 1))
                    z = np.where((count >= least) & (std > 0), (s[at:] - mean) / std, np.nan)
                rows = pa.array(np.full(len(z), r))
                columns = [b.column(f.name).take(rows) for f in others]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bar[at:].astype(np.int64)), pa.array(z, from_pandas=True)], names=schema.names)

    return x.mapInArrow(run, schema)

"""Count-based sliding windows and the pair universe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_windows(series: DataFrame, window: int, step: int, n_bars: int | None = None, cap: int | None = None) -> DataFrame:
    """A row per bar and window that holds it; window k covers bars k * step to k * step + window - 1. Without `n_bars` the
    count comes from the series itself, in the same plan: one row that goes to all of it."""
    count = F.lit(n_bars)
    if n_bars is None:
        count = F.col("_bars")
        series = series.crossJoin(F.broadcast(series.agg((F.max("bar_idx") + 1).alias("_bars"))))
    last = F.floor((count - window) / step).cast("long")
    last = F.least(last, F.lit(cap - 1).cast("long")) if cap is not None else last
    low = F.greatest(F.lit(0), F.expr(f"cast(ceil((bar_idx - {window - 1}) / {step}) as bigint)"))
    high = F.least(F.expr(f"bar_idx div {step}"), last)
    return series.filter(low <= high).withColumn("window_id", F.explode(F.sequence(low.cast("long"), high.cast("long")))).drop("_bars")


def usable_windows(windowed: DataFrame, window: int) -> DataFrame:
    """(symbol, window_id) without a missing bar and not flat within 1e-8 + 1e-5 of the first value."""
    first = windowed.groupBy("symbol", "window_id").agg(F.count("logp").alias("n"), F.min_by("logp", "bar_idx").alias("x0"), F.min("logp").alias("lo"), F.max("logp").alias("hi"))
    spread = F.greatest(F.col("hi") - F.col("x0"), F.col("x0") - F.col("lo"))
    return first.filter((F.col("n") == window) & (spread > 1e-8 + 1e-5 * F.abs("x0"))).select("symbol", "window_id")


def candidates(series: DataFrame, benchmark: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    return series.select("symbol").distinct().filter(~F.col("symbol").isin(benchmark, *excluded))


def pairs(symbols: DataFrame) -> DataFrame:
    """All unordered pairs a < b: a dimension-sized theta join."""
    return symbols.select(F.col("symbol").alias("a")).join(symbols.select(F.col("symbol").alias("b")), F.col("a") < F.col("b"))


def limit_pairs(all_pairs: DataFrame, n: int) -> DataFrame:
    return all_pairs.orderBy("a", "b").limit(n)

"""The pair scan: bars to sized signals in one plan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.functions.numeric import price_from_log, ratio
from spreadloom.operators.coint import KEYS, coint_flag, engle_granger
from spreadloom.operators.panes import Limits, window_statistics
from spreadloom.operators.stats import pair_rows
from spreadloom.operators.windows import assign_windows, usable_windows
from spreadloom.params import ScanParams


def sized(stats: DataFrame, notional: float) -> DataFrame:
    """Volatility-parity dollars (weight 1 / vol of leg a, |hedge| / vol of leg b) and quantities at the last prices."""
    wa, wb = ratio(F.lit(1.0), F.col("vol_a")), ratio(F.abs("hedge_ratio"), F.col("vol_b"))
    wa, wb = F.coalesce(wa, F.lit(0.0)), F.coalesce(wb, F.lit(0.0))
    x = stats.withColumn("_wa", wa).withColumn("_wb", wb).withColumn("_w", F.col("_wa") + F.col("_wb"))
    for leg, n in (("a", 1), ("b", 2)):
        dollars = F.coalesce(ratio(F.col(f"_w{leg}") * notional, F.col("_w")), F.lit(0.0))
        x = x.withColumn(f"dollar{n}", dollars).withColumn(f"qty{n}", dollars / price_from_log(F.col(f"last_{leg}"), F.col(f"shift_{leg}")))
    return x.drop("_wa", "_wb", "_w")


def scan_windows(series: DataFrame, p: ScanParams, lengths: Iterable[int], vol_bars: Iterable[int], keys: tuple[str, ...] = (), **tasks: DataFrame) -> DataFrame:
    """Signals of every pair, window length (`lookback`), volatility length (`vol_bars`) and window that pass all filters, in
    one plan: a pair-bar is read once for all lengths. The filters come first; the cointegration test, the dear one, sees
    only the windows that they leave. `keys` (a, b) are kept if asked for; `tasks` goes to window_statistics()."""
    lengths = sorted(set(lengths))
    limits = Limits(p.z_entry, p.max_half_life, p.max_beta)
    s = window_statistics(series, p.benchmark, lengths, p.step, vol_bars, p.excluded, p.max_windows, limits=limits, **tasks)
    s = s.filter((F.col("half_life") > 0) & (F.col("half_life") <= p.max_half_life) & (F.abs("beta") < p.max_beta) & (F.abs("z") >= p.z_entry))
    if p.cointegration:
        found = []
        for n in lengths:
            windowed = assign_windows(series, n, p.step, cap=p.max_windows)
            legs = pair_rows(windowed, usable_windows(windowed, n), p.benchmark, p.excluded, only=s.filter(F.col("lookback") == n).select(*KEYS).distinct())
            found.append(engle_granger(legs, p.cointegration).drop("n").withColumn("lookback", F.lit(n)))
        s = s.join(reduce(DataFrame.unionByName, found), [*KEYS, "lookback"]).filter(coint_flag(p.max_half_life))
    else:
        s = s.withColumn("p", F.lit(None).cast("double"))
    s = sized(s, p.notional).withColumn("signal", F.when(F.col("z") >= p.z_entry, -1).otherwise(1))
    return s.select(*keys, "lookback", "vol_bars", F.concat_ws("-", "a", "b").alias("pair"), "window_id", "start_index", "end_index", "hedge_ratio", "half_life", F.col("p").alias("p_value"), "beta", "z", "signal", "qty1", "qty2", F.round("dollar1", 2).alias("dollar1"), F.round("dollar2", 2).alias("dollar2"))


def scan_pairs(series: DataFrame, p: ScanParams) -> DataFrame:
    """Signals under one window length and one volatility length."""
    return scan_windows(series, p, [p.window], [p.vol_bars]).drop("lookback", "vol_bars")

"""Many parameter sets in one plan: the sets are a table, crossed with the signals once what depends on none is known."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.operators import trades as T
from spreadloom.operators.paths import price_chunks
from spreadloom.params import PRESETS, BacktestParams, ScanParams
from spreadloom.plans.scan import scan_windows
from spreadloom.session import settle

NUMBERS = ["capital", "commission", "slippage", "risk_share", "notional_share", "z_gate", "z_entry", "z_exit", "z_stop", "hold_multiplier", "max_hold_days", "window", "vol_bars"]


def sweep(base: BacktestParams = BacktestParams(), **values: Iterable) -> dict[str, BacktestParams]:
    """Parameter sets of a grid, named by their values."""
    return {",".join(f"{k}={v}" for k, v in zip(values, point)): replace(base, **dict(zip(values, point))) for point in product(*values.values())}


def scan_lookbacks(series: DataFrame, p: ScanParams, windows: Iterable[int]) -> DataFrame:
    """The scan under several window lengths, with the length as `lookback`: one plan, in which windows of all lengths are
    assembled from the same panes."""
    return scan_windows(series, p, windows, [p.vol_bars]).drop("vol_bars")


def sweep_trades(signals: DataFrame, prices: DataFrame, sets: dict[str, BacktestParams]) -> DataFrame:
    """Trades of every parameter set, keyed by param_id and base_id (the signal's id).

    Signals are mapped and split once, and a position's z is computed once for all sets of one window; a set adds a row to a
    signal, and a condition to a bar. Trailing bars are fetched once, for the longest volatility, of which each set takes
    its own last ones; the gate's z is taken once for each window that a gated set has. The worst runs are taken anew only where
    a set changes dollars, holding time or volatility. Sets may differ in NUMBERS and `causal`.
    """
    spark = signals.sparkSession
    schema = "param_id string, p_causal boolean, " + ", ".join(f"p_{n} double" for n in NUMBERS)
    number = lambda v: None if v is None else float(v)
    table = spark.createDataFrame([(name, p.causal, *[number(getattr(p, n)) for n in NUMBERS]) for name, p in sets.items()], schema)
    p = BacktestParams(**{n: F.col(f"p_{n}") for n in NUMBERS}, causal=F.col("p_causal"))
    chunks = settle(price_chunks(prices))
    base = T.normalise_side(T.split_pair(T.map_signals(signals, prices.select("bar_idx", "ts").distinct()), prices))
    base = T.trailing_bars(base, chunks, max(s.vol_bars for s in sets.values()))
    gates = sorted({s.window for s in sets.values() if s.z_gate is not None})
    for n in gates:
        base = base.join(T.current_z(base, chunks, n).withColumnRenamed("z_now", f"_z{n}"), "signal_id", "left")
    base = settle(base)
    # One row per signal and set; the sets are a table of the caller's own making.
    x = base.crossJoin(F.broadcast(table)).withColumnRenamed("signal_id", "base_id").withColumn("signal_id", F.concat_ws("|", "param_id", "base_id"))
    z_now = F.coalesce(F.lit(None).cast("double"), *[F.when(F.col("p_window") == n, F.col(f"_z{n}")) for n in gates])
    x = x.withColumn("z_now", z_now).withColumns(T.volatility(F.col("bars"), F.col("p_vol_bars").cast("int"))).drop("bars", *[f"_z{n}" for n in gates])
    gated = F.col("p_z_gate").isNotNull()
    x = x.filter(F.col("p_z_entry").isNull() | (F.abs("entry_z") >= F.col("p_z_entry"))).filter(~gated | (F.abs("z_now") >= F.col("p_z_gate")))
    x = x.withColumn("side", F.when(gated, F.when(F.col("z_now") > 0, -1).otherwise(1)).otherwise(F.col("side"))).withColumn("entry_z", F.when(gated, F.col("z_now")).otherwise(F.col("entry_z")))
    live = T.allocate(x, p).filter("abs(alloc_a) + abs(alloc_b) > 0").withColumn("run_id", F.concat_ws("|", "base_id", "alloc_a", "alloc_b", "p_hold_multiplier", "p_vol_bars"))
    runs = live.select(F.col("run_id").alias("signal_id"), "a", "b", "signal_bar", "alloc_a", "alloc_b", "half_life", "p_hold_multiplier", "p_vol_bars").distinct()
    worst = T.mae95(runs, chunks, p).withColumnRenamed("signal_id", "run_id")
    scale = F.when(F.col("mae") > p.capital * p.risk_share, p.capital * p.risk_share / F.col("mae")).otherwise(1.0)
    scaled = live.join(worst, "run_id", "left").withColumn("alloc_a", F.col("alloc_a") * scale).withColumn("alloc_b", F.col("alloc_b") * scale)
    fills = settle(T.entry_fills(scaled, prices, p).withColumn("path_id", F.concat_ws("|", "base_id", "p_window")))
    return T.trades(fills, T.exit_fills(fills, T.first_exit(fills, chunks, p, "path_id"), prices, p))


def compare(signals: DataFrame, prices: DataFrame, sets: dict[str, BacktestParams] = PRESETS) -> DataFrame:
    """Trade counts, win rate and profit of each parameter set, keyed by param_id; a set without trades has a row too."""
    t = sweep_trades(signals, prices, sets).groupBy("param_id").agg(F.count("*").alias("n_trades"), F.count("pnl_net").alias("n_closed"), F.avg((F.col("pnl_net") > 0).cast("double")).alias("win_rate"), F.sum("pnl_net").alias("net"))
    names = signals.sparkSession.createDataFrame([(n,) for n in sets], "param_id string")
    return names.join(t, "param_id", "left").fillna(0, ["n_trades", "n_closed"]).select("n_trades", "n_closed", "win_rate", "net", "param_id")

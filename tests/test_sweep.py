"""The sweep against a backtest for each set, exact quantiles, readers of malformed values, and the report."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spreadloom import catalog
from spreadloom.operators import profile, trades
from spreadloom.params import BacktestParams
from spreadloom.plans.backtest import backtest
from spreadloom.plans.sweep import compare, sweep_trades
from spreadloom.sources import io

DATA = "/root/testdata/sf0.001"


def test_sweep_equals_a_backtest_for_each_set(spark):
    signals, prices = catalog._panel(spark, DATA)
    sets = {"plain": catalog.TRADING, "gated": catalog.GATED, "short": BacktestParams(max_hold_days=0.2, z_exit=0.1, z_stop=9.0, causal=True, hold_multiplier=1.0), "strict": BacktestParams(z_entry=1.6, capital=5e5)}
    got = sweep_trades(signals, prices, sets).select("param_id", "base_id", "entry_idx", "exit_idx", "exit_reason", "pnl_net").toPandas()
    for name, p in sets.items():
        want = {r.signal_id: r for r in backtest(signals, prices, p).trades.collect()}
        own = {r.base_id: r for r in got[got["param_id"] == name].itertuples()}
        assert own.keys() == want.keys() and own
        for k, r in own.items():
            assert (r.entry_idx, r.exit_reason or None) == (want[k].entry_idx, want[k].exit_reason)
            assert want[k].pnl_net is None if np.isnan(r.pnl_net) else abs(r.pnl_net - want[k].pnl_net) < 1e-6
    assert "time_exit" in set(got["exit_reason"])
    none = compare(signals, prices, {"plain": catalog.TRADING, "never": BacktestParams(z_entry=99.0)}).collect()
    assert {r.param_id: r.n_trades > 0 for r in none} == {"plain": True, "never": False}


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_exact_quantiles(spark, q):
    rng = random.Random(4)
    rows = [(g, v) for g, n in (("a", 1), ("b", 2), ("c", 501)) for v in [rng.choice([-1, 1]) * rng.random() ** 9 * 1e4 for _ in range(n)]] + [("c", 0.0)] * 40 + [("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.x for r in profile.exact_quantile(df, "v", q, "x", "g").collect()}
    for g in "abc":
        assert abs(got[g] - np.quantile([v for k, v in rows if k == g and v is not None], q)) < 1e-9
    assert set(got) == set("abc")
    assert abs(profile.exact_quantile(df, "v", q, "x").first().x - np.quantile([v for _, v in rows if v is not None], q)) < 1e-9
    assert profile.exact_quantile(df.filter("false"), "v", q, "x").first().x is None


def test_malformed_values_are_null(spark, tmp_path):
    write = lambda name, rows, schema: io.write_table(spark.createDataFrame(rows, schema), f"{tmp_path}/{name}", "csv")
    write("bars", [("2024-01-01 00:00:00", "A", "1.5"), ("soon", "A", "n/a")], "Date string, Symbol string, Close string")
    assert sorted((r.ts is None, r.close) for r in io.read_bars(spark, f"{tmp_path}/bars").fillna({"close": -1.0}).collect()) == [(False, 1.5), (True, -1.0)]
    write("signals", [("A-B", "2024-01-01 00:00:00", "n/a", "3"), ("A-B", "never", "2.5", "x")], "pair string, end_date string, z string, end_index string")
    signals = io.read_signals(spark, f"{tmp_path}/signals")
    assert dict(signals.dtypes)["z"] == "double" and sorted((r.z is None, r.end_index is None, r.signal_time is None) for r in signals.collect()) == [(False, True, True), (True, False, False)]
    assert trades.normalise_side(spark.createDataFrame([("n/a",)], "z string")).first().entry_z is None
    write("trades", [("A-B", "x", "2"), ("A-B", "1.25", "")], "pair string, pnl_net string, hold_hours string")
    assert sorted((r.pnl_net or 0, r.hold_hours or 0) for r in io.read_trades(spark, f"{tmp_path}/trades").collect()) == [(0, 2), (1.25, 0)]


def test_report(spark, tmp_path):
    b = catalog._backtest(spark, DATA)
    io.write_report(b.report(), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r/metrics").count() == 8
    assert spark.read.parquet(f"{tmp_path}/r/trades").count() == b.trades.count()
    assert spark.read.parquet(f"{tmp_path}/r/equity").count() == spark.read.parquet(f"{tmp_path}/r/drawdown").count() == b.dates.count()
    assert spark.read.parquet(f"{tmp_path}/r/ledger").filter("type = 'exit'").count() == b.trades.filter("exit_idx is not null").count()

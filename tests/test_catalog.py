"""Every registered query of the engine against its SQL twin, and micro tables for the semantics that differ by system."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from spreadloom import catalog
from spreadloom.operators import bars, coint, profile, trades, windows
from spreadloom.sources import io

DATA = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[str]:
    clean = lambda v: None if pd.isna(v) else float(v) + 0.0 if isinstance(v, float) else v
    return sorted(str([clean(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "lineitem", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(db.sql(catalog.SQL[name]).df())


def test_log_shift_and_gaps(spark):
    b = spark.createDataFrame([("A", 1, -2.0), ("A", 2, 3.0), ("B", 2, 1.0)], "symbol string, t int, close double").selectExpr("symbol", "timestamp_seconds(t) ts", "close open", "close")
    got = {(r.symbol, r.bar_idx): r.close for r in bars.dense_grid(b).collect()}
    assert got == {("A", 0): -2.0, ("A", 1): 3.0, ("B", 0): 1.0, ("B", 1): 1.0}
    logs = {(r.symbol, r.close): r.logp for r in bars.log_prices(b).collect()}
    assert math.isclose(logs["A", -2.0], math.log(1e-6), rel_tol=1e-6) and logs["B", 1.0] == 0


def test_windows(spark):
    s = spark.range(23).selectExpr("'A' symbol", "id bar_idx", "cast(id as double) logp")
    got = windows.assign_windows(s, 10, 5).groupBy("window_id").count().collect()
    assert {r["window_id"]: r["count"] for r in got} == {0: 10, 1: 10, 2: 10}
    assert windows.assign_windows(s, 30, 5).count() == 0


def test_empty_and_open_trades(spark):
    schema = "pnl_net double, pnl_gross double, commission_total double, exit_reason string, hold_hours double"
    empty = spark.createDataFrame([], schema)
    assert profile.trade_summary(empty).first().n_trades == 0
    t = spark.createDataFrame([(None, None, None, None, None), (1.0, 0.0, 1.0, "x", 2.0)], schema)
    assert profile.trade_summary(t).first().win_pct == 50.0
    assert profile.commission_profile(t).first().ratio_over_one_pct == 50.0
    assert profile.by_exit_reason(t).count() == 1
    assert profile.trade_profile(empty).count() == 0
    got = {(r.section, r.exit_reason, r.metric): r.value for r in profile.trade_profile(t).collect()}
    assert len(got) == 17 and got["all", "", "n_trades"] == 2 and got["all", "", "median_net"] == 1 and got["commission", "", "ratio_over_one_pct"] == 50
    assert got["commission", "", "median_ratio"] is None and got["exit_reason", "x", "mean_hold"] == 2 and got["all", "", "profit_factor"] is None


def test_sources(spark, tmp_path):
    path = str(tmp_path / "bars")
    io.write_table(spark.createDataFrame([("2024-01-01 00:00:00", "A", 1.5)], "Date string, Symbol string, Close double"), path, "csv")
    assert io.read_bars(spark, path).first().close == 1.5
    with pytest.raises(ValueError):
        io.read_signals(spark, path)
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "a string, b string")
    assert [tuple(r) for r in io.pending_pairs(pairs, pairs.limit(1)).collect()] == [("A", "C")]


def test_sides(spark):
    values = ["1", "1.0", "+1", "long", "BUY", " short ", "-1.0", "0.5", "0", "abc", None]
    x = spark.createDataFrame([(v, 2.0) for v in values], "signal string, z double")
    assert [r.side for r in trades.normalise_side(x).collect()] == [1, 1, 1, 1, 1, -1, -1, 1, -1, -1, -1]


def test_signals_to_bars(spark):
    dates = spark.range(3).selectExpr("id bar_idx", "timestamp_seconds(86000 + id * 3600) ts")
    at = {"before": 0, "exact": 86000 + 3600, "between": 86000 + 5000, "last": 86000 + 7200, "after": 10**6}
    s = spark.createDataFrame(list(at.items()), "signal_id string, t long").selectExpr("signal_id", "timestamp_seconds(t) signal_time")
    got = {r.signal_id: r.signal_bar for r in trades.map_signals(s, dates).collect()}
    assert got == {"before": 0, "exact": 1, "between": 1}


def test_pairs_of_known_symbols(spark):
    s = spark.createDataFrame([("A-B",), ("A-B-C",), ("A",), ("A-Z",), (None,)], "pair string")
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    assert [(r.a, r.b) for r in trades.split_pair(s, symbols).collect()] == [("A", "B")]


def test_cointegration_rates():
    rng = np.random.default_rng(7)

    def statistics(a, b):
        x = np.stack([np.ones_like(b), b], axis=2)
        fit = np.linalg.solve(np.einsum("bij,bik->bjk", x, x), np.einsum("bij,bi->bj", x, a)[..., None])
        return coint._aic_batch(a - np.einsum("bij,bj->bi", x, fit[..., 0]))

    walk = rng.normal(size=(1000, 2, 200)).cumsum(2)
    noise = np.zeros((1000, 200))
    for k in range(1, 200):
        noise[:, k] = 0.5 * noise[:, k - 1] + rng.normal(size=1000)
    limit = -3.33613 - 6.1101 / 199 - 6.823 / 199**2
    assert 0.04 <= (statistics(walk[:, 0], walk[:, 1]) < limit).mean() <= 0.09
    assert (statistics(2 * walk[:, 1] + noise, walk[:, 1]) < limit).mean() >= 0.95

"""Pane statistics against a plain loop over windows: several blocks, lengths, volatility lengths, gaps, flat windows."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest

from spreadloom.operators import panes, windows
from spreadloom.params import ScanParams
from spreadloom.plans.scan import scan_pairs, scan_windows

SERIES = "symbol string, bar_idx long, logp double, shift double"


def series(spark, n_symbols=9, n_bars=230, seed=5):
    rng = np.random.default_rng(seed)
    logs = 3 + 0.01 * rng.standard_normal((n_symbols, n_bars)).cumsum(1) + 0.01 * rng.standard_normal(n_bars).cumsum()
    logs[1, 60:64] = np.nan
    logs[2, 100:190] = logs[2, 100]
    logs[3] = 0.7 * logs[4] + 0.001 * rng.standard_normal(n_bars)
    rows = [(f"S{i}", b, float(v), 0.5 * i) for i, r in enumerate(logs) for b, v in enumerate(r) if np.isfinite(v)]
    rows += [("S5", 229, None, 0.0), ("S0", None, 1.0, 0.0)]
    return logs, spark.createDataFrame(rows, SERIES).repartition(3)


def plain(logs, lengths, step, vols, mark, skip=(), cap=None):
    out = {}
    for n in lengths:
        for k, s in enumerate(range(0, logs.shape[1] - n + 1, step)):
            if cap is not None and k >= cap:
                break
            w = logs[:, s : s + n]
            fine = [bool(np.isfinite(x).all() and np.abs(x - x[0]).max() > 1e-8 + 1e-5 * abs(x[0])) for x in w]
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    if mark in (i, j) or {i, j} & set(skip) or not (fine[i] and fine[j] and fine[mark]):
                        continue
                    a, b, c = w[i], w[j], w[mark]
                    h = np.cov(a, b)[0, 1] / np.var(b, ddof=1)
                    x = a - h * b
                    phi = 1 + np.polyfit(x[:-1], np.diff(x), 1)[0]
                    beta = np.cov(np.diff(a) - h * np.diff(b), np.diff(c))[0, 1] / np.var(np.diff(c))
                    for v in vols:
                        near = [np.diff(y[max(0, n - v) :]).std() for y in (a, b)]
                        out[f"S{i}", f"S{j}", n, v, k] = (s, s + n - 1, n, h, phi, beta, x[-1], x.mean(), x.std(ddof=1), *near, a[-1], b[-1], 0.5 * i, 0.5 * j)
    return out


@pytest.mark.parametrize("per_block", [2, 64])
def test_statistics_equal_a_plain_loop(spark, per_block):
    logs, df = series(spark)
    lengths, vols = (30, 70, 120), (10, 60)
    want = plain(logs, lengths, 10, vols, 0, (8,))
    got = panes.window_statistics(df, "S0", lengths, 10, vols, ("S8",), per_block=per_block).collect()
    assert len(got) == len(want) == len({(r.a, r.b, r.lookback, r.vol_bars, r.window_id) for r in got})
    for r in got:
        mine = want[r.a, r.b, r.lookback, r.vol_bars, r.window_id]
        assert np.allclose([r[c.split()[0]] for c in panes.STATISTICS.split(", ")], mine, rtol=1e-7, atol=1e-11)
        if r.phi is not None and 0 < r.phi < 1:
            assert abs(r.half_life + math.log(2) / math.log(r.phi)) < 0.006


def test_windows_are_capped_and_match_the_usable_ones(spark):
    logs, df = series(spark)
    got = {(r.a, r.b, r.window_id) for r in panes.window_statistics(df, "S0", [40], 20, cap=3).collect()}
    assert got == {(a, b, k) for a, b, _, _, k in plain(logs, (40,), 20, (60,), 0, cap=3)}
    usable = {(r.symbol, r.window_id) for r in windows.usable_windows(windows.assign_windows(df.filter("bar_idx is not null"), 40, 20, n_bars=230, cap=3), 40).collect()}
    assert {(s, k) for a, b, k in got for s in (a, b)} <= usable


def test_no_benchmark_and_empty_tables_give_no_rows(spark):
    _, df = series(spark)
    assert panes.window_statistics(df, "none", [40], 20).count() == 0
    assert panes.window_statistics(df.limit(0), "S0", [40], 20).count() == 0
    assert panes.window_statistics(df.filter("bar_idx < 30"), "S0", [40], 20).count() == 0


def test_collinear_and_drifting_legs(spark):
    """Far from zero and with a drift many times a window's spread, centred sketches keep their digits."""
    rng = np.random.default_rng(1)
    t = np.arange(400)
    logs = np.stack([0.01 * rng.standard_normal(400).cumsum() + 50, 40 + 0.05 * t + 1e-4 * rng.standard_normal(400).cumsum(), -30 + 0.02 * t + 1e-4 * rng.standard_normal(400).cumsum()])
    df = spark.createDataFrame([(f"S{i}", b, float(v), 0.5 * i) for i, r in enumerate(logs) for b, v in enumerate(r)], SERIES)
    want = plain(logs, (100,), 25, (60,), 0)
    for r in panes.window_statistics(df, "S0", [100], 25).collect():
        mine = dict(zip([c.split()[0] for c in panes.STATISTICS.split(", ")], want[r.a, r.b, 100, 60, r.window_id], strict=True))
        for c in ("hedge_ratio", "phi", "beta", "s_std", "vol_a"):
            assert abs(r[c] - mine[c]) < 1e-5 * max(1, abs(mine[c])), c
    rows = [(s, b, float(v), 0.0) for s, k in (("S0", 1.0), ("S1", 2.0), ("S2", 1.0)) for b, v in enumerate(k * logs[0])]
    r = panes.window_statistics(spark.createDataFrame(rows, SERIES), "S0", [100], 25).first()
    assert abs(r.hedge_ratio - 2) < 1e-9 and r.s_std < 1e-6


def test_no_frame_over_pair_bars_and_one_reading(spark):
    _, df = series(spark)
    plan = panes.window_statistics(df, "S0", [40, 60, 80], 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("FlatMapGroupsInArrow") == 1


def test_lengths_and_volatilities_of_a_scan_are_those_of_single_scans(spark):
    _, df = series(spark)
    p = ScanParams(step=20, z_entry=0.5, max_beta=5.0, benchmark="S0", cointegration=None)
    got = sorted(map(tuple, scan_windows(df, p, (40, 80), (20, 60)).collect()))
    want = sorted((n, v, *r) for n in (40, 80) for v in (20, 60) for r in map(tuple, scan_pairs(df, replace(p, window=n, vol_bars=v)).collect()))
    assert len(got) == len(want) > 20
    for x, y in zip(got, want, strict=True):
        assert all(abs(a - b) < 1e-6 * max(1, abs(b)) if isinstance(a, float) else a == b for a, b in zip(x, y, strict=True))

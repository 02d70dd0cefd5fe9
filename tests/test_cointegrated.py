"""The scan with its cointegration test, against brute force; the lag-0 queries' SQL twins run in test_catalog.py."""

from __future__ import annotations

import numpy as np

import __spark_entry__
from spreadloom import catalog

DATA = "/root/testdata/sf0.001"


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Sum of squared residuals, and t of the first coefficient."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    ssr = float(((y - x @ beta) ** 2).sum())
    return ssr, float(beta[0] / np.sqrt(ssr / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0]))


def aic_t(a: np.ndarray, b: np.ndarray) -> float:
    line = np.stack([np.ones_like(b), b], 1)
    u = a - line @ np.linalg.lstsq(line, a, rcond=None)[0]
    du, top = np.diff(u), int(np.ceil(12 * (len(u) / 100) ** 0.25))
    design = lambda p, start: (np.stack([u[start:-1], *(du[start - k : len(du) - k] for k in range(1, p + 1))], 1), du[start:])
    m = len(du) - top
    best = min(range(top + 1), key=lambda p: m * np.log(fit(*design(p, top))[0] / m) + 2 * (p + 1))
    return fit(*design(best, best))[1]


def test_the_scan_emits_cointegrated_pairs_only(spark):
    loose = {(r.pair, r.window_id) for r in catalog.QUERIES["pair_scan"](spark, DATA).collect()}
    want = set()
    for (a, b, w), g in catalog._pair_rows(spark, DATA).toPandas().sort_values("bar_idx").groupby(["a", "b", "window_id"]):
        t = len(g) - 1
        if (f"{a}-{b}", w) in loose and aic_t(g["la"].to_numpy(), g["lb"].to_numpy()) < -3.33613 - 6.1101 / t - 6.823 / t**2:
            want.add((f"{a}-{b}", w))
    got = {(r.pair, r.window_id) for r in catalog.QUERIES["pair_scan_aic"](spark, DATA).collect()}
    assert got == want and 0 < len(got) < len(loose)
    assert {(r.pair, r.window_id) for r in __spark_entry__.entry(spark).collect()} == want
    tested = {f"{r.pair}#{r.window_id}" for r in catalog.QUERIES["cointegrated_pair_scan"](spark, DATA).collect()}
    traded = {r.signal_id for r in catalog.QUERIES["cointegrated_trades"](spark, DATA).collect()}
    print(len(loose), len(got), len(tested), len(traded))
    assert traded and traded <= tested and len(tested) < len(loose)

"""A scan in steps, cut off, resumed and extended, against a scan in one go."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter

from spreadloom.operators import coint
from spreadloom.params import ScanParams
from spreadloom.plans.resume import resume_scan, scan_signals
from spreadloom.plans.scan import scan_pairs

P = ScanParams(window=40, step=20, z_entry=0.5, max_beta=5.0, benchmark="S0", excluded=("S7",), cointegration=None)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    logs = 3 + 0.01 * rng.standard_normal((9, 900)).cumsum(1) + 0.01 * rng.standard_normal(900).cumsum()
    rows = [(f"S{i}", b, float(v), 0.0) for i, r in enumerate(logs) for b, v in enumerate(r) if i != 5 or not 300 <= b < 380]
    return spark.createDataFrame(rows, "symbol string, bar_idx long, logp double, shift double").repartition(3)


def signals(df):
    out = sorted((r.pair, r.window_id, r.signal, round(r.z, 6), round(r.hedge_ratio, 6), round(r.dollar1, 1)) for r in df.collect())
    assert len(out) == len({r[:2] for r in out})
    return out


def test_cut_off_resumed_and_extended(spark, panel, tmp_path, monkeypatch):
    """Some symbols and bars first; a run that dies between writing and noting; then more bars, then more symbols."""
    path, go = str(tmp_path / "scan"), {"per_block": 2, "runs_at_once": 1}
    some = panel.filter("bar_idx < 500 and symbol not in ('S3', 'S8')")
    assert resume_scan(some, P, path, stop_after=1, **go) == 1
    partly = signals(scan_signals(spark, path))
    parquet = DataFrameWriter.parquet

    def dies(self, target, *args, **more):
        if target.endswith("finished"):
            raise RuntimeError("lost")
        return parquet(self, target, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(RuntimeError, match="lost"):
        resume_scan(some, P, path, **go)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    assert resume_scan(some, P, path, **go) >= 1
    assert 0 < len(partly) < len(want := signals(scan_pairs(some, P)))
    assert signals(scan_signals(spark, path)) == want
    assert resume_scan(some, P, path, **go) == 0
    more = panel.filter("symbol not in ('S3', 'S8')")
    resume_scan(more, P, path, **go)
    assert signals(scan_signals(spark, path)) == signals(scan_pairs(more, P))
    resume_scan(panel, P, path, **go)
    assert signals(scan_signals(spark, path)) == signals(scan_pairs(panel, P))
    with pytest.raises(ValueError, match="holds a scan"):
        resume_scan(panel, replace(P, step=10), path, **go)


def test_empty_panel_and_capped_windows(spark, panel, tmp_path):
    path = str(tmp_path / "scan")
    assert resume_scan(panel.limit(0), P, path) == 0 and scan_signals(spark, path).count() == 0
    capped, path = replace(P, max_windows=3, cointegration="lag0"), str(tmp_path / "capped")
    assert resume_scan(panel, capped, path) == 1
    assert signals(scan_signals(spark, path)) == signals(scan_pairs(panel, capped))


def test_sliced_statistics_are_those_of_one_batch():
    u = np.random.default_rng(2).standard_normal((300, 120)).cumsum(1)
    some = 37
    parts = np.concatenate([coint._aic_batch(u[s : s + some]) for s in range(0, 300, some)])
    assert np.allclose(parts, coint._aic_batch(u))
    assert coint._at_once(200) * 2 * 200 <= coint.CELLS and coint._at_once(10**7) == 1


def test_factored_fits_are_those_of_the_design():
    rng = np.random.default_rng(7)
    for n in (10, 31, 200):
        walk = rng.standard_normal((200, n)).cumsum(1)
        sized = rng.standard_normal((60, n)) * 10.0 ** rng.uniform(-8, 6, (60, 1))
        odd = np.stack([np.sin(np.arange(n) * 0.3), np.tile([1.0, -1], n)[:n], np.arange(n) * 1.0, np.r_[np.zeros(n - 1), 1.0]])
        u = np.concatenate([walk, sized, odd])
        with np.errstate(all="ignore"):
            assert np.allclose(coint._aic_batch(u), coint._aic_by_design(u), rtol=1e-6, equal_nan=True)
    assert (coint._aic_batch(np.zeros((3, 50))) == -1e9).all()

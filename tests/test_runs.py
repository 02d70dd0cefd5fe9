"""Panels as runs of bars: the rows of the dense grid, and what a scan of many symbols shuffles."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from spreadloom.operators import bars as B
from spreadloom.operators import panes

START = datetime(2020, 1, 1)


def panel(spark, n_bars=9000):
    """A symbol with all bars, one with two gaps over whole runs, one that starts late and goes below zero, one without closes."""
    rng = np.random.default_rng(4)
    held = {"A": range(n_bars), "B": [*range(50, 90), *range(8300, 8420), 8999], "C": range(4090, 4400), "D": range(3)}
    rows = [(s, START + timedelta(hours=k), None if s == "D" or k % 97 == 13 and s != "A" else float(np.round(5 * rng.standard_normal() + (0 if s == "C" else 40), 3))) for s, at in held.items() for k in at]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double").repartition(5)


def test_runs_hold_the_dense_grid(spark):
    bars = panel(spark)
    want = {(r.symbol, r.bar_idx): (r.shift, r.logp) for r in B.log_prices(B.dense_grid(bars)).collect() if r.symbol != "D"}
    got = {}
    for r in B.dense_runs(bars).collect():
        for k, v in enumerate(r.logps):
            assert (r.symbol, r.first_bar + k) not in got
            got[r.symbol, r.first_bar + k] = (r.shift, v)
    assert got == want and len(got) == 27000 and any(shift > 0 for shift, _ in got.values())


def test_statistics_of_runs_are_those_of_rows(spark):
    bars = panel(spark).union(panel(spark).filter("symbol = 'A'").withColumn("symbol", F.lit("E")).withColumn("close", F.col("close") + F.hour("ts")))
    args = ("A", [100, 300], 50)
    rows = {(r.a, r.b, r.lookback, r.window_id): r for r in panes.window_statistics(B.log_prices(B.dense_grid(bars)), *args, cap=170).collect()}
    runs = {(r.a, r.b, r.lookback, r.window_id): r for r in panes.window_statistics(B.dense_runs(bars), *args, cap=170, per_block=1).collect()}
    assert rows.keys() == runs.keys() and len(rows) > 30
    for k, r in rows.items():
        assert all(x == y or isinstance(x, float) and (math.isnan(x) and math.isnan(y) or abs(x - y) < 1e-9 * max(1, abs(x))) for x, y in zip(r, runs[k], strict=True))


def test_bars_travel_to_ten_tasks_at_most(spark):
    """150 symbols in blocks of 2: their bars travelled to 75 tasks each."""
    rng = np.random.default_rng(2)
    rows = [(f"S{s:03d}", b, float(v), 0.0) for s in range(150) for b, v in enumerate(rng.standard_normal(60).cumsum())]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, logp double, shift double")
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None))}
    before = stages()
    assert panes.window_statistics(df, "S000", [60], 60, per_block=2).count() == 149 * 148 // 2
    assert max(n for k, n in stages().items() if k not in before) <= 150 * 10 + 55


def test_equal_legs_have_no_spread(spark):
    rng = np.random.default_rng(9)
    walks = rng.standard_normal((40, 100)).cumsum(1)
    rows = [(f"S{s:02d}{c}", b, float(v), 0.0) for s in range(40) for c in "ab" for b, v in enumerate(walks[s])]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, logp double, shift double")
    for r in panes.window_statistics(df, "S00a", [100], 25).filter("left(a, 3) = left(b, 3)").collect():
        assert r.hedge_ratio == 1 and r.s_std == 0 and r.z is None

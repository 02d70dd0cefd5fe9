"""Running values by chunks against windows over all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spreadloom.operators import bars, chunks, equity, profile, stats
from spreadloom.operators.chunks import Carry



def kinds():
    v, all_, ahead = F.col("v"), lambda w: w.rowsBetween(Window.unboundedPreceding, 0), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    return {
        "sum": (Carry("sum", v), lambda w: F.sum(v).over(all_(w))),
        "sum_before": (Carry("sum", v, True), lambda w: F.sum(v).over(ahead(w))),
        "max": (Carry("max", v), lambda w: F.max(v).over(all_(w))),
        "count": (Carry("count", v), lambda w: F.count(v).over(all_(w))),
        "count_before": (Carry("count", v, True), lambda w: F.count(v).over(ahead(w))),
        "last": (Carry("last", v), lambda w: F.last(v, True).over(all_(w))),
        "last_before": (Carry("last", v, True), lambda w: F.last(v, True).over(ahead(w))),
        "lag": (Carry("lag", v), lambda w: F.lag(v).over(w)),
    }


def table(spark, n=3000):
    """Three keys, one of them with a third of its places missing, one with nulls for its first 400 rows."""
    x = spark.range(n).selectExpr("id bar_idx", "timestamp_seconds(id * 86400) ts", "explode(array('A', 'B', 'C')) k", "rand(3) r")
    x = x.filter("k <> 'B' or pmod(hash(bar_idx), 3) > 0").selectExpr("k", "bar_idx", "ts", "case when r > 0.3 and (k <> 'C' or bar_idx >= 400) then cast(floor(r * 1000) - 500 as long) end v")
    return x.repartition(5)


@pytest.mark.parametrize("order", ["bar_idx", "ts"])
@pytest.mark.parametrize("by", [(), ("k",)])
def test_running_values_equal_windows_over_all_rows(spark, order, by):
    x = table(spark) if by else table(spark).filter("k = 'B'")
    chunk = chunks.bar_chunk("bar_idx", 64) if order == "bar_idx" else chunks.time_chunk("ts", 90)
    got = chunks.carried(x, order, chunk, {n: c for n, (c, _) in kinds().items()}, by)
    want = x.select("*", *[f(Window.partitionBy(*by).orderBy(order)).alias(n) for n, (_, f) in kinds().items()])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == x.count()


def test_empty_tables_and_null_places(spark):
    x = table(spark, 10)
    carries = {n: c for n, (c, _) in kinds().items()}
    assert chunks.carried(x.limit(0), "bar_idx", chunks.bar_chunk(), carries).count() == 0
    y = spark.createDataFrame([(None, 5), (1, 7), (-3, 1)], "bar_idx long, v long")
    got = {r.bar_idx: (r.sum, r.lag) for r in chunks.carried(y, "bar_idx", chunks.bar_chunk("bar_idx", 2), carries).collect()}
    assert got == {None: (5, None), -3: (6, 5), 1: (13, 1)}


@pytest.mark.parametrize("dense", [False, True])
def test_rolling_frames_cross_runs(spark, dense, monkeypatch):
    monkeypatch.setattr(chunks.with_halo, "__defaults__", (37,))
    x = table(spark).selectExpr("k symbol", "bar_idx", "cast(v as double) logp").filter("symbol <> 'B'" if dense else "true")
    w = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(-99, 0)
    std = F.stddev_samp("logp").over(w)
    want = x.withColumn("z", F.when((F.count("logp").over(w) >= 10) & (std > 0), (F.col("logp") - F.avg("logp").over(w)) / std))
    key = lambda rows: {(r.symbol, r.bar_idx): None if r.z is None else round(r.z, 9) for r in rows}
    got = stats.rolling_z(x, 100, dense=dense).collect()
    assert len(got) == x.count() and key(got) == key(want.collect())


@pytest.mark.parametrize("dense", [False, True])
def test_fills_and_returns_over_many_chunks(spark, dense, monkeypatch):
    """Gaps longer than a run, a leading gap, and a symbol without any close."""
    monkeypatch.setattr(chunks.bar_chunk, "__defaults__", ("bar_idx", 16))
    x = spark.range(400).selectExpr("timestamp_seconds(id * 3600) ts", "explode(array('A', 'B', 'Z')) symbol", "cast(id as double) v", "id")
    b = x.selectExpr("symbol", "ts", "v open", "case when symbol = 'A' and (id < 50 or id between 100 and 180) or symbol = 'Z' then null else v end close")
    got = {(r.symbol, r.bar_idx): r.close for r in bars.dense_grid(b).collect()}
    for i in range(400):
        assert got["A", i] == (50 if i < 50 else 99 if 100 <= i <= 180 else i) and got["B", i] == i and got["Z", i] is None
    walk = bars.random_walk(b, 0.0, 1.0)
    monkeypatch.setattr(chunks.with_halo, "__defaults__", (16,))
    rets = {(r.symbol, r.bar_idx): r.ret for r in bars.log_returns(walk, dense=dense).collect()}
    assert rets["A", 0] is None and rets["A", 60] == 60 and rets["A", 120] == 0 and rets["B", 16] == 16


def test_no_window_over_all_bars(spark):
    """No running value sorts bars in one task: the only windows without a key run over chunk totals."""
    d = spark.range(1000).selectExpr("timestamp_seconds(id * 86400) ts", "1000D + id % 7 equity", "1D cash")
    prices = d.selectExpr("'A' symbol", "ts", "equity close")
    for df in (profile.drawdown(d), profile.equity_from_events(d, 1.0), bars.bar_index(prices), equity.market_index(prices)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert len(windows) > 1 and all("_chunk" in line for line in windows)
    daily = profile.drawdown(d).collect()
    assert min(r.drawdown for r in daily) == pytest.approx(1000 / 1006 - 1)

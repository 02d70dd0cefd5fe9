"""Backtests as relations against a loop over bars that keeps positions, orders and cash in hand: opens, skipped signals,
time exits, causal exits, shortage of cash, and sweeps of every number."""

from __future__ import annotations

import random
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

import numpy as np
import pytest

from spreadloom.operators import trades as T
from spreadloom.operators.paths import price_chunks
from spreadloom.params import BacktestParams
from spreadloom.plans.backtest import backtest
from spreadloom.plans.sweep import sweep_trades

SYMBOLS, N = ["AA", "BB", "CC"], 300
START = datetime(2024, 1, 1)
SIGNAL = "signal_id string, pair string, signal_time timestamp, hedge_ratio double, z double, signal string, dollar1 double, dollar2 double, half_life double"
PARAMS = BacktestParams(window=60, vol_bars=30, max_hold_days=1.0, z_exit=0.05, z_stop=2.4, risk_share=0.002, commission=0.001, slippage=0.0007)


def market(seed=3, opens=True):
    rng = np.random.default_rng(seed)
    common = 0.006 * rng.standard_normal(N).cumsum()
    close = {s: 20 * np.exp(common + 0.004 * rng.standard_normal(N).cumsum()) for s in SYMBOLS}
    opened = {s: c * (1 + 0.001 * rng.standard_normal(N)) for s, c in close.items()} if opens else close
    return opened, close


def signals(seed=4, dollars=20_000.0):
    rng = random.Random(seed)
    out = []
    for k in range(40):
        a, b = sorted(rng.sample(SYMBOLS, 2))
        kind = k % 5
        d = (None, None) if kind in (0, 3) else (0.0, 0.0) if k == 12 else (dollars * rng.uniform(0.5, 2), dollars * rng.uniform(0.5, 2))
        bar = rng.choice([0, 1, 7, N - 2, N - 1, *range(20, N - 2)]) if kind == 3 else rng.randrange(20, N - 2)
        at = START + timedelta(hours=bar, minutes=rng.choice([0, 0, 20]))
        z = rng.choice([-1, 1]) * rng.uniform(0.5, 2.5)
        out.append((f"s{k:02d}", f"{a}-{b}", at, rng.choice([None, 1.0, 0.8]), z, rng.choice([None, "long", "-1", "0.5", "junk"]), *d, rng.choice([None, 1.0, 4.0])))
    return [*out, ("x1", "AA-BB-CC", START, 1.0, 1.0, "1", 1.0, 1.0, 1.0), ("x2", "AA-ZZ", START, 1.0, 1.0, "1", 1.0, 1.0, 1.0), ("x3", "AA-BB", None, 1.0, 1.0, "1", 1.0, 1.0, 1.0)]


@dataclass
class Held:
    id: str
    legs: tuple
    hedge: float
    z: float
    side: int
    dollars: list
    bar: int
    fee: float = 0.0
    price: list = field(default_factory=list)
    units: list = field(default_factory=list)


class Loop:
    """One bar after the other."""

    def __init__(self, p, opened, close, rows):
        self.p, self.open, self.close = p, opened, close
        self.cash, self.reserved = p.capital, 0.0
        self.waiting, self.held, self.trades, self.book, self.equity, self.free = [], [], {}, [], [], {}
        arriving = {}
        for r in rows:
            legs = r[1].split("-")
            if len(legs) == 2 and set(legs) <= set(SYMBOLS) and r[2] is not None:
                bar = max(0, min(N - 1, int((r[2] - START).total_seconds() // 3600)))
                if bar < N - 1:
                    arriving.setdefault(bar, []).append((r, legs))
        for bar in range(N):
            for r, legs in sorted(arriving.get(bar, []), key=lambda x: x[0][0]):
                self.order(bar, r, legs)
            for x in [w for w in self.waiting if w.bar == bar]:
                self.enter(bar, x)
            self.waiting = [w for w in self.waiting if w.bar > bar]
            self.equity.append(self.cash + sum((self.close[s][bar] - q) * u for h in self.held for s, q, u in zip(h.legs, h.price, h.units)))
            self.held = [h for h in self.held if not self.leaves(bar, h)]

    def order(self, bar, r, legs):
        p = self.p
        name, _, _, hedge, z, word, d1, d2, life = r
        hedge = 1.0 if hedge is None else hedge
        side = {"long": 1, "-1": -1, "0.5": 1}.get(word, -1 if z > 0 else 1)
        if d1 is None:
            low = max(0, bar - p.vol_bars + 1)
            vol = [np.std(np.diff(np.log(self.close[s][low : bar + 1]))) if bar > low else 0.0 for s in legs]
            weight = [1 / vol[0] if vol[0] > 0 else 0.0, abs(hedge) / vol[1] if vol[1] > 0 else 0.0]
            dollars = [w * p.capital * p.notional_share / sum(weight) if sum(weight) else 0.0 for w in weight]
        else:
            dollars = [d1, d2]
        if sum(map(abs, dollars)) <= 0:
            self.book.append((bar, "skip", 0.0, "zero_alloc"))
            return
        hold = max(1, round((3.0 if life is None else life) * p.hold_multiplier))
        low = max(0, bar - p.vol_bars - 10)
        moves = [np.diff(np.log(self.close[s][low : bar + 1])) for s in legs]
        if bar - low >= 2 and len(moves[0]) >= hold:
            worst = [max(0.0, -np.cumsum(dollars[0] * moves[0][k : k + hold] - dollars[1] * moves[1][k : k + hold]).min()) for k in range(len(moves[0]) - hold + 1)]
            mae, limit = np.percentile(worst, 95), p.capital * p.risk_share
            if mae > limit:
                dollars = [d * limit / mae for d in dollars]
        fee = sum(map(abs, dollars)) * p.commission
        self.free[name] = (self.cash - self.reserved, fee)
        self.reserved += fee
        self.waiting.append(Held(name, tuple(legs), hedge, z, side, dollars, bar + 1, fee))

    def enter(self, bar, x):
        p = self.p
        signs = (x.side, -x.side)
        x.price = [self.open[s][bar] * (1 + g * p.slippage) for s, g in zip(x.legs, signs)]
        x.units = [g * d / q for g, d, q in zip(signs, x.dollars, x.price)]
        self.reserved = max(0.0, self.reserved - x.fee)
        x.fee = p.commission * sum(abs(q * u) for q, u in zip(x.price, x.units))
        self.cash -= x.fee
        self.book.append((bar, "entry_comm", -x.fee, f"entry pa={x.price[0]:.6f}, pb={x.price[1]:.6f}"))
        self.held.append(x)
        self.trades[x.id] = [bar, *x.price, *x.units, x.fee] + [None] * 6

    def leaves(self, bar, x):
        p = self.p
        low = max(0, bar - p.window + 1)
        spread = np.log(self.close[x.legs[0]][low : bar + 1]) - x.hedge * np.log(self.close[x.legs[1]][low : bar + 1])
        if len(spread) < 10 or spread.std(ddof=1) == 0:
            return False
        z = (spread[-1] - spread.mean()) / spread.std(ddof=1)
        if x.z * z < 0 or abs(z) <= p.z_exit:
            why = "mean_revert"
        elif abs(z) >= p.z_stop and z * x.z > 0:
            why = "stop_loss"
        elif (bar - x.bar) / 24 >= p.max_hold_days:
            why = "time_exit"
        else:
            return False
        if p.causal and bar == N - 1:
            return False
        at = min(bar + 1, N - 1)
        price = [self.open[s][at] * (1 - p.slippage if u > 0 else 1 + p.slippage) for s, u in zip(x.legs, x.units)]
        gross = sum((q - was) * u for q, was, u in zip(price, x.price, x.units))
        fee = p.commission * sum(abs(q * u) for q, u in zip(price, x.units))
        self.cash += gross - fee
        self.book.append((at, "exit", gross - fee, why))
        self.trades[x.id][6:] = [at, *price, why, gross, gross - fee - x.fee]
        return True


COLUMNS = ["entry_idx", "entry_price_a", "entry_price_b", "qty_a", "qty_b", "entry_comm", "exit_idx", "exit_price_a", "exit_price_b", "exit_reason", "pnl_gross", "pnl_net"]


def near(a, b):
    return a == b if a is None or b is None or isinstance(a, str) else abs(a - b) <= 1e-7 * max(1.0, abs(b))


def tables(spark, opened, close, rows, opens=True):
    bars = [(s, b, START + timedelta(hours=b), *([float(opened[s][b])] if opens else []), float(close[s][b])) for s in SYMBOLS for b in range(N)]
    prices = spark.createDataFrame(bars, "symbol string, bar_idx long, ts timestamp, " + ("open double, " if opens else "") + "close double").repartition(3)
    return spark.createDataFrame(rows, SIGNAL).repartition(2), prices


@pytest.mark.parametrize("opens,causal", [(True, False), (False, True)])
def test_trades_ledger_and_equity_equal_the_loop(spark, opens, causal):
    opened, close = market(opens=opens)
    p, rows = replace(PARAMS, causal=causal), signals()
    loop = Loop(p, opened, close, rows)
    b = backtest(*tables(spark, opened, close, rows, opens), p)
    got = {r.signal_id: [r[c] for c in COLUMNS] for r in b.trades.collect()}
    assert got.keys() == loop.trades.keys() and len(got) > 30
    for k, want in loop.trades.items():
        assert all(map(near, got[k], want)), (k, got[k], want)
    reasons = {t[9] for t in loop.trades.values()}
    assert {"mean_revert", "stop_loss", "time_exit"} <= reasons
    assert {r.type for r in b.ledger(True).collect()} == {"skip", "entry_comm", "exit"}
    book = sorted((r.time, r.type, r.note, r.cash_change) for r in b.ledger(True).collect())
    want = sorted((START + timedelta(hours=t), kind, note, cash) for t, kind, cash, note in loop.book)
    assert [x[:3] for x in book] == [x[:3] for x in want] and all(near(x[3], y[3]) for x, y in zip(book, want))
    equity = [r.equity for r in b.equity().orderBy("bar_idx").collect()]
    assert len(equity) == N and all(map(near, equity, loop.equity))
    audit = {r.signal_id: (r.free, r.est_comm, r.short) for r in b.audit().collect()}
    assert audit.keys() == loop.free.keys()
    assert all(near(audit[k][0], f) and near(audit[k][1], e) and not audit[k][2] for k, (f, e) in loop.free.items())


def test_a_shortage_of_cash_is_found_where_the_loop_meets_it(spark):
    opened, close = market()
    p = replace(PARAMS, capital=120.0, risk_share=1e6)
    rows = [(*r[:6], r[6] and r[6] * 2, r[7] and r[7] * 2, r[8]) for r in signals()]
    loop = Loop(p, opened, close, rows)
    order = sorted(loop.free, key=lambda k: (loop.trades[k][0], k))
    first = next(i for i, k in enumerate(order) if loop.free[k][1] > loop.free[k][0] + 1e-12)
    audit = {r.signal_id: r for r in backtest(*tables(spark, opened, close, rows), p).audit().collect()}
    assert 0 < first < len(order) - 1
    assert [audit[k].short for k in order[: first + 1]] == [False] * first + [True]
    assert all(near(audit[k].free, loop.free[k][0]) for k in order[: first + 1])


def test_a_sweep_of_windows_and_volatility_lengths_equals_the_loops(spark):
    opened, close = market(7)
    rows = signals(8)
    sets = {"base": PARAMS, "window": replace(PARAMS, window=40), "vol": replace(PARAMS, vol_bars=12), "both": replace(PARAMS, window=90, vol_bars=50, max_hold_days=0.5, causal=True), "costs": replace(PARAMS, slippage=0.01, z_stop=9.0, hold_multiplier=1.0)}
    got = {}
    for r in sweep_trades(*tables(spark, opened, close, rows), sets).collect():
        got.setdefault(r.param_id, {})[r.base_id] = [r[c] for c in COLUMNS]
    for name, p in sets.items():
        want = Loop(p, opened, close, rows).trades
        assert got[name].keys() == want.keys()
        assert all(all(map(near, got[name][k], want[k])) for k in want), name


def test_gates_of_several_windows(spark):
    opened, close = market(5)
    s, prices = tables(spark, opened, close, signals())
    sets = {str(n): replace(PARAMS, z_gate=1.0, window=n) for n in (30, 60)}
    got = sweep_trades(s, prices, sets).select("param_id", "base_id", "exit_idx", "side").collect()
    for name, p in sets.items():
        want = {(r.signal_id, r.exit_idx, r.side) for r in backtest(s, prices, p).trades.collect()}
        assert {(r.base_id, r.exit_idx, r.side) for r in got if r.param_id == name} == want and want


def test_positions_have_about_twice_their_held_bars_looked_at(spark, monkeypatch):
    opened, close = market()
    rows = signals()
    looked = []
    z = T.rolling_z

    def counted(x, window, least=10):
        out = z(x, window, least)
        looked.append(out.count())
        return out

    monkeypatch.setattr(T, "rolling_z", counted)
    monkeypatch.setattr(T.first_exit, "__defaults__", ("signal_id", 4))
    loop = Loop(PARAMS, opened, close, rows)
    b = backtest(*tables(spark, opened, close, rows), PARAMS)
    held = [min((t[6] or N) - t[0], N - t[0]) + 1 for t in loop.trades.values()]
    assert len(looked) > 2 and sum(looked) <= sum(max(4, 2 * h + 4) for h in held)
    got = {r.signal_id: [r[c] for c in COLUMNS] for r in b.trades.collect()}
    assert all(all(map(near, got[k], want)) for k, want in loop.trades.items())


def test_legs_without_some_bars_meet_on_those_of_both(spark):
    rows = [("A", b, float(b + 1)) for b in range(150) if b % 7] + [("B", b, float(b + 2)) for b in range(40, 150) if b % 5]
    chunks = price_chunks(spark.createDataFrame(rows, "symbol string, bar_idx long, close double"))
    x = spark.createDataFrame([("k", "A", "B", 30, 140), ("none", "A", "B", 0, 20), ("same", "A", "A", 60, 70)], "id string, a string, b string, f long, l long")
    from pyspark.sql import functions as F

    from spreadloom.operators.paths import leg_arrays

    got = {r.id: [(y.bar_idx, y.la, y.lb) for y in r.bars] for r in leg_arrays(x, chunks, "id", F.col("f"), F.col("l")).collect()}
    assert [y[0] for y in got["k"]] == [b for b in range(40, 141) if b % 7 and b % 5]
    assert all(near(y[1], np.log(y[0] + 1)) and near(y[2], np.log(y[0] + 2)) for y in got["k"])
    assert set(got) == {"k", "same"}

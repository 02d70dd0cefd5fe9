"""Signals and prices to trades, equity and metrics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.operators import equity as E
from spreadloom.operators import trades as T
from spreadloom.operators.paths import price_chunks
from spreadloom.operators.profile import drawdown
from spreadloom.params import BacktestParams
from spreadloom.session import settle


class Backtest(NamedTuple):
    allocated: DataFrame
    scaled: DataFrame
    fills: DataFrame
    trades: DataFrame
    prices: DataFrame
    chunks: DataFrame
    dates: DataFrame
    params: BacktestParams

    def equity(self) -> DataFrame:
        return E.equity_curve(self.trades, self.prices, self.dates, self.params)

    def audit(self) -> DataFrame:
        return E.cash_audit(self.scaled, self.trades, self.dates, self.params)

    def ledger(self, full: bool = False) -> DataFrame:
        return E.ledger(self.allocated, self.trades, self.dates, full)

    def report(self) -> dict[str, DataFrame]:
        """What sources.io.write_report writes."""
        equity = self.equity()
        return {"trades": self.trades, "metrics": self.metrics(), "equity": equity.select("ts", "equity"), "drawdown": drawdown(equity).select("ts", "drawdown"), "ledger": self.ledger(True)}

    def metrics(self) -> DataFrame:
        return E.report(self.trades, self.equity(), self.prices)


def backtest(signals: DataFrame, prices: DataFrame, p: BacktestParams = BacktestParams()) -> Backtest:
    """Tables of a backtest of signals (signal_id, pair, signal_time, ...) on a filled price grid. Entries are not refused
    for lack of cash: `audit` tells whether one should have been, and is exact up to the first. Mapped
    signals, price chunks, allocations, fills and trades are settled, since each is read by several later steps; the rest is lazy."""
    dates = prices.select("bar_idx", "ts").distinct()
    chunks = settle(price_chunks(prices))
    x = settle(T.normalise_side(T.split_pair(T.map_signals(signals, dates), prices)))
    if p.z_entry is not None:
        x = x.filter(F.abs("entry_z") >= p.z_entry)
    if p.z_gate is not None:
        x = T.gate_current_z(x, chunks, p)
    allocated = settle(T.resolve_alloc(x, chunks, p))
    live = allocated.filter("abs(alloc_a) + abs(alloc_b) > 0")
    scaled = T.risk_scale(live, T.mae95(live, chunks, p), p.capital * p.risk_share)
    scaled = scaled.withColumn("est_comm", (F.abs("alloc_a") + F.abs("alloc_b")) * p.commission)
    scaled = settle(scaled)
    fills = settle(T.entry_fills(scaled, prices, p))
    done = settle(T.trades(fills, T.exit_fills(fills, T.first_exit(fills, chunks, p), prices, p)))
    return Backtest(allocated, scaled, fills, done, prices, chunks, dates, p)

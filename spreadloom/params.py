"""Scan and backtest parameters. The defaults and presets."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScanParams:
    window: int = 200
    step: int = 50
    z_entry: float = 2.0
    max_half_life: float = 200.0
    max_beta: float = 0.11
    vol_bars: int = 60
    notional: float = 100_000.0
    benchmark: str = "BTCUSDT"
    excluded: tuple[str, ...] = ()
    max_windows: int | None = None
    cointegration: str | None = "aic"  # or lag0; None leaves the test out


@dataclass(frozen=True)
class BacktestParams:
    capital: float = 1_000_000.0
    commission: float = 0.0004
    slippage: float = 0.0005
    window: int = 200
    vol_bars: int = 60
    risk_share: float = 0.1
    notional_share: float = 0.1
    z_gate: float | None = None  # entry gate on a z taken anew; None trusts the signal's own
    z_entry: float | None = None  # least |z| of a signal
    z_exit: float = 0.0
    z_stop: float = 4.0
    hold_multiplier: float = 3.0
    max_hold_days: float = 30.0
    causal: bool = False  # leave positions open whose exit would fill on the bar of its trigger

    @property
    def notional(self) -> float:
        return self.capital * self.notional_share


PRESETS = {"own_z": BacktestParams(), "gated": BacktestParams(slippage=0.00005, z_gate=1.8)}

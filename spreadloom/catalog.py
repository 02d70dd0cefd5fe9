"""The registered queries of the pair-spread engine and their SQL. Doubles are rounded before they are compared."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import replace
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.operators import bars as B
from spreadloom.operators import panes as N
from spreadloom.operators import profile as P
from spreadloom.operators import stats as S
from spreadloom.operators import windows as W
from spreadloom.operators import coint as C
from spreadloom.operators import equity as E
from spreadloom.operators import trades as T
from spreadloom.params import BacktestParams, ScanParams
from spreadloom.plans.backtest import Backtest, backtest
from spreadloom.plans.resume import resume_scan, scan_signals
from spreadloom.plans.scan import scan_pairs
from spreadloom.plans.sweep import compare, scan_lookbacks, sweep
from spreadloom.session import settle, shared_folder
from spreadloom.sources import io

PARAMS = ScanParams(window=100, step=25, z_entry=1.0, benchmark="S00", cointegration=None)
TRADING = BacktestParams(risk_share=0.0005)
GATED = replace(TRADING, slippage=0.00005, z_gate=1.8)
SYMBOLS = [f"S{i:02d}" for i in range(12)]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return B.bars_from_events(_table(spark, d, "events"))


def _walk(spark: SparkSession, d: str) -> DataFrame:
    return B.random_walk(_bars(spark, d))


def _trades(spark: SparkSession, d: str) -> DataFrame:
    """Trade-shaped rows of lineitem; every order divisible by 50 is an open trade."""
    t = _table(spark, d, "lineitem")
    gross, comm = F.expr("l_extendedprice / 1000 * (l_discount - 0.05D)"), F.expr("l_extendedprice / 1000 * l_tax * 0.1D")
    closed = F.col("l_orderkey") % 50 != 0
    cols = {"pnl_gross": gross, "pnl_net": gross - comm, "commission_total": comm, "hold_hours": F.col("l_quantity"), "exit_reason": F.concat("l_returnflag", "l_linestatus")}
    return t.select("l_orderkey", "l_linenumber", "l_shipdate", F.concat(F.lit("P"), "l_suppkey").alias("pair"), *[F.when(closed, F.round(v, 9) if k in ("pnl_gross", "pnl_net", "commission_total") else v).alias(k) for k, v in cols.items()])


def _equity(spark: SparkSession, d: str) -> DataFrame:
    return P.equity_from_events(_trades(spark, d).select(F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("pnl_net").alias("cash")), 1e6)


def _ts(df: DataFrame, c: str = "ts") -> DataFrame:
    return df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _pair_stats(spark: SparkSession, d: str) -> DataFrame:
    s = N.window_statistics(_walk(spark, d), PARAMS.benchmark, [PARAMS.window], PARAMS.step)
    return _round(s.select("a", "b", "window_id", "hedge_ratio", "half_life", "beta", "z", "vol_a", "vol_b"), 5, "hedge_ratio", "beta", "z", "vol_a", "vol_b").withColumn("half_life", F.round("half_life", 1))


def _pair_rows(spark: SparkSession, d: str) -> DataFrame:
    w = W.assign_windows(_walk(spark, d), PARAMS.window, PARAMS.step)
    return S.pair_rows(w, W.usable_windows(w, PARAMS.window), PARAMS.benchmark)


def _spotty(spark: SparkSession, d: str) -> DataFrame:
    """The walk, with a symbol that hardly moves, one that never does and one without every 151st bar."""
    flat = F.when(F.col("symbol") == "S05", F.lit(0.25)).when(F.col("symbol") == "S06", 0.25 + F.col("bar_idx") % 2 * 1e-6)
    return _walk(spark, d).withColumn("logp", F.when((F.col("symbol") != "S07") | (F.col("bar_idx") % 151 != 0), F.coalesce(flat, F.col("logp"))))


def _odd_signals(spark: SparkSession, d: str) -> DataFrame:
    """A signal a bar, of which one in five has a time, pair or symbol that no trade can come from."""
    kind = F.col("bar_idx") % 10
    pair = F.when(kind == 1, "S01").when(kind == 3, "S01-S02-S03").when(kind == 5, "S01-S99").otherwise("S01-S02")
    late = F.col("ts") + F.when(kind == 7, F.expr("interval 400 days")).otherwise(F.expr("interval 0 days"))
    return _walk(spark, d).filter("symbol = 'S01'").select(F.concat_ws("#", F.lit("x"), "bar_idx").alias("signal_id"), pair.alias("pair"), F.when(kind != 9, late).alias("signal_time"))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """The scan's signals with their times; every third window leaves the dollars to the backtest."""
    walk = _walk(spark, d)
    s = scan_pairs(walk, _PARAMS.get()).withColumn("signal_id", F.concat_ws("#", "pair", "window_id"))
    s = s.withColumns({c: F.when(F.col("window_id") % 3 != 0, F.col(c)) for c in ("dollar1", "dollar2")})
    return s.join(walk.select(F.col("bar_idx").alias("end_index"), F.col("ts").alias("signal_time")).distinct(), "end_index")


#: The scan behind the backtest queries.
_PARAMS: ContextVar[ScanParams] = ContextVar("scan", default=PARAMS)
_SHARED: dict[tuple, Any] = {}


def _shared(spark: SparkSession, key: tuple, make: Callable[[], Any]) -> Any:
    """One settled panel or backtest serves all queries of an application that read it."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def _written(spark: SparkSession, d: str) -> int:
    """When the bars' table was last written: a table written anew is another one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _shared(spark, ("panel", d, _written(spark, d), _PARAMS.get()), lambda: (settle(_signals(spark, d)), settle(_walk(spark, d))))


def _backtest(spark: SparkSession, d: str, p: BacktestParams = TRADING) -> Backtest:
    return _shared(spark, (p, d, _written(spark, d), _PARAMS.get()), lambda: backtest(*_panel(spark, d), p))


def settle_backtest(spark: SparkSession, d: str) -> DataFrame:
    """What the backtest queries share, settled: bench.py times it as a row of its own, so that no query carries it."""
    _backtest(spark, d, GATED)
    return _backtest(spark, d).trades


def _mae(spark: SparkSession, d: str) -> DataFrame:
    b = _backtest(spark, d)
    return T.mae95(b.allocated, b.chunks, b.params)


def _market(spark: SparkSession, d: str) -> DataFrame:
    return _round(_ts(E.market_index(_walk(spark, d))), 8, "market", "market_ret")


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    tested = C.engle_granger(_pair_rows(spark, d), "lag0")
    return C.coint_transitions(tested.select("a", "b", "window_id", (F.col("t") < F.col("crit5")).alias("coint")))


def _eg(spark: SparkSession, d: str, lags: str) -> DataFrame:
    return _round(C.engle_granger(_pair_rows(spark, d), lags), 5, "t", "p", "crit1", "crit5", "crit10")


def _scan(spark: SparkSession, d: str, lags: str | None = None) -> DataFrame:
    s = scan_pairs(_walk(spark, d), replace(_PARAMS.get(), cointegration=lags or _PARAMS.get().cointegration))
    return _round(s.withColumn("half_life", F.round("half_life", 1)), 4, "hedge_ratio", "beta", "z").drop("qty1", "qty2", "p_value").withColumns({c: F.round(c, 0) for c in ("dollar1", "dollar2")})


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads back."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def _resumed_scan(spark: SparkSession, d: str) -> DataFrame:
    """The scan in three sittings: some symbols up to bar 400, all their bars, all symbols."""
    path, walk = _folder(spark, "scan"), settle(_walk(spark, d))
    older = F.col("symbol") < "S07"
    for part in (walk.filter(older & (F.col("bar_idx") < 400)), walk.filter(older), walk):
        resume_scan(part, PARAMS, path, per_block=4)
    return _round(scan_signals(spark, path).select("pair", "window_id", "signal", "z"), 4, "z")


def _bars_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "bars")
    io.write_table(_bars(spark, d).select(F.col("ts").alias("Date"), F.col("symbol").alias("Symbol"), F.col("open").alias("Open"), F.col("close").alias("Close")), path, "csv")
    return _ts(io.read_bars(spark, path).select("symbol", "ts", "open", "close"))


def _signals_file(spark: SparkSession, d: str) -> DataFrame:
    """Some end dates are missing, some hedge ratios are no numbers."""
    path, bar = _folder(spark, "signals"), F.regexp_extract("signal_id", "[0-9]+", 0).cast("long")
    hedge = F.when(bar % 10 == 3, "n/a").otherwise((bar % 10).cast("string"))
    io.write_table(_odd_signals(spark, d).select("signal_id", "pair", F.date_format("signal_time", "yyyy-MM-dd HH:mm:ss").alias("end_date"), hedge.alias("hedge_ratio"), F.lit(0.5).alias("beta_btc")), path, "csv")
    return _ts(io.read_signals(spark, path).select("signal_id", "pair", "signal_time", "hedge_ratio", "beta"), "signal_time")


def _trades_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "trades")
    io.write_table(_trades(spark, d).drop("l_shipdate"), path, "csv")
    back = io.read_trades(spark, path).withColumns({c: F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber")})
    return back.select("l_orderkey", "l_linenumber", "pair", "pnl_net", "exit_reason")


def _report_files(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "report")
    io.write_report(_backtest(spark, d).report(), path)
    return _round(spark.read.parquet(f"{path}/metrics"), 4, "value")


PANEL = replace(PARAMS, z_entry=2.0, benchmark="P000001")


def _panel_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.bars_from_lineitem(_table(spark, d, "lineitem"))


def _panel_scan(spark: SparkSession, d: str) -> DataFrame:
    s = scan_pairs(B.dense_runs(_panel_bars(spark, d)), PANEL)
    s = _round(s.select("pair", "window_id", "signal", "hedge_ratio", "beta", "z"), 4, "hedge_ratio", "beta", "z")
    return s.withColumns({c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)) for c in ("hedge_ratio", "beta")})  # no -0


QUERIES = {
    "panel_bars": lambda s, d: _round(_ts(_panel_bars(s, d)), 8, "open", "close"),
    "panel_scan": _panel_scan,
    "resumed_scan": _resumed_scan,
    "capped_scan": lambda s, d: _round(scan_pairs(_walk(s, d), replace(PARAMS, max_windows=5)).select("pair", "window_id", "signal", "z"), 4, "z"),
    "bars_file": _bars_file,
    "signals_file": _signals_file,
    "trades_file": _trades_file,
    "report_files": _report_files,
    "bars_from_events": lambda s, d: _ts(_bars(s, d)),
    "bar_index": lambda s, d: _ts(B.with_bar_idx(_bars(s, d)).select("symbol", "ts", "bar_idx")),
    "duplicate_bars": lambda s, d: _ts(B.duplicate_bars(_bars(s, d).union(_bars(s, d).filter("symbol = 'S03'")))),
    "dedupe_bars": lambda s, d: _ts(B.dedupe_bars(_bars(s, d).unionByName(_bars(s, d).filter("symbol = 'S03'").withColumn("close", 100 - F.col("close")))).select("symbol", "ts", "close")),
    "dense_grid": lambda s, d: _ts(B.dense_grid(_bars(s, d))),
    "log_prices": lambda s, d: _round(_ts(B.log_prices(_bars(s, d)).select("symbol", "ts", "shift", "logp")), 6, "shift", "logp"),
    "log_returns": lambda s, d: _round(B.log_returns(_walk(s, d), dense=True).select("symbol", "bar_idx", "ret"), 8, "ret"),
    "wide_matrix": lambda s, d: _ts(B.wide_matrix(_bars(s, d), SYMBOLS)),
    "resample_daily": lambda s, d: _ts(B.resample(_bars(s, d)), "bar_ts"),
    "normalised_price": lambda s, d: _round(_ts(B.normalised(_bars(s, d)).select("symbol", "ts", "norm")), 6, "norm"),
    "assign_windows": lambda s, d: W.assign_windows(_walk(s, d), PARAMS.window, PARAMS.step).groupBy("symbol", "window_id").agg(F.count("*").alias("n"), F.min("bar_idx").alias("first_bar"), F.max("bar_idx").alias("last_bar")),
    "usable_windows": lambda s, d: W.usable_windows(w := W.assign_windows(B.log_prices(B.grid(_bars(s, d))), PARAMS.window, PARAMS.step), PARAMS.window),
    "usable_windows_mixed": lambda s, d: W.usable_windows(W.assign_windows(_spotty(s, d), PARAMS.window, PARAMS.step), PARAMS.window),
    "limited_pairs": lambda s, d: W.limit_pairs(W.pairs(W.candidates(_bars(s, d), "S00")), 7),
    "scan_sizes": lambda s, d: _round(scan_pairs(_walk(s, d), _PARAMS.get()).select("pair", "window_id", "qty1", "qty2"), 1, "qty1", "qty2"),
    "scan_lookbacks": lambda s, d: _round(scan_lookbacks(_walk(s, d), PARAMS, (100, 150)).select("lookback", "pair", "window_id", "signal", "z"), 4, "z"),
    "exit_reasons_ordered": lambda s, d: _round(P.by_exit_reason(_trades(s, d), True).select("exit_reason", "total_net"), 4, "total_net"),
    "equal_return_index": lambda s, d: _round(_ts(E.market_index(_walk(s, d), "equal_return")), 8, "market", "market_ret"),
    "rejected_signals": lambda s, d: T.rejected_signals(_odd_signals(s, d), _walk(s, d)).select("signal_id", "reason"),
    "pair_universe": lambda s, d: W.pairs(W.candidates(_bars(s, d), "S00", ("S05",))),
    "rolling_z": lambda s, d: _round(S.rolling_z(_walk(s, d), dense=True).select("symbol", "bar_idx", "z"), 5, "z"),
    "pair_statistics": _pair_stats,
    "pair_scan": lambda s, d: _scan(s, d),
    "pair_scan_aic": lambda s, d: _scan(s, d, "aic"),
    "symbol_beta": lambda s, d: _round(S.symbol_beta(_walk(s, d), "S00"), 6, "beta", "corr"),
    "beta_summary": lambda s, d: _round(S.beta_summary(S.symbol_beta(_walk(s, d), "S00")), 6, "mean_beta"),
    "trade_flags": lambda s, d: _round(P.trade_flags(_trades(s, d)).select("l_orderkey", "l_linenumber", "win", "gross_is_zero", "comm_ratio"), 6, "comm_ratio"),
    "trade_summary": lambda s, d: _round(P.trade_summary(_trades(s, d)), 4, "win_pct", "total_net", "mean_net", "median_net", "total_commission", "profit_factor"),
    "by_exit_reason": lambda s, d: _round(P.by_exit_reason(_trades(s, d)), 4, "win_pct", "mean_net", "median_net", "total_net", "mean_hold", "mean_commission"),
    "commission_profile": lambda s, d: _round(P.commission_profile(_trades(s, d)), 6, "small_gross_pct", "ratio_over_one_pct", "median_ratio"),
    "trade_profile": lambda s, d: P.trade_profile(_trades(s, d)).withColumn("value", F.when(F.col("section") == "commission", F.round("value", 6)).otherwise(F.round("value", 4))),
    "hold_pnl_corr": lambda s, d: _round(P.hold_pnl_corr(_trades(s, d)), 8, "corr"),
    "worst_trades": lambda s, d: _round(P.worst_trades(_trades(s, d), 10, "l_orderkey", "l_linenumber").select("pair", "l_orderkey", "l_linenumber", "exit_reason", "pnl_net"), 6, "pnl_net"),
    "equity_curve": lambda s, d: _round(_ts(_equity(s, d)), 3, "equity"),
    "drawdown": lambda s, d: _round(_ts(P.drawdown(_equity(s, d)).select("ts", "drawdown")), 8, "drawdown"),
    "metrics": lambda s, d: _round(P.metrics(_equity(s, d), 365.0), 5, "value"),
    "engle_granger_lag0": lambda s, d: _eg(s, d, "lag0").select("a", "b", "window_id", "n", "t", "crit5"),
    "engle_granger_aic": lambda s, d: _eg(s, d, "aic"),
    "cointegrated_scan": lambda s, d: _round(scan_pairs(_walk(s, d), replace(PARAMS, z_entry=0.5, cointegration="lag0")).select("pair", "window_id", "signal", "p_value"), 5, "p_value"),
    "coint_transitions": _transitions,
    "pair_corr": lambda s, d: _round(C.pair_corr(_pair_rows(s, d)), 6, "corr"),
    "hurst": lambda s, d: _round(C.hurst(_walk(s, d)), 6, "hurst"),
    "map_signals": lambda s, d: T.map_signals(_panel(s, d)[0].withColumn("signal_time", F.expr("signal_time + make_dt_interval(0, window_id, 20)")), _walk(s, d).select("ts", "bar_idx").distinct()).select("signal_id", "signal_bar", "exec_idx"),
    "allocations": lambda s, d: _round(_backtest(s, d).allocated.select("signal_id", "a", "b", "side", "alloc_a", "alloc_b"), 2, "alloc_a", "alloc_b"),
    "mae95": lambda s, d: _round(_mae(s, d), 4, "mae"),
    "entry_fills": lambda s, d: _round(_backtest(s, d).fills.select("signal_id", "entry_idx", "entry_price_a", "entry_price_b", "qty_a", "qty_b", "entry_comm"), 4, "entry_price_a", "entry_price_b", "qty_a", "qty_b", "entry_comm"),
    "trades": lambda s, d: _round(_backtest(s, d).trades.select(*TRADE).withColumns({c: F.col(c).cast("double") for c in ("exit_idx", "hold_hours")}), 2, "pnl_gross", "pnl_net", "exit_comm"),
    "trades_gated": lambda s, d: _round(_backtest(s, d, GATED).trades.select(*TRADE).withColumns({c: F.col(c).cast("double") for c in ("exit_idx", "hold_hours")}), 2, "pnl_gross", "pnl_net", "exit_comm"),
    "cash_audit": lambda s, d: _round(_backtest(s, d).audit(), 2, "est_comm", "free"),
    "ledger": lambda s, d: _round(_ts(_backtest(s, d).ledger(True).drop("note"), "time"), 2, "cash_change"),
    "unrealised": lambda s, d: _round(E.unrealised((b := _backtest(s, d)).trades, b.prices), 2, "unrealised"),
    "backtest_equity": lambda s, d: _round(_backtest(s, d).equity().select("bar_idx", "equity"), 2, "equity"),
    "market_index": _market,
    "backtest_metrics": lambda s, d: _round(_backtest(s, d).metrics(), 4, "value"),
    "compare_presets": lambda s, d: _round(compare(*_panel(s, d), {"own_z": TRADING, "gated": GATED}), 2, "win_rate", "net"),
    "sweep": lambda s, d: _round(compare(*_panel(s, d), sweep(TRADING, z_stop=(2.0, 4.0), z_exit=(0.0, 0.5))), 2, "win_rate", "net"),
    "portfolio_exposure": lambda s, d: _round(E.portfolio_exposure((b := _backtest(s, d)).trades, b.prices, b.params), 6, "net_beta"),
}

TRADE = ["signal_id", "pair", "side", "entry_idx", "exit_idx", "exit_reason", "hold_hours", "pnl_gross", "pnl_net", "exit_comm"]

_W, _S = PARAMS.window, PARAMS.step
_BARS = """bars AS (SELECT 'S' || lpad((user_id % 12)::VARCHAR, 2, '0') AS symbol, date_trunc('hour', ts) AS ts,
    arg_min(value, ts) AS open, arg_max(value, ts) AS close FROM events GROUP BY 1, 2),
dates AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar_idx FROM (SELECT DISTINCT ts FROM bars)),
grid AS (SELECT s.symbol, d.ts, d.bar_idx, b.close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN dates d
    LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = d.ts)"""
_WALK = _BARS + """,
walk AS (SELECT symbol, ts, bar_idx, sum((coalesce(close, 50) - 50) / 5000) OVER (PARTITION BY symbol ORDER BY bar_idx) AS logp FROM grid)"""
_LAST = f"(SELECT max(bar_idx) + 1 - {_W} FROM dates) // {_S}"
_WINDOWED = f"""windowed AS (SELECT x.*, k.window_id FROM {{src}} x, (SELECT unnest(range(0, {_LAST} + 1)) AS window_id) k
    WHERE x.bar_idx BETWEEN k.window_id * {_S} AND k.window_id * {_S} + {_W - 1})"""
_TRADES = """trades AS (SELECT l_orderkey, l_linenumber, l_shipdate, 'P' || l_suppkey AS pair,
    CASE WHEN c THEN round(g, 9) END AS pnl_gross, CASE WHEN c THEN round(g - m, 9) END AS pnl_net, CASE WHEN c THEN round(m, 9) END AS commission_total,
    CASE WHEN c THEN l_quantity END AS hold_hours, CASE WHEN c THEN l_returnflag || l_linestatus END AS exit_reason
    FROM (SELECT *, l_orderkey % 50 <> 0 AS c, l_extendedprice / 1000 * (l_discount - 0.05::DOUBLE) AS g, l_extendedprice / 1000 * l_tax * 0.1::DOUBLE AS m FROM lineitem)),
flags AS (SELECT *, coalesce(pnl_net > 0, false) AS win, coalesce(pnl_gross = 0, false) AS gross_is_zero,
    CASE WHEN pnl_gross <> 0 THEN commission_total / abs(pnl_gross) END AS comm_ratio FROM trades)"""
_EQUITY = _TRADES + """,
equity AS (SELECT ts, 1e6::DOUBLE + sum(cash) OVER (ORDER BY ts) AS equity FROM
    (SELECT l_shipdate AS ts, sum(pnl_net) AS cash FROM trades WHERE pnl_net IS NOT NULL GROUP BY 1))"""
_F = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
_STATS = _WALK + ", " + _WINDOWED.format(src="walk") + """,
p AS (SELECT a.symbol AS a, b.symbol AS b, a.window_id, a.bar_idx, a.logp AS la, b.logp AS lb, c.logp AS lc FROM windowed a
    JOIN windowed b ON a.window_id = b.window_id AND a.bar_idx = b.bar_idx AND a.symbol < b.symbol
    JOIN windowed c ON a.window_id = c.window_id AND a.bar_idx = c.bar_idx AND c.symbol = 'S00' WHERE a.symbol <> 'S00' AND b.symbol <> 'S00'),
hr AS (SELECT a, b, window_id, regr_slope(la, lb) AS h, max(bar_idx) AS e FROM p GROUP BY ALL),
q AS (SELECT p.*, h, e, la - h * lb AS s FROM p JOIN hr USING (a, b, window_id)),
r AS (SELECT *, s - lag(s) OVER o AS ds, lag(s) OVER o AS sl, la - lag(la) OVER o AS da, lb - lag(lb) OVER o AS db, lc - lag(lc) OVER o AS dc
    FROM q WINDOW o AS (PARTITION BY a, b, window_id ORDER BY bar_idx)),
t AS (SELECT a, b, window_id, min(bar_idx) AS start_index, max(bar_idx) AS end_index, first(h) AS hedge_ratio, 1 + regr_slope(ds, sl) AS phi,
    covar_samp(da - h * db, dc) / nullif(var_pop(dc), 0) AS beta, arg_max(s, bar_idx) AS s_last, avg(s) AS m, stddev_samp(s) AS sd,
    stddev_pop(CASE WHEN bar_idx > e - 59 THEN da END) AS vol_a, stddev_pop(CASE WHEN bar_idx > e - 59 THEN db END) AS vol_b FROM r GROUP BY a, b, window_id),
st AS (SELECT *, CASE WHEN phi > 0 AND phi < 1 THEN round_even(-ln(2) / ln(phi), 2) END AS half_life, CASE WHEN sd > 0 THEN (s_last - m) / sd END AS z FROM t)"""

_LINES = """bars AS (SELECT 'P' || lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, date_trunc('week', l_shipdate)::TIMESTAMP AS ts,
    first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close
    FROM lineitem GROUP BY 1, 2)"""
_PANEL = _LINES + """,
dates AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar_idx FROM (SELECT DISTINCT ts FROM bars)),
grid AS (SELECT s.symbol, d.ts, d.bar_idx, b.close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN dates d LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = d.ts),
walk AS (SELECT symbol, ts, bar_idx, ln(coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx),
    first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS logp FROM grid)"""

SQL = {
    "panel_bars": f"WITH {_LINES} SELECT symbol, {_F}, round(open, 8) AS open, round(close, 8) AS close FROM bars",
    "panel_scan": f"""WITH {_STATS.replace(_WALK, _PANEL).replace("'S00'", f"'{PANEL.benchmark}'")} SELECT a || '-' || b AS pair, window_id, CASE WHEN z >= {PANEL.z_entry} THEN -1 ELSE 1 END AS signal,
    CASE WHEN round(hedge_ratio, 4) = 0 THEN 0.0::DOUBLE ELSE round(hedge_ratio, 4) END AS hedge_ratio, CASE WHEN round(beta, 4) = 0 THEN 0.0::DOUBLE ELSE round(beta, 4) END AS beta, round(z, 4) AS z FROM st WHERE half_life > 0 AND half_life <= {PANEL.max_half_life} AND abs(beta) < {PANEL.max_beta} AND abs(z) >= {PANEL.z_entry}""",
    "bars_from_events": f"WITH {_BARS} SELECT symbol, {_F}, open, close FROM bars",
    "bar_index": f"WITH {_BARS} SELECT symbol, {_F}, bar_idx FROM bars JOIN dates USING (ts)",
    "duplicate_bars": f"WITH {_BARS}, twice AS (SELECT * FROM bars UNION ALL SELECT * FROM bars WHERE symbol = 'S03') SELECT symbol, {_F}, n FROM (SELECT symbol, ts, count(*) AS n FROM twice GROUP BY ALL HAVING count(*) > 1)",
    "dedupe_bars": f"WITH {_BARS}, twice AS (SELECT symbol, ts, close FROM bars UNION ALL SELECT symbol, ts, 100 - close FROM bars WHERE symbol = 'S03') SELECT symbol, {_F}, close FROM (SELECT symbol, ts, min(close) AS close FROM twice GROUP BY ALL)",
    "usable_windows_mixed": f"""WITH {_WALK}, spotty AS (SELECT symbol, bar_idx, CASE WHEN symbol = 'S05' THEN 0.25 WHEN symbol = 'S06' THEN 0.25 + bar_idx % 2 * 1e-6 WHEN symbol = 'S07' AND bar_idx % 151 = 0 THEN NULL ELSE logp END::DOUBLE AS logp FROM walk), {_WINDOWED.format(src="spotty")},
        g AS (SELECT symbol, window_id, count(logp) AS n, arg_min(logp, bar_idx) AS x0, min(logp) AS a, max(logp) AS b FROM windowed GROUP BY ALL)
        SELECT symbol, window_id FROM g WHERE n = {_W} AND greatest(b - x0, x0 - a) > 1e-8 + 1e-5 * abs(x0)""",
    "limited_pairs": f"WITH {_BARS}, u AS (SELECT DISTINCT symbol FROM bars WHERE symbol <> 'S00') SELECT x.symbol AS a, y.symbol AS b FROM u x JOIN u y ON x.symbol < y.symbol ORDER BY 1, 2 LIMIT 7",
    "scan_sizes": f"""WITH {_STATS}, w AS (SELECT st.*, 1 / vol_a AS wa, abs(hedge_ratio) / vol_b AS wb, exp(x.logp) AS pa, exp(y.logp) AS pb FROM st JOIN walk x ON x.symbol = a AND x.bar_idx = end_index JOIN walk y ON y.symbol = b AND y.bar_idx = end_index)
        SELECT a || '-' || b AS pair, window_id, round(wa / (wa + wb) * 100000 / pa, 1) AS qty1, round(wb / (wa + wb) * 100000 / pb, 1) AS qty2 FROM w WHERE half_life > 0 AND half_life <= 200 AND abs(beta) < 0.11 AND abs(z) >= 1""",
    "scan_lookbacks": " UNION ALL ".join(f"SELECT * FROM (WITH {_STATS.replace(_LAST, _LAST.replace(f'1 - {_W}', f'1 - {n}')).replace(f'{_S} + {_W - 1})', f'{_S} + {n - 1})')} SELECT {n}::INTEGER AS lookback, a || '-' || b AS pair, window_id, (CASE WHEN z >= 1 THEN -1 ELSE 1 END)::INTEGER AS signal, round(z, 4) AS z FROM st WHERE half_life > 0 AND half_life <= 200 AND abs(beta) < 0.11 AND abs(z) >= 1)" for n in (100, 150)),
    "exit_reasons_ordered": f"WITH {_TRADES} SELECT exit_reason, round(sum(pnl_net), 4) AS total_net FROM flags WHERE exit_reason IS NOT NULL GROUP BY 1 ORDER BY 2 DESC",
    "equal_return_index": f"""WITH {_WALK}, r AS (SELECT symbol, ts, exp(logp) / lag(exp(logp)) OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 AS ret FROM walk), m AS (SELECT ts, avg(ret) AS ret FROM r GROUP BY 1),
        i AS (SELECT ts, exp(sum(ln(1 + coalesce(ret, 0))) OVER (ORDER BY ts)) AS market FROM m) SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(market, 8) AS market, round(ln(market) - ln(lag(market) OVER (ORDER BY i.ts)), 8) AS market_ret FROM i""",
    "rejected_signals": f"""WITH {_BARS}, o AS (SELECT bar_idx, bar_idx % 10 AS k, ts + CASE WHEN bar_idx % 10 = 7 THEN INTERVAL 400 DAY ELSE INTERVAL 0 DAY END AS moment, max(ts) OVER () AS final FROM dates)
        SELECT 'x#' || bar_idx AS signal_id, CASE WHEN k IN (1, 3) THEN 'bad_pair' WHEN k = 5 THEN 'unknown_symbol' WHEN k = 9 THEN 'no_time' ELSE 'no_next_bar' END AS reason FROM o WHERE k IN (1, 3, 5, 9) OR moment >= final""",
    "dense_grid": f"""WITH {_BARS}, f AS (SELECT symbol, ts, bar_idx, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx) AS c FROM grid)
        SELECT symbol, {_F}, bar_idx, first_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM f""",
    "log_prices": f"""WITH {_BARS}, m AS (SELECT *, min(close) OVER (PARTITION BY symbol) AS lo FROM bars), s AS (SELECT *, CASE WHEN lo <= 0 THEN abs(lo) + 1e-6::DOUBLE ELSE 0.0::DOUBLE END AS shift FROM m)
        SELECT symbol, {_F}, round(shift, 6) AS shift, round(ln(close + shift), 6) AS logp FROM s""",
    "log_returns": f"WITH {_WALK} SELECT symbol, bar_idx, round(logp - lag(logp) OVER (PARTITION BY symbol ORDER BY bar_idx), 8) AS ret FROM walk",
    "wide_matrix": f"WITH {_BARS} SELECT {_F}, " + ", ".join(f"max(CASE WHEN symbol = '{x}' THEN close END) AS {x}" for x in SYMBOLS) + " FROM bars GROUP BY bars.ts",
    "resample_daily": f"WITH {_BARS} SELECT symbol, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS bar_ts, arg_min(open, ts) AS open, max(close) AS high, min(close) AS low, arg_max(close, ts) AS close, count(*) AS n_bars FROM bars GROUP BY 1, 2",
    "normalised_price": f"WITH {_BARS} SELECT symbol, {_F}, round(close / nullif(first_value(close) OVER (PARTITION BY symbol ORDER BY bars.ts), 0), 6) AS norm FROM bars",
    "assign_windows": f"WITH {_WALK}, {_WINDOWED.format(src='walk')} SELECT symbol, window_id, count(*) AS n, min(bar_idx) AS first_bar, max(bar_idx) AS last_bar FROM windowed GROUP BY ALL",
    "usable_windows": f"""WITH {_BARS}, m AS (SELECT *, min(close) OVER (PARTITION BY symbol) AS lo FROM grid),
        l AS (SELECT symbol, bar_idx, ln(close + CASE WHEN lo <= 0 THEN abs(lo) + 1e-6::DOUBLE ELSE 0 END) AS logp FROM m), {_WINDOWED.format(src="l")},
        g AS (SELECT symbol, window_id, count(logp) AS n, arg_min(logp, bar_idx) AS x0, min(logp) AS a, max(logp) AS b FROM windowed GROUP BY ALL)
        SELECT symbol, window_id FROM g WHERE n = {_W} AND greatest(b - x0, x0 - a) > 1e-8 + 1e-5 * abs(x0)""",
    "pair_universe": f"WITH {_BARS}, u AS (SELECT DISTINCT symbol FROM bars WHERE symbol NOT IN ('S00', 'S05')) SELECT x.symbol AS a, y.symbol AS b FROM u x JOIN u y ON x.symbol < y.symbol",
    "rolling_z": f"""WITH {_WALK} SELECT symbol, bar_idx, round(CASE WHEN count(logp) OVER w >= 10 AND stddev_samp(logp) OVER w > 0 THEN (logp - avg(logp) OVER w) / stddev_samp(logp) OVER w END, 5) AS z
        FROM walk WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""",
    "pair_statistics": f"WITH {_STATS} SELECT a, b, window_id, round(hedge_ratio, 5) AS hedge_ratio, round(half_life, 1) AS half_life, round(beta, 5) AS beta, round(z, 5) AS z, round(vol_a, 5) AS vol_a, round(vol_b, 5) AS vol_b FROM st",
    "pair_scan": f"""WITH {_STATS}, w AS (SELECT *, 1 / vol_a AS wa, abs(hedge_ratio) / vol_b AS wb FROM st)
        SELECT a || '-' || b AS pair, window_id, start_index, end_index, round(hedge_ratio, 4) AS hedge_ratio, round(half_life, 1) AS half_life, round(beta, 4) AS beta, round(z, 4) AS z,
        (CASE WHEN z >= 1 THEN -1 ELSE 1 END)::INTEGER AS signal, round(round(wa / (wa + wb) * 100000, 2), 0) AS dollar1, round(round(wb / (wa + wb) * 100000, 2), 0) AS dollar2
        FROM w WHERE half_life > 0 AND half_life <= 200 AND abs(beta) < 0.11 AND abs(z) >= 1""",
    "symbol_beta": (_BETA := f"""WITH {_WALK}, r AS (SELECT symbol, bar_idx, logp - lag(logp) OVER (PARTITION BY symbol ORDER BY bar_idx) AS ret FROM walk),
        j AS (SELECT r.symbol, r.ret, c.ret AS bench FROM r JOIN r c ON r.bar_idx = c.bar_idx AND c.symbol = 'S00' WHERE r.symbol <> 'S00' AND r.ret IS NOT NULL AND c.ret IS NOT NULL),
        betas AS (SELECT symbol, covar_samp(ret, bench) / nullif(var_pop(bench), 0) AS beta, corr(ret, bench) AS corr, count(*) AS n FROM j GROUP BY 1) """) + "SELECT symbol, round(beta, 6) AS beta, round(corr, 6) AS corr, n FROM betas",
    "beta_summary": _BETA + "SELECT count(*) AS n_symbols, round(avg(beta), 6) AS mean_beta, count(*) FILTER (abs(beta) < 0.11) AS near_zero, count(*) FILTER (beta > 1) AS above_one, count(*) FILTER (beta < 0) AS negative FROM betas",
    "trade_flags": f"WITH {_TRADES} SELECT l_orderkey, l_linenumber, win, gross_is_zero, round(comm_ratio, 6) AS comm_ratio FROM flags",
    "trade_summary": f"""WITH {_TRADES} SELECT count(*) AS n_trades, round(avg(win::INT) * 100, 4) AS win_pct, round(sum(pnl_net), 4) AS total_net, round(avg(pnl_net), 4) AS mean_net, round(quantile_cont(pnl_net, 0.5), 4) AS median_net,
        round(sum(commission_total), 4) AS total_commission, round(sum(pnl_net) FILTER (pnl_net > 0) / abs(sum(pnl_net) FILTER (pnl_net < 0)), 4) AS profit_factor FROM flags""",
    "by_exit_reason": f"""WITH {_TRADES} SELECT exit_reason, count(*) AS n_trades, round(avg(win::INT) * 100, 4) AS win_pct, round(avg(pnl_net), 4) AS mean_net, round(quantile_cont(pnl_net, 0.5), 4) AS median_net, round(sum(pnl_net), 4) AS total_net,
        round(avg(hold_hours), 4) AS mean_hold, round(avg(commission_total), 4) AS mean_commission FROM flags WHERE exit_reason IS NOT NULL GROUP BY 1""",
    "commission_profile": f"WITH {_TRADES} SELECT round(avg(coalesce(abs(pnl_gross) < 1, false)::INT) * 100, 6) AS small_gross_pct, round(avg((gross_is_zero OR coalesce(comm_ratio > 1, false))::INT) * 100, 6) AS ratio_over_one_pct, round(quantile_cont(comm_ratio, 0.5), 6) AS median_ratio FROM flags",
    "hold_pnl_corr": f"WITH {_TRADES} SELECT round(corr(hold_hours, pnl_net), 8) AS corr FROM trades",
    "worst_trades": f"WITH {_TRADES} SELECT pair, l_orderkey, l_linenumber, exit_reason, round(pnl_net, 6) AS pnl_net FROM trades ORDER BY trades.pnl_net NULLS LAST, l_orderkey, l_linenumber LIMIT 10",
    "equity_curve": f"WITH {_EQUITY} SELECT {_F}, round(equity, 3) AS equity FROM equity",
    "drawdown": f"WITH {_EQUITY} SELECT {_F}, round(equity / max(equity) OVER (ORDER BY equity.ts) - 1, 8) AS drawdown FROM equity",
    "metrics": f"""WITH {_EQUITY}, d AS (SELECT ts, equity, equity / max(equity) OVER (ORDER BY ts) - 1 AS dd, equity / lag(equity) OVER (ORDER BY ts) - 1 AS ret FROM equity),
        o AS (SELECT arg_min(equity, ts) AS e0, arg_max(equity, ts) AS e1, (epoch(max(ts)) - epoch(min(ts))) / (365.0::DOUBLE * 86400) AS y, min(dd) AS mdd, avg(ret) * sqrt(365::DOUBLE) / stddev_pop(ret) AS sharpe FROM d),
        m AS (SELECT *, pow(e1 / e0, 1 / y) - 1 AS cagr FROM o)
        SELECT 'cagr' AS metric, round(cagr, 5) AS value FROM m UNION ALL SELECT 'mdd', round(mdd, 5) FROM m UNION ALL SELECT 'cagr_mdd', round(cagr / abs(mdd), 5) FROM m UNION ALL SELECT 'sharpe', round(sharpe, 5) FROM m UNION ALL SELECT 'final_equity', round(e1, 5) FROM m""",
}


def _book(p: BacktestParams = TRADING) -> str:
    """The backtest in SQL, down to `trades`."""
    gate = "" if p.z_gate is None else f"WHERE abs(z_now) >= {p.z_gate}"
    z, side = ("entry_z", "side") if p.z_gate is None else ("z_now", "CASE WHEN z_now > 0 THEN -1 ELSE 1 END")
    legs = "JOIN px x ON x.symbol = s.a AND x.bar_idx BETWEEN greatest(0, s.{0}) AND {1} JOIN px y ON y.symbol = s.b AND y.bar_idx = x.bar_idx"
    return _STATS + f""",
px AS (SELECT symbol, ts, bar_idx, exp(logp) AS close, ln(exp(logp)) AS l FROM walk), lastbar AS (SELECT max(bar_idx) AS last_bar FROM dates),
sz AS (SELECT *, 1 / vol_a AS wa, abs(hedge_ratio) / vol_b AS wb FROM st WHERE half_life > 0 AND half_life <= 200 AND abs(beta) < 0.11 AND abs(z) >= 1),
sig0 AS (SELECT a || '-' || b AS pair, a || '-' || b || '#' || window_id AS signal_id, a, b, beta, window_id, end_index AS signal_bar, end_index + 1 AS exec_idx, hedge_ratio AS h, half_life, z AS entry_z,
    (CASE WHEN z >= 1 THEN -1 ELSE 1 END)::INTEGER AS side, CASE WHEN window_id % 3 <> 0 THEN round(wa / (wa + wb) * 100000, 2) END AS d1, CASE WHEN window_id % 3 <> 0 THEN round(wb / (wa + wb) * 100000, 2) END AS d2, last_bar FROM sz, lastbar WHERE end_index < last_bar),
cz AS (SELECT signal_id, (arg_max(x.l - h * y.l, x.bar_idx) - avg(x.l - h * y.l)) / stddev_samp(x.l - h * y.l) AS z_now FROM sig0 s {legs.format("signal_bar - 199", "s.signal_bar")} GROUP BY 1),
sig AS (SELECT s.* REPLACE ({z} AS entry_z, ({side})::INTEGER AS side) FROM sig0 s JOIN cz USING (signal_id) {gate}),
vr AS (SELECT signal_id, x.l - lag(x.l) OVER o AS ra, y.l - lag(y.l) OVER o AS rb FROM sig s {legs.format("signal_bar - 59", "s.signal_bar")} WINDOW o AS (PARTITION BY signal_id ORDER BY x.bar_idx)),
vv AS (SELECT signal_id, 1 / stddev_pop(ra) AS va, 1 / stddev_pop(rb) AS vb FROM vr GROUP BY 1),
al AS (SELECT s.*, coalesce(d1, va / (va + abs(h) * vb) * 100000) AS alloc_a, coalesce(d2, abs(h) * vb / (va + abs(h) * vb) * 100000) AS alloc_b,
    greatest(0, signal_bar - 70) AS base, signal_bar - greatest(0, signal_bar - 70) AS n, greatest(1, round_even(half_life * 3, 0))::BIGINT AS hold FROM sig s JOIN vv USING (signal_id)),
mr AS (SELECT signal_id, n, hold, x.bar_idx - base AS i, alloc_a * (x.l - lag(x.l) OVER o) - alloc_b * (y.l - lag(y.l) OVER o) AS pnl FROM al s {legs.format("base", "s.signal_bar")} WINDOW o AS (PARTITION BY signal_id ORDER BY x.bar_idx)),
mc AS (SELECT signal_id, k.start, sum(pnl) OVER (PARTITION BY signal_id, k.start ORDER BY i) AS cum FROM mr, (SELECT unnest(range(1, 71)) AS start) k WHERE n >= 2 AND k.start <= n - hold + 1 AND i BETWEEN k.start AND k.start + hold - 1),
ma AS (SELECT signal_id, quantile_cont(greatest(0.0::DOUBLE, -worst), 0.95) AS mae FROM (SELECT signal_id, start, min(cum) AS worst FROM mc GROUP BY 1, 2) GROUP BY 1),
sc AS (SELECT al.* REPLACE (alloc_a * f AS alloc_a, alloc_b * f AS alloc_b), (alloc_a + alloc_b) * f * {p.commission} AS est_comm FROM (SELECT al.*, CASE WHEN mae > {p.capital * p.risk_share} THEN {p.capital * p.risk_share} / mae ELSE 1.0 END AS f FROM al LEFT JOIN ma USING (signal_id)) al),
fl AS (SELECT s.*, x.ts AS entry_time, exec_idx AS entry_idx, x.close * (1 + side * {p.slippage}) AS pa, y.close * (1 - side * {p.slippage}) AS pb, s.alloc_a / pa * side AS qa, -s.alloc_b / pb * side AS qb,
    (abs(pa * qa) + abs(pb * qb)) * {p.commission} AS entry_comm FROM sc s JOIN px x ON x.symbol = s.a AND x.bar_idx = s.exec_idx JOIN px y ON y.symbol = s.b AND y.bar_idx = s.exec_idx),
pr AS (SELECT signal_id, entry_idx, entry_z, x.bar_idx, x.l - h * y.l AS s FROM fl s {legs.format("entry_idx - 199", "s.last_bar")}),
pz AS (SELECT *, CASE WHEN count(s) OVER o >= 10 AND stddev_samp(s) OVER o > 0 THEN (s - avg(s) OVER o) / stddev_samp(s) OVER o END AS z FROM pr WINDOW o AS (PARTITION BY signal_id ORDER BY bar_idx ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
er AS (SELECT *, CASE WHEN z IS NULL THEN NULL WHEN entry_z * z < 0 OR abs(z) <= {p.z_exit} THEN 'mean_revert' WHEN abs(z) >= {p.z_stop} AND z * entry_z > 0 THEN 'stop_loss' WHEN (bar_idx - entry_idx) / 24.0 >= {p.max_hold_days} THEN 'time_exit' END AS reason FROM pz WHERE bar_idx >= entry_idx),
ex AS (SELECT signal_id, min(bar_idx) AS exit_bar, arg_min(reason, bar_idx) AS exit_reason FROM er WHERE reason IS NOT NULL GROUP BY 1),
cl AS (SELECT signal_id, exit_bar, least(exit_bar + 1, last_bar) AS exit_idx, exit_reason, x.ts AS exit_time, x.close * CASE WHEN qa > 0 THEN 1 - {p.slippage} ELSE 1 + {p.slippage} END AS xa, y.close * CASE WHEN qb > 0 THEN 1 - {p.slippage} ELSE 1 + {p.slippage} END AS xb,
    (xa - pa) * qa + (xb - pb) * qb AS pnl_gross, (abs(xa * qa) + abs(xb * qb)) * {p.commission} AS exit_comm, pnl_gross - entry_comm - exit_comm AS pnl_net FROM fl JOIN ex USING (signal_id)
    JOIN px x ON x.symbol = fl.a AND x.bar_idx = least(exit_bar + 1, last_bar) JOIN px y ON y.symbol = fl.b AND y.bar_idx = x.bar_idx),
tr AS (SELECT fl.*, cl.* EXCLUDE (signal_id), exit_idx - entry_idx AS hold_hours FROM fl LEFT JOIN cl USING (signal_id))"""


_CURVE = """,
cash AS (SELECT d.ts, d.bar_idx, coalesce(paid, 0) AS paid, coalesce(gained, 0) AS gained, coalesce(est, 0) AS est, u, n_open FROM dates d
    LEFT JOIN (SELECT entry_idx AS bar_idx, sum(entry_comm) AS paid FROM tr GROUP BY 1) USING (bar_idx) LEFT JOIN (SELECT exit_bar AS bar_idx, sum(pnl_gross - exit_comm) AS gained FROM tr WHERE exit_bar IS NOT NULL GROUP BY 1) USING (bar_idx)
    LEFT JOIN (SELECT signal_bar AS bar_idx, sum(est_comm) AS est FROM sc GROUP BY 1) USING (bar_idx)
    LEFT JOIN (SELECT x.bar_idx, sum((x.close - pa) * qa + (y.close - pb) * qb) AS u, count(*) AS n_open FROM tr s JOIN px x ON x.symbol = s.a AND x.bar_idx BETWEEN entry_idx AND coalesce(exit_bar, last_bar) JOIN px y ON y.symbol = s.b AND y.bar_idx = x.bar_idx GROUP BY 1) USING (bar_idx)),
eq AS (SELECT ts, bar_idx, 1e6::DOUBLE + coalesce(sum(gained) OVER (ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - sum(paid) OVER (ORDER BY bar_idx) + coalesce(u, 0) AS equity FROM cash),
mk AS (SELECT ts, market, ln(market) - ln(lag(market) OVER (ORDER BY ts)) AS market_ret FROM (SELECT ts, avg(close) AS market FROM px GROUP BY 1))"""
_TRADE_SQL = "SELECT signal_id, pair, side, entry_idx, exit_idx::DOUBLE AS exit_idx, exit_reason, hold_hours::DOUBLE AS hold_hours, round(pnl_gross, 2) AS pnl_gross, round(pnl_net, 2) AS pnl_net, round(exit_comm, 2) AS exit_comm FROM tr"
_EG = _STATS + f""",
ru AS (SELECT *, la - regr_intercept(la, lb) OVER w - regr_slope(la, lb) OVER w * lb AS u FROM p WINDOW w AS (PARTITION BY a, b, window_id)),
rd AS (SELECT *, lag(u) OVER o AS u1, u - lag(u) OVER o AS du FROM ru WINDOW o AS (PARTITION BY a, b, window_id ORDER BY bar_idx)),
rg AS (SELECT a, b, window_id, count(*) AS n, count(du) AS m, sum(u1 * du) AS xy, sum(u1 * u1) AS xx, sum(du * du) AS yy FROM rd GROUP BY ALL),
eg AS (SELECT *, xy / xx * sqrt(xx) / sqrt((yy - xy * xy / xx) / (m - 1)) AS t, -3.33613::DOUBLE - 6.1101::DOUBLE / (n - 1) - 6.823::DOUBLE / ((n - 1) * (n - 1)) AS crit5 FROM rg)"""


def _summary(name: str, p: BacktestParams) -> str:
    return f"SELECT * FROM (WITH {_book(p)} SELECT '{name}' AS param_id, count(*) AS n_trades, count(pnl_net) AS n_closed, round(avg((pnl_net > 0)::INT), 2) AS win_rate, round(sum(pnl_net), 2) AS net FROM tr)"


#: Standard normal distribution function (Abramowitz and Stegun 26.2.17) of the small-tail polynomial in t.
_TAIL = "exp(-y * y / 2) * 0.3989422804014327 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))"

SQL |= {
    "cointegrated_scan": f"""WITH {_EG}, y AS (SELECT *, 2.92::DOUBLE + 1.5012::DOUBLE * t + 0.039796::DOUBLE * t * t AS y FROM st JOIN eg USING (a, b, window_id) WHERE t < crit5), k AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(y)) AS k FROM y)
        SELECT a || '-' || b AS pair, window_id, (CASE WHEN z >= 0.5 THEN -1 ELSE 1 END)::INTEGER AS signal, round(CASE WHEN t <= -18.86 THEN 0 ELSE {_TAIL} END, 5) AS p_value FROM k WHERE half_life > 0 AND half_life <= 200 AND abs(beta) < 0.11 AND abs(z) >= 0.5""",
    "engle_granger_lag0": f"WITH {_EG} SELECT a, b, window_id, n, round(t, 5) AS t, round(crit5, 5) AS crit5 FROM eg",
    "coint_transitions": f"""WITH {_EG}, f AS (SELECT a, b, window_id, t < crit5 AS coint FROM eg), g AS (SELECT *, lag(coint) OVER o AS before, coalesce(bool_or(coint) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ever FROM f WINDOW o AS (PARTITION BY a, b ORDER BY window_id))
        SELECT * FROM (SELECT a, b, window_id, coint, CASE WHEN coint AND NOT ever THEN 'start' WHEN coint AND NOT before THEN 'return' WHEN NOT coint AND before THEN 'break' END AS change FROM g) WHERE change IS NOT NULL""",
    "pair_corr": f"WITH {_STATS} SELECT a, b, window_id, round(corr(da, db), 6) AS corr FROM r GROUP BY ALL",
    "hurst": f"WITH {_WALK}, k AS (SELECT symbol, lag_k, stddev_samp(y.logp - x.logp) AS sd FROM walk x JOIN walk y USING (symbol), (SELECT unnest([2, 4, 8, 16, 32]) AS lag_k) WHERE y.bar_idx = x.bar_idx + lag_k GROUP BY 1, 2) SELECT symbol, round(regr_slope(ln(sd), ln(lag_k)), 6) AS hurst FROM k WHERE sd > 0 GROUP BY 1",
    "map_signals": f"WITH {_book()}, tm AS (SELECT signal_id, d.ts + to_hours(window_id) + to_minutes(20) AS at FROM sig0 JOIN dates d ON d.bar_idx = signal_bar), mp AS (SELECT signal_id, d.bar_idx AS signal_bar, d.bar_idx + 1 AS exec_idx FROM tm ASOF JOIN dates d ON tm.at >= d.ts) SELECT mp.* FROM mp, lastbar WHERE signal_bar < last_bar",
    "allocations": f"WITH {_book()} SELECT signal_id, a, b, side, round(alloc_a, 2) AS alloc_a, round(alloc_b, 2) AS alloc_b FROM al",
    "mae95": f"WITH {_book()} SELECT signal_id, round(mae, 4) AS mae FROM ma",
    "entry_fills": f"WITH {_book()} SELECT signal_id, entry_idx, round(pa, 4) AS entry_price_a, round(pb, 4) AS entry_price_b, round(qa, 4) AS qty_a, round(qb, 4) AS qty_b, round(entry_comm, 4) AS entry_comm FROM fl",
    "trades": f"WITH {_book()} {_TRADE_SQL}",
    "trades_gated": f"WITH {_book(GATED)} {_TRADE_SQL}",
    "cash_audit": f"""WITH {_book()}{_CURVE}, fr AS (SELECT bar_idx AS signal_bar, 1e6::DOUBLE + coalesce(sum(gained - paid) OVER (ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - coalesce(lag(est) OVER (ORDER BY bar_idx), 0) AS bar FROM cash)
        SELECT signal_id, signal_bar, round(est_comm, 2) AS est_comm, round(free, 2) AS free, est_comm > free + 1e-12 AS short FROM (SELECT *, bar - coalesce(sum(est_comm) OVER (PARTITION BY signal_bar ORDER BY signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM sc JOIN fr USING (signal_bar))""",
    "ledger": f"""WITH {_book()} SELECT strftime(entry_time, '%Y-%m-%d %H:%M:%S') AS time, pair, 'entry_comm' AS type, round(-entry_comm, 2) AS cash_change FROM tr
        UNION ALL SELECT strftime(exit_time, '%Y-%m-%d %H:%M:%S'), pair, 'exit', round(pnl_gross - exit_comm, 2) FROM tr WHERE exit_idx IS NOT NULL""",
    "unrealised": f"WITH {_book()}{_CURVE} SELECT bar_idx, round(u, 2) AS unrealised, n_open FROM cash WHERE u IS NOT NULL",
    "backtest_equity": f"WITH {_book()}{_CURVE} SELECT bar_idx, round(equity, 2) AS equity FROM eq",
    "market_index": f"WITH {_book()}{_CURVE} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(market, 8) AS market, round(market_ret, 8) AS market_ret FROM mk",
    "backtest_metrics": f"""WITH {_book()}{_CURVE}, d AS (SELECT ts, equity, equity / max(equity) OVER (ORDER BY ts) - 1 AS dd, equity / lag(equity) OVER (ORDER BY ts) - 1 AS ret, ln(equity) - ln(lag(equity) OVER (ORDER BY ts)) AS lr FROM eq),
        o AS (SELECT arg_min(equity, ts) AS e0, arg_max(equity, ts) AS e1, (epoch(max(ts)) - epoch(min(ts))) / (365.0::DOUBLE * 86400) AS y, min(dd) AS mdd, avg(ret) * sqrt(8760::DOUBLE) / stddev_pop(ret) AS sharpe FROM d),
        m AS (SELECT *, pow(e1 / e0, 1 / y) - 1 AS cagr FROM o)
        SELECT 'cagr' AS metric, round(cagr, 4) AS value FROM m UNION ALL SELECT 'mdd', round(mdd, 4) FROM m UNION ALL SELECT 'cagr_mdd', round(cagr / abs(mdd), 4) FROM m UNION ALL SELECT 'sharpe', round(sharpe, 4) FROM m UNION ALL SELECT 'final_equity', round(e1, 4) FROM m
        UNION ALL SELECT 'total_trades', count(pnl_net)::DOUBLE FROM tr UNION ALL SELECT 'win_rate', round(avg((pnl_net > 0)::INT), 4) FROM tr
        UNION ALL SELECT 'beta', round(covar_samp(lr, market_ret) / var_pop(market_ret), 4) FROM d JOIN mk USING (ts) WHERE lr IS NOT NULL AND market_ret IS NOT NULL""",
    "compare_presets": _summary("own_z", TRADING) + " UNION ALL " + _summary("gated", GATED),
    "sweep": " UNION ALL ".join(_summary(n, p) for n, p in sweep(TRADING, z_stop=(2.0, 4.0), z_exit=(0.0, 0.5)).items()),
    "portfolio_exposure": f"WITH {_book()} SELECT x.bar_idx, round(sum((alloc_a + alloc_b) / 1e6 * beta), 6) AS net_beta FROM tr s JOIN px x ON x.symbol = s.a AND x.bar_idx BETWEEN entry_idx AND coalesce(exit_bar, last_bar) GROUP BY 1",
}

_SIGNALS = "SELECT pair, window_id, signal, z FROM (" + SQL["pair_scan"] + ")"
SQL |= {
    "resumed_scan": _SIGNALS,
    "capped_scan": _SIGNALS + " WHERE window_id < 5",
    "bars_file": SQL["bars_from_events"],
    "signals_file": f"""WITH {_BARS}, o AS (SELECT bar_idx, bar_idx % 10 AS k, ts + CASE WHEN bar_idx % 10 = 7 THEN INTERVAL 400 DAY ELSE INTERVAL 0 DAY END AS moment FROM grid WHERE symbol = 'S01')
        SELECT 'x#' || bar_idx AS signal_id, CASE k WHEN 1 THEN 'S01' WHEN 3 THEN 'S01-S02-S03' WHEN 5 THEN 'S01-S99' ELSE 'S01-S02' END AS pair,
        CASE WHEN k <> 9 THEN strftime(moment, '%Y-%m-%d %H:%M:%S') END AS signal_time, CASE WHEN k <> 3 THEN k::DOUBLE END AS hedge_ratio, 0.5::DOUBLE AS beta FROM o""",
    "trades_file": f"WITH {_TRADES} SELECT l_orderkey, l_linenumber, pair, pnl_net, exit_reason FROM trades",
    "report_files": SQL["backtest_metrics"],
    "trade_profile": "WITH a AS (" + SQL["trade_summary"] + "), e AS (" + SQL["by_exit_reason"] + "), c AS (" + SQL["commission_profile"] + ") "
    + " UNION ALL ".join(f"SELECT '{n}' AS section, {'exit_reason' if n == 'exit_reason' else chr(39) * 2} AS exit_reason, '{m}' AS metric, {m}::DOUBLE AS value FROM {n[0]}" for n, ms in P.PROFILE.items() for m in ms),
}

#: The scan and all queries on its signals once more, over pairs that pass the cointegration test, in the lag-0 form that SQL has.
TESTED = ["pair_scan", "map_signals", "allocations", "mae95", "entry_fills", "trades", "trades_gated", "cash_audit", "ledger", "unrealised", "backtest_equity", "backtest_metrics", "compare_presets", "sweep", "portfolio_exposure"]


def _tested(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        was = _PARAMS.set(replace(PARAMS, cointegration="lag0"))
        try:
            return query(spark, d)
        finally:
            _PARAMS.reset(was)

    return run


def _tested_sql(sql: str) -> str:
    """The flag's p below 0.05 needs no term of its own: it holds for t below -3.3357, and crit5 is lower at every length."""
    joined = "FROM st JOIN eg USING (a, b, window_id) WHERE t < crit5"
    return sql.replace(_STATS, _EG).replace("FROM st WHERE ", f"{joined} AND ").replace("FROM st)", f"{joined})")


#: Settled before the queries that read them are timed.
SHARED = {"shared_backtest": settle_backtest, "shared_cointegrated_backtest": _tested(settle_backtest)}
QUERIES |= {f"cointegrated_{n}": _tested(QUERIES[n]) for n in TESTED}
SQL |= {f"cointegrated_{n}": _tested_sql(SQL[n]) for n in TESTED}

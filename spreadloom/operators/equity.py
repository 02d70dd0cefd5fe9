"""Cash, equity and metrics of a trade table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.numeric import ratio
from spreadloom.operators import profile
from spreadloom.operators.chunks import Carry, bar_chunk, carried, time_chunk, with_halo
from spreadloom.operators.trades import leg_rows
from spreadloom.params import BacktestParams


def cash_by_bar(trades: DataFrame, dates: DataFrame) -> DataFrame:
    """ts, bar_idx, paid (entry commissions at the entry bar), gained (exits, less their commission, at the trigger bar)."""
    paid = trades.groupBy(F.col("entry_idx").alias("bar_idx")).agg(F.sum("entry_comm").alias("paid"))
    gained = trades.filter("exit_bar is not null").groupBy(F.col("exit_bar").alias("bar_idx")).agg(F.sum(F.col("pnl_gross") - F.col("exit_comm")).alias("gained"))
    return dates.join(paid, "bar_idx", "left").join(gained, "bar_idx", "left").fillna(0.0, ["paid", "gained"])


def cash_audit(scaled: DataFrame, trades: DataFrame, dates: DataFrame, p: BacktestParams) -> DataFrame:
    """free cash before each signal of a bar, in order of signal_id, and whether its estimated commission exceeds it.

    Signals are summed within their bar, bars before them by runs of bars.
    """
    est = scaled.groupBy(F.col("signal_bar").alias("bar_idx")).agg(F.sum("est_comm").alias("est"))
    bars = cash_by_bar(trades, dates).join(est, "bar_idx", "left").fillna(0.0, ["est"])
    bars = carried(bars, "bar_idx", bar_chunk(), {"_before": Carry("sum", F.col("gained") - F.col("paid"), True), "_lag": Carry("lag", F.col("est"))})
    held = bars.select(F.col("bar_idx").alias("signal_bar"), (F.lit(p.capital) + F.coalesce("_before", F.lit(0.0)) - F.coalesce("_lag", F.lit(0.0))).alias("_bar"))
    inner = Window.partitionBy("signal_bar").orderBy("signal_id").rowsBetween(Window.unboundedPreceding, -1)
    x = scaled.withColumn("_own", F.coalesce(F.sum("est_comm").over(inner), F.lit(0.0))).join(held, "signal_bar")
    x = x.withColumn("free", F.col("_bar") - F.col("_own"))
    return x.select("signal_id", "signal_bar", "est_comm", "free", (F.col("est_comm") > F.col("free") + 1e-12).alias("short"))


def ledger(allocated: DataFrame, trades: DataFrame, dates: DataFrame, full: bool = False) -> DataFrame:
    """time, pair, type, cash_change, note: skipped signals, entry commissions and, with `full`, exits."""
    time = dates.select(F.col("bar_idx").alias("signal_bar"), F.col("ts").alias("time"))
    note = F.when(F.col("alloc_a").isNull() | F.col("alloc_b").isNull(), "null_alloc").otherwise("zero_alloc")
    skipped = allocated.filter("alloc_a is null or alloc_b is null or abs(alloc_a) + abs(alloc_b) <= 0").join(time, "signal_bar").select("time", "pair", F.lit("skip").alias("type"), F.lit(0.0).alias("cash_change"), note.alias("note"))
    entries = trades.select(F.col("entry_time").alias("time"), "pair", F.lit("entry_comm").alias("type"), (-F.col("entry_comm")).alias("cash_change"), F.format_string("entry pa=%.6f, pb=%.6f", "entry_price_a", "entry_price_b").alias("note"))
    out = skipped.unionByName(entries)
    if full:
        out = out.unionByName(trades.filter("exit_idx is not null").select(F.col("exit_time").alias("time"), "pair", F.lit("exit").alias("type"), (F.col("pnl_gross") - F.col("exit_comm")).alias("cash_change"), F.col("exit_reason").alias("note")))
    return out


def open_positions(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """A row per position and bar while it is held, entry and trigger bar included, with its mark at the closes."""
    last = F.coalesce("exit_bar", "last_bar")
    rows = leg_rows(trades, prices, F.col("entry_idx"), last, "qty_a", "qty_b", "entry_price_a", "entry_price_b", "alloc_a", "alloc_b")
    mark = (F.col("ca") - F.col("entry_price_a")) * F.col("qty_a") + (F.col("cb") - F.col("entry_price_b")) * F.col("qty_b")
    return rows.select("signal_id", "bar_idx", "alloc_a", "alloc_b", mark.alias("mark"))


def unrealised(trades: DataFrame, prices: DataFrame) -> DataFrame:
    return open_positions(trades, prices).groupBy("bar_idx").agg(F.sum("mark").alias("unrealised"), F.count("*").alias("n_open"))


def equity_curve(trades: DataFrame, prices: DataFrame, dates: DataFrame, p: BacktestParams) -> DataFrame:
    """ts, bar_idx, equity: capital, less commissions up to the bar, plus exits triggered before it, plus open marks."""
    bars = carried(cash_by_bar(trades, dates), "bar_idx", bar_chunk(), {"_gained": Carry("sum", F.col("gained"), True), "_paid": Carry("sum", F.col("paid"))})
    bars = bars.join(unrealised(trades, prices), "bar_idx", "left")
    return bars.select("ts", "bar_idx", (F.lit(p.capital) + F.coalesce("_gained", F.lit(0.0)) - F.col("_paid") + F.coalesce("unrealised", F.lit(0.0))).alias("equity"))


def market_index(prices: DataFrame, kind: str = "mean_price") -> DataFrame:
    """ts, market and its log return: the mean close of all symbols, or with `equal_return` an index from 1 whose return is
    the mean of the symbols' returns, so that dear symbols weigh no more than cheap ones. Scanned by stretches
    of time; the latter needs the bar index of a filled grid."""
    chunk = time_chunk()
    if kind == "mean_price":
        m = prices.groupBy("ts").agg(F.avg("close").alias("market"))
        m = carried(m, "ts", chunk, {"_lag": Carry("lag", F.col("market"))})
        return m.select("ts", "market", (F.log("market") - F.log("_lag")).alias("market_ret"))
    if kind != "equal_return":
        raise ValueError(f"unknown index {kind}")
    before = F.lag("close").over(Window.partitionBy("symbol", "_part").orderBy("bar_idx"))
    own = with_halo(prices, 2, "bar_idx").withColumn("_ret", F.try_divide("close", before) - 1).filter("_own")
    step = F.log(1 + F.coalesce("_mean", F.lit(0.0)))
    m = own.groupBy("ts").agg(F.avg("_ret").alias("_mean"))
    m = carried(m, "ts", chunk, {"_growth": Carry("sum", step), "_n": Carry("count", F.lit(1), True)})
    return m.select("ts", F.exp("_growth").alias("market"), F.when(F.col("_n") > 0, step).alias("market_ret"))


def portfolio_beta(equity: DataFrame, market: DataFrame) -> DataFrame:
    r = carried(equity.select("ts", "equity"), "ts", time_chunk(), {"_lag": Carry("lag", F.col("equity"))}).select("ts", (F.log("equity") - F.log("_lag")).alias("ret"))
    j = r.join(market, "ts").filter("ret is not null and market_ret is not null")
    return j.agg(F.when(F.count("*") >= 2, ratio(F.covar_samp("ret", "market_ret"), F.var_pop("market_ret"))).alias("beta"))


def trade_counts(trades: DataFrame) -> DataFrame:
    """total_trades (closed ones) and the share of them that won."""
    t = trades.filter("pnl_net is not null")
    return t.agg(F.count("*").cast("double").alias("total_trades"), F.avg((F.col("pnl_net") > 0).cast("double")).alias("win_rate"))


def report(trades: DataFrame, equity: DataFrame, prices: DataFrame, periods: float = 8760.0) -> DataFrame:
    """The eight metrics as rows (metric, value)."""
    counts = trade_counts(trades).crossJoin(portfolio_beta(equity, market_index(prices)))
    return profile.metrics(equity, periods).unionByName(counts.unpivot([], ["total_trades", "win_rate", "beta"], "metric", "value"))


def portfolio_exposure(trades: DataFrame, prices: DataFrame, p: BacktestParams) -> DataFrame:
    """bar_idx, net_beta: allocation over capital times the signal's pair beta, summed over open positions."""
    betas = trades.select("signal_id", F.col("beta").alias("pair_beta"))
    x = open_positions(trades, prices).join(betas, "signal_id")
    return x.groupBy("bar_idx").agg(F.sum((F.abs("alloc_a") + F.abs("alloc_b")) / p.capital * F.coalesce("pair_beta", F.lit(0.0))).alias("net_beta"))

"""Trade-log profile and equity metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.numeric import ratio
from spreadloom.operators.chunks import Carry, carried, time_chunk


def trade_flags(trades: DataFrame) -> DataFrame:
    """win, gross_is_zero and comm_ratio (null instead of infinity where gross is 0; gross_is_zero tells the two apart)."""
    return trades.withColumn("win", F.coalesce(F.col("pnl_net") > 0, F.lit(False))).withColumn("gross_is_zero", F.coalesce(F.col("pnl_gross") == 0, F.lit(False))).withColumn("comm_ratio", ratio(F.col("commission_total"), F.abs("pnl_gross")))


def _pct(c: Column) -> Column:
    return F.avg(c.cast("double")) * 100


def exact_quantile(rows: DataFrame, value: str, q: float, out: str, *by: str) -> DataFrame:
    """(by..., out): the exact quantile, interpolated between ranks, of each group's values that are not null; without `by`
    one row, null where there are none.

    No group is gathered: values are counted by range, a fixed monotone function of the value, and only the one or two
    ranges that hold the wanted ranks are counted value by value.
    """
    x = rows.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null").withColumn("_range", _range())
    return _from_ranges(x, x.groupBy(*by, "_range").agg(F.count("*").alias("_n")), q, out, *by)


def _range() -> Column:
    return (F.signum("_v") * F.floor(F.log1p(F.abs("_v") * 1e6) * 256)).cast("long")


def _from_ranges(x: DataFrame, ranges: DataFrame, q: float, out: str, *by: str) -> DataFrame:
    """exact_quantile() of x (by..., _range, _v), given how many rows are in each range."""
    keys = [F.col(c) for c in by]
    running = lambda order: F.sum("_n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.withColumn("_to", running("_range"))
    ranges = ranges.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    place = F.lit(q) * (F.col("_all") - 1)
    low, high = F.floor(place), F.ceil(place)
    holds = lambda r: (F.col("_to") > r) & (F.col("_to") - F.col("_n") <= r)
    wanted = ranges.filter(holds(low) | holds(high)).select(*keys, "_range", (F.col("_to") - F.col("_n")).alias("_base"), "_all")
    counts = x.join(wanted, [*by, "_range"]).groupBy(*keys, "_range", "_base", "_all", "_v").agg(F.count("*").alias("_n"))
    inner = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_to", F.col("_base") + inner)
    both = counts.groupBy(*keys).agg(F.min(F.when(holds(low), F.col("_v"))).alias("_lo"), F.min(F.when(holds(high), F.col("_v"))).alias("_hi"), F.first(place - low).alias("_part"))
    return both.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(out))


def trade_summary(trades: DataFrame) -> DataFrame:
    t = trade_flags(trades)
    median = exact_quantile(t, "pnl_net", 0.5, "median_net")
    one = t.agg(F.count("*").alias("n_trades"), _pct(F.col("win")).alias("win_pct"), F.sum("pnl_net").alias("total_net"), F.avg("pnl_net").alias("mean_net"), F.sum("commission_total").alias("total_commission"), ratio(F.sum(F.when(F.col("pnl_net") > 0, F.col("pnl_net"))), F.abs(F.sum(F.when(F.col("pnl_net") < 0, F.col("pnl_net"))))).alias("profit_factor"))
    return one.crossJoin(median)  # one row each


def by_exit_reason(trades: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per exit reason; with `ordered` in order of total profit, best first."""
    t = trade_flags(trades).filter("exit_reason is not null")
    out = t.groupBy("exit_reason").agg(F.count("*").alias("n_trades"), _pct(F.col("win")).alias("win_pct"), F.avg("pnl_net").alias("mean_net"), F.sum("pnl_net").alias("total_net"), F.avg("hold_hours").alias("mean_hold"), F.avg("commission_total").alias("mean_commission"))
    out = out.join(exact_quantile(t, "pnl_net", 0.5, "median_net", "exit_reason"), "exit_reason", "left")
    return out.orderBy(F.col("total_net").desc_nulls_last(), "exit_reason") if ordered else out


def commission_profile(trades: DataFrame) -> DataFrame:
    t = trade_flags(trades)
    small = F.coalesce(F.abs("pnl_gross") < 1, F.lit(False))
    over = F.col("gross_is_zero") | F.coalesce(F.col("comm_ratio") > 1, F.lit(False))
    return t.agg(_pct(small).alias("small_gross_pct"), _pct(over).alias("ratio_over_one_pct")).crossJoin(exact_quantile(t, "comm_ratio", 0.5, "median_ratio"))


#: What trade_profile() gives of each section.
PROFILE = {
    "all": ("n_trades", "win_pct", "total_net", "mean_net", "median_net", "total_commission", "profit_factor"),
    "exit_reason": ("n_trades", "win_pct", "mean_net", "median_net", "total_net", "mean_hold", "mean_commission"),
    "commission": ("small_gross_pct", "ratio_over_one_pct", "median_ratio"),
}


def trade_profile(trades: DataFrame) -> DataFrame:
    """(section, exit_reason, metric, value): trade_summary(), by_exit_reason() and commission_profile() in two scans.

    One scan sums and counts every section's rows by range of the value whose median is wanted; sums of ranges give the
    totals, and a second scan counts values inside the ranges that hold the medians. An empty table gives no rows.
    """
    section = lambda name, key, v: F.struct(F.lit(name).alias("section"), key.alias("exit_reason"), F.col(v).cast("double").alias("_v"))
    t = trade_flags(trades).withColumnRenamed("exit_reason", "_reason")
    t = t.withColumn("_part", F.explode(F.array(section("all", F.lit(""), "pnl_net"), section("exit_reason", F.col("_reason"), "pnl_net"), section("commission", F.lit(""), "comm_ratio"))))
    x = t.select("*", "_part.*").drop("_part").filter("exit_reason is not null").withColumn("_range", _range())
    over = F.col("gross_is_zero") | F.coalesce(F.col("comm_ratio") > 1, F.lit(False))
    sums = {"won": F.count_if("win"), "net": F.sum("pnl_net"), "nets": F.count("pnl_net"), "gain": F.sum(F.when(F.col("pnl_net") > 0, F.col("pnl_net"))), "loss": F.sum(F.when(F.col("pnl_net") < 0, F.col("pnl_net")))}
    sums |= {"fee": F.sum("commission_total"), "fees": F.count("commission_total"), "hold": F.sum("hold_hours"), "holds": F.count("hold_hours")}
    sums |= {"small": F.count_if(F.coalesce(F.abs("pnl_gross") < 1, F.lit(False))), "over": F.count_if(over)}
    by = ["section", "exit_reason"]
    ranges = x.groupBy(*by, "_range").agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in sums.items()])
    total = ranges.groupBy(*by).agg(F.sum("_n").alias("n"), *[F.sum(n).alias(n) for n in sums])
    middle = _from_ranges(x.filter("_v is not null"), ranges.filter("_range is not null").select(*by, "_range", "_n"), 0.5, "median", *by)
    pct = lambda c: ratio(F.col(c) * 100, F.col("n"))
    values = {
        "n_trades": F.col("n").cast("double"), "win_pct": pct("won"), "total_net": F.col("net"), "mean_net": ratio(F.col("net"), F.col("nets")), "median_net": F.col("median"), "total_commission": F.col("fee"),
        "profit_factor": ratio(F.col("gain"), F.abs("loss")), "mean_hold": ratio(F.col("hold"), F.col("holds")), "mean_commission": ratio(F.col("fee"), F.col("fees")),
        "small_gross_pct": pct("small"), "ratio_over_one_pct": pct("over"), "median_ratio": F.col("median"),
    }
    wide = total.join(middle, by, "left").select(*by, *[v.alias(n) for n, v in values.items()])
    asked = F.lit(False)
    for name, metrics_ in PROFILE.items():
        asked |= (F.col("section") == name) & F.col("metric").isin(*metrics_)
    return wide.unpivot(by, list(values), "metric", "value").filter(asked)


def hold_pnl_corr(trades: DataFrame) -> DataFrame:
    return trades.filter("hold_hours is not null and pnl_net is not null").agg(F.corr("hold_hours", "pnl_net").alias("corr"))


def worst_trades(trades: DataFrame, n: int, *ties: str) -> DataFrame:
    return trades.orderBy(F.col("pnl_net").asc_nulls_last(), *ties).limit(n)


def equity_from_events(events: DataFrame, capital: float) -> DataFrame:
    """Equity by ts of cash events (ts, cash): summed by ts first, then by stretches of time."""
    daily = events.filter("cash is not null").groupBy("ts").agg(F.sum("cash").alias("cash"))
    return carried(daily, "ts", time_chunk(), {"_sum": Carry("sum", F.col("cash"))}).select("ts", (F.lit(capital) + F.col("_sum")).alias("equity"))


def drawdown(equity: DataFrame) -> DataFrame:
    """drawdown: equity over its highest value so far, less 1."""
    x = carried(equity, "ts", time_chunk(), {"_peak": Carry("max", F.col("equity"))})
    return x.withColumn("drawdown", F.col("equity") / F.col("_peak") - 1).drop("_peak")


def metrics(equity: DataFrame, periods: float = 8760.0) -> DataFrame:
    """cagr, mdd, cagr_mdd, sharpe, final_equity as rows (metric, value)."""
    d = carried(equity, "ts", time_chunk(), {"_peak": Carry("max", F.col("equity")), "_lag": Carry("lag", F.col("equity"))})
    d = d.withColumn("drawdown", F.col("equity") / F.col("_peak") - 1).withColumn("ret", F.try_divide("equity", "_lag") - 1)
    one = d.agg(F.min_by("equity", "ts").alias("e0"), F.max_by("equity", "ts").alias("e1"), ((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / (365.0 * 86400)).alias("years"), F.min("drawdown").alias("mdd"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"))
    one = one.withColumn("cagr", F.when(F.col("years") > 0, F.pow(F.try_divide("e1", "e0"), F.try_divide(F.lit(1.0), F.col("years"))) - 1))
    one = one.withColumn("sharpe", F.when(F.col("std") > 0, F.col("mean") * periods / (F.col("std") * F.sqrt(F.lit(periods))))).withColumn("cagr_mdd", F.when(F.col("mdd") < 0, F.col("cagr") / F.abs("mdd"))).withColumn("final_equity", F.col("e1"))
    return one.unpivot([], ["cagr", "mdd", "cagr_mdd", "sharpe", "final_equity"], "metric", "value")

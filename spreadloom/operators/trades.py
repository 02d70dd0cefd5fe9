"""Signals to trades as relations: one row per signal, keyed by signal_id, and prices (symbol, bar_idx, ts, close, perhaps open)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.numeric import null_if_nan, ratio
from spreadloom.operators.paths import leg_arrays, moments, rolling_z, steps
from spreadloom.params import BacktestParams
from spreadloom.session import settle


def _maybe(df: DataFrame, *names: str, kind: str = "double") -> Column:
    """The first of these columns that the table has, else a typed null."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None).cast(kind))


def _number(df: DataFrame, *names: str) -> Column:
    return null_if_nan(_maybe(df, *names).try_cast("double"))


def map_signals(signals: DataFrame, dates: DataFrame) -> DataFrame:
    """signal_bar of each signal_time: its bar, else the one before, else bar 0; exec_idx is the next bar. Signals without a
    time or a next bar go.

    The as-of step runs over the distinct times, day by day with the last bar of the days before carried in, so that no
    partition holds more than a day's times.
    """
    times = signals.select(F.col("signal_time").alias("at")).filter("at is not null").distinct()
    both = dates.select(F.col("ts").alias("at"), "bar_idx").unionByName(times.withColumn("bar_idx", F.lit(None).cast("long")))
    both = both.withColumn("day", F.to_date("at"))
    days = both.groupBy("day").agg(F.max("bar_idx").alias("top"))
    carry = days.select("day", F.max("top").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    seen = F.max("bar_idx").over(Window.partitionBy("day").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    asof = both.withColumn("seen", seen).join(carry, "day").filter("bar_idx is null").select(F.col("at").alias("signal_time"), F.coalesce("seen", "carry", F.lit(0)).alias("signal_bar"))
    last = dates.agg(F.max("bar_idx").alias("last_bar"))
    return signals.join(asof, "signal_time").crossJoin(F.broadcast(last)).filter("signal_bar < last_bar").withColumn("exec_idx", F.col("signal_bar") + 1)


def split_pair(signals: DataFrame, symbols: DataFrame) -> DataFrame:
    """Legs a and b of `a-b`; rows with another number of dashes, or an unknown symbol, go."""
    legs = F.split("pair", "-")
    x = signals.filter(F.size(legs) == 2).withColumn("a", legs[0]).withColumn("b", legs[1])
    for leg in ("a", "b"):
        x = x.join(symbols.select(F.col("symbol").alias(leg)).distinct(), leg, "left_semi")
    return x


def rejected_signals(signals: DataFrame, prices: DataFrame) -> DataFrame:
    """Signals that map_signals and split_pair leave out, with the reason: bad_pair (another number of dashes, or none),
    unknown_symbol, no_time, or no_next_bar (at the last bar or after it)."""
    legs = F.split("pair", "-")
    x = signals.withColumn("_a", F.when(F.size(legs) == 2, legs[0])).withColumn("_b", F.when(F.size(legs) == 2, legs[1]))
    for leg in ("_a", "_b"):
        x = x.join(prices.select(F.col("symbol").alias(leg), F.lit(True).alias(f"{leg}_known")).distinct(), leg, "left")
    x = x.crossJoin(F.broadcast(prices.agg(F.max("ts").alias("_end"))))
    unknown = F.col("_a_known").isNull() | F.col("_b_known").isNull()
    reason = F.when(F.col("_a").isNull(), "bad_pair").when(unknown, "unknown_symbol").when(F.col("signal_time").isNull(), "no_time").when(F.col("signal_time") >= F.col("_end"), "no_next_bar")
    return x.withColumn("reason", reason).filter("reason is not null").select(*signals.columns, "reason")


def normalise_side(signals: DataFrame) -> DataFrame:
    """side (+1 long a, -1 short a) from signal, side or sig: words, else the sign of a number, else against entry_z."""
    # The words for either side.
    raw = F.lower(F.trim(_maybe(signals, "signal", "side", "sig", kind="string").cast("string")))
    number = null_if_nan(raw.try_cast("double"))
    z = _number(signals, "z", "z_entry")
    side = F.when(raw.isin("1", "1.0", "+1", "long", "buy"), 1).when(raw.isin("-1", "-1.0", "short", "sell"), -1).when(number > 0, 1).when(number <= 0, -1).when(z > 0, -1).otherwise(1)
    hedge = F.coalesce(_number(signals, "hedge_ratio"), F.lit(1.0))
    return signals.withColumns({"entry_z": z, "side": side, "hedge": hedge, "half_life": _number(signals, "half_life")})


def leg_rows(x: DataFrame, prices: DataFrame, first: Column, last: Column, *keep: str) -> DataFrame:
    """A row per signal and bar from `first` to `last` with both legs' closes (ca, cb) and logs (la, lb): equi-joins on
    (symbol, bar_idx), which spread a busy symbol over its bars."""
    cells = x.select("signal_id", "a", "b", *keep, F.explode(F.sequence(first, last)).alias("bar_idx"))
    leg = lambda n: prices.select(F.col("symbol").alias(n), "bar_idx", F.col("close").alias(f"c{n}"), F.log("close").alias(f"l{n}"))
    return cells.join(leg("a"), ["a", "bar_idx"]).join(leg("b"), ["b", "bar_idx"])


def _zero(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), c)


def current_z(signals: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """signal_id, z_now: z of the spread at the signal bar, over its trailing bars; null while flat or short."""
    rows = leg_arrays(signals.select("signal_id", "a", "b", "hedge", "signal_bar"), chunks, "signal_id", _zero(F.col("signal_bar") - (window - 1)), F.col("signal_bar"))
    rows = rows.withColumn("_s", F.transform("bars", lambda b: b["la"] - F.col("hedge") * b["lb"])).withColumn("_m", moments(F.col("_s")))
    std = F.sqrt(F.col("_m.m2") / (F.col("_m.n") - 1))
    z = F.when((F.col("_m.n") >= 10) & (std > 0), (F.element_at("_s", -1) - F.col("_m.mean")) / std)
    return rows.select("signal_id", z.alias("z_now"))


def gate_current_z(signals: DataFrame, chunks: DataFrame, p: BacktestParams) -> DataFrame:
    """Signals whose spread, over the trailing bars of the signal bar, is at least `z_gate` deviations out; z and side are
    taken anew from it."""
    now = current_z(signals, chunks, p.window).filter(F.abs("z_now") >= p.z_gate)
    return signals.join(now, "signal_id").withColumn("entry_z", F.col("z_now")).withColumn("side", F.when(F.col("z_now") > 0, -1).otherwise(1)).drop("z_now")


def volatility(bars: Column, vol_bars: Column | int) -> dict[str, Column]:
    """_va, _vb: deviations of both legs' log returns on the last `vol_bars` of an array of bars; null without a return."""
    of = lambda c: moments(steps(bars[c], vol_bars))
    return {f"_v{n}": F.when(of(f"l{n}")["n"] > 0, F.sqrt(of(f"l{n}")["m2"] / of(f"l{n}")["n"])) for n in "ab"}


def trailing_bars(signals: DataFrame, chunks: DataFrame, vol_bars: int) -> DataFrame:
    """The signals with `bars`, both legs' logs on the trailing bars (null where there are none)."""
    rows = leg_arrays(signals.select("signal_id", "a", "b", "signal_bar"), chunks, "signal_id", _zero(F.col("signal_bar") - (vol_bars - 1)), F.col("signal_bar"))
    return signals.join(rows.select("signal_id", "bars"), "signal_id", "left")


def resolve_alloc(signals: DataFrame, chunks: DataFrame, p: BacktestParams) -> DataFrame:
    return allocate(trailing_bars(signals, chunks, p.vol_bars).withColumns(volatility(F.col("bars"), p.vol_bars)).drop("bars"), p)


def allocate(signals: DataFrame, p: BacktestParams) -> DataFrame:
    """alloc_a, alloc_b: the signal's dollars, else its allocations, else volatility parity on the trailing bars; null where
    nothing gives one."""
    wa, wb = F.coalesce(ratio(F.lit(1.0), F.col("_va")), F.lit(0.0)), F.coalesce(ratio(F.abs("hedge"), F.col("_vb")), F.lit(0.0))
    given = lambda m, n: (_number(signals, m), _number(signals, n))
    (d1, d2), (g1, g2) = given("dollar1", "dollar2"), given("alloc_A_usd", "alloc_B_usd")
    pick = lambda d, g, w: F.when(d1.isNotNull() & d2.isNotNull(), d).when(g1.isNotNull() & g2.isNotNull(), g).otherwise(F.coalesce(ratio(w * p.notional, wa + wb), F.lit(0.0)))
    return signals.withColumn("alloc_a", pick(d1, g1, wa)).withColumn("alloc_b", pick(d2, g2, wb)).drop("_va", "_vb")


def mae95(allocated: DataFrame, chunks: DataFrame, p: BacktestParams) -> DataFrame:
    """signal_id, mae: 95th percentile, over all runs of `hold` of the trailing returns, of the worst running loss. Signals
    with fewer returns than a run have no row.

    A signal is one array of its n + 1 running values; the lowest of each run comes from a sparse table: minima of 2**k
    values, doubled while they fit into a run, two of which cover it.
    """
    reach = (F.lit(p.vol_bars) if isinstance(p.vol_bars, int) else p.vol_bars).cast("long") + 10
    hold = F.greatest(F.lit(1.0), F.bround(F.coalesce("half_life", F.lit(3.0)) * p.hold_multiplier)).cast("long")
    x = allocated.withColumn("hold", hold).withColumn("base", _zero(F.col("signal_bar") - reach)).withColumn("n", F.col("signal_bar") - F.col("base"))
    x = x.filter("n >= 2 and n >= hold").select("signal_id", "a", "b", "signal_bar", "base", "hold", "alloc_a", "alloc_b")
    rows = leg_arrays(x, chunks, "signal_id", F.col("base"), F.col("signal_bar"))
    rows = rows.select("signal_id", F.col("hold").cast("int").alias("hold"), F.transform("bars", lambda b: F.col("alloc_a") * b["la"] - F.col("alloc_b") * b["lb"]).cast("array<double>").alias("run"))
    rows = rows.filter(F.size("run") > F.col("hold")).withColumn("k", F.floor(F.log2("hold")).cast("int"))
    doublings = F.when(F.col("k") > 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array().cast("array<int>"))

    def doubled(low: Column, k: Column) -> Column:
        step = F.pow(F.lit(2), k).cast("int")
        n = F.size(low) - step
        return F.zip_with(F.slice(low, 1, n), F.slice(low, step + 1, n), lambda u, v: F.least(u, v)).cast("array<double>")

    rows = rows.withColumn("low", F.aggregate(doublings, F.slice("run", 2, F.size("run")), doubled))
    runs, apart = F.size("run") - F.col("hold"), F.col("hold") - F.pow(F.lit(2), F.col("k")).cast("int")
    lowest = F.zip_with(F.slice("low", 1, runs), F.slice("low", apart + 1, runs), lambda u, v: F.least(u, v))
    losses = F.zip_with(F.slice("run", 1, runs), lowest, lambda u, v: F.greatest(F.lit(0.0), u - v))
    rows = rows.select("signal_id", F.sort_array(losses).alias("loss")).withColumn("at", (F.size("loss") - 1) * F.lit(0.95))
    below, above = F.floor("at").cast("int"), F.ceil("at").cast("int")
    value = F.get("loss", below) + (F.col("at") - below) * (F.get("loss", above) - F.get("loss", below))
    return rows.select("signal_id", value.alias("mae"))


def risk_scale(allocated: DataFrame, mae: DataFrame, limit: float) -> DataFrame:
    """Both legs shrunk by limit / mae where mae is above the limit; est_comm is left to the caller."""
    x = allocated.join(mae, "signal_id", "left")
    scale = F.when(F.col("mae") > limit, F.lit(limit) / F.col("mae")).otherwise(1.0)
    return x.withColumn("alloc_a", F.col("alloc_a") * scale).withColumn("alloc_b", F.col("alloc_b") * scale)


def _priced(x: DataFrame, prices: DataFrame, at: str) -> DataFrame:
    """Open, else close, of both legs at bar `at`, as pa and pb, and the bar's time as at_ts."""
    value = F.coalesce(_maybe(prices, "open"), F.col("close"))
    leg = lambda n, *more: prices.select(F.col("symbol").alias(n), F.col("bar_idx").alias(at), value.alias(f"p{n}"), *more)
    return x.join(leg("a", F.col("ts").alias("at_ts")), ["a", at]).join(leg("b"), ["b", at])


def entry_fills(entries: DataFrame, prices: DataFrame, p: BacktestParams) -> DataFrame:
    """Fills at the next bar's open with slippage against each leg's side; signed quantities and commission."""
    x = _priced(entries, prices, "exec_idx").withColumnRenamed("exec_idx", "entry_idx").withColumnRenamed("at_ts", "entry_time")
    x = x.withColumn("entry_price_a", F.col("pa") * (1 + F.col("side") * p.slippage)).withColumn("entry_price_b", F.col("pb") * (1 - F.col("side") * p.slippage))
    for leg, sign in (("a", 1), ("b", -1)):
        x = x.withColumn(f"qty_{leg}", F.when(F.col(f"entry_price_{leg}") > 0, F.col(f"alloc_{leg}") / F.col(f"entry_price_{leg}")).otherwise(0.0) * F.col("side") * sign)
    comm = (F.abs(F.col("entry_price_a") * F.col("qty_a")) + F.abs(F.col("entry_price_b") * F.col("qty_b"))) * p.commission
    return x.withColumn("entry_comm", comm).drop("pa", "pb")


HORIZON = 64


def exit_reason(p: BacktestParams) -> Column:
    """mean_revert, then stop_loss, then time_exit; a bar without z has none."""
    z, e = F.col("z"), F.col("entry_z")
    back = F.coalesce(e * z < 0, F.lit(False)) | (F.abs(z) <= p.z_exit)
    return F.when(z.isNull(), None).when(back, "mean_revert").when((F.abs(z) >= p.z_stop) & (z * e > 0), "stop_loss").when((F.col("bar_idx") - F.col("entry_idx")) / 24.0 >= p.max_hold_days, "time_exit")


def first_reason(bars: DataFrame) -> DataFrame:
    """signal_id, exit_bar, exit_reason, exit_z of the first bar that has a reason."""
    at = bars.filter("reason is not null").groupBy("signal_id")
    return at.agg(F.min("bar_idx").alias("exit_bar"), F.min_by("reason", "bar_idx").alias("exit_reason"), F.min_by("z", "bar_idx").alias("exit_z"))


def first_exit(fills: DataFrame, chunks: DataFrame, p: BacktestParams, path: str = "signal_id", horizon: int = HORIZON) -> DataFrame:
    """signal_id, exit_bar, exit_reason, exit_z of the first bar with a reason.

    Bars are looked at `horizon` at a time, twice as many in each round, and only for positions that are still open: no
    position has more than about twice its held bars looked at, or `horizon`. Rows with one `path` are one position under
    several parameter sets, of one pair, hedge, entry and window, and share its z. Each round is settled.
    """
    window = p.window if isinstance(p.window, int) else F.first("p_window")
    keep = [c for c in fills.columns if c.startswith("p_")]
    left = fills.select("signal_id", *([] if path == "signal_id" else [path]), "a", "b", "hedge", "entry_idx", "entry_z", "last_bar", *keep).withColumn("from_bar", F.col("entry_idx"))
    found = None
    while True:
        last = F.least(F.col("from_bar") + horizon - 1, F.col("last_bar"))
        one = lambda c: F.first(c).alias(c)
        paths = left if path == "signal_id" else left.groupBy(path).agg(*map(one, ("a", "b", "hedge", "from_bar", "last_bar")), F.lit(window).cast("int").alias("window") if isinstance(window, int) else window.cast("int").alias("window"))
        size = p.window if path == "signal_id" else F.col("window")
        some = leg_arrays(paths, chunks, path, _zero(F.col("from_bar") - (size - 1)), last)
        bars = rolling_z(some, size)
        if path != "signal_id":
            bars = bars.select(path, "bar_idx", "z").join(left, path)
        now = settle(first_reason(bars.withColumn("reason", exit_reason(p))))
        found = now if found is None else found.unionByName(now)
        left = settle(left.filter(F.col("from_bar") + horizon <= F.col("last_bar")).join(now, "signal_id", "left_anti").withColumn("from_bar", F.col("from_bar") + horizon))
        if left.isEmpty():
            break
        horizon *= 2
    if p.causal is False:
        return found
    causal = F.lit(True) if p.causal is True else p.causal
    return found.join(fills.select("signal_id", "last_bar", *([] if p.causal is True else ["p_causal"])), "signal_id").filter(~causal | (F.col("exit_bar") < F.col("last_bar"))).select(*found.columns)


def exit_fills(fills: DataFrame, exits: DataFrame, prices: DataFrame, p: BacktestParams) -> DataFrame:
    """Exits filled at the bar after the trigger (the last bar at most), against each leg's sign; gross, commission and net."""
    x = fills.join(exits, "signal_id").withColumn("exit_idx", F.least(F.col("exit_bar") + 1, F.col("last_bar")))
    x = _priced(x, prices, "exit_idx").withColumnRenamed("at_ts", "exit_time")
    for leg in ("a", "b"):
        x = x.withColumn(f"exit_price_{leg}", F.col(f"p{leg}") * F.when(F.col(f"qty_{leg}") > 0, 1 - p.slippage).otherwise(1 + p.slippage))
    x = x.withColumn("pnl_gross", (F.col("exit_price_a") - F.col("entry_price_a")) * F.col("qty_a") + (F.col("exit_price_b") - F.col("entry_price_b")) * F.col("qty_b"))
    x = x.withColumn("exit_comm", (F.abs(F.col("exit_price_a") * F.col("qty_a")) + F.abs(F.col("exit_price_b") * F.col("qty_b"))) * p.commission)
    x = x.withColumn("commission_total", F.col("entry_comm") + F.col("exit_comm")).withColumn("pnl_net", F.col("pnl_gross") - F.col("commission_total"))
    return x.withColumn("hold_hours", F.col("exit_idx") - F.col("entry_idx")).select("signal_id", "exit_bar", "exit_idx", "exit_time", "exit_price_a", "exit_price_b", "exit_reason", "hold_hours", "pnl_gross", "pnl_net", "exit_comm", "commission_total")


def trades(fills: DataFrame, closed: DataFrame) -> DataFrame:
    """Every fill with its exit; the exit half is null while a position is open."""
    return fills.join(closed, "signal_id", "left")

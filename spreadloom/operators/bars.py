"""Bars and the time grid. Long tables throughout: symbol, ts, open, close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.operators.chunks import Carry, bar_chunk, carried, time_chunk, with_halo
from spreadloom.session import settle


def bars_from_events(events: DataFrame, symbols: int = 12) -> DataFrame:
    """Hourly bars: first and last value of each symbol and hour, in one partial aggregate."""
    symbol = F.concat(F.lit("S"), F.lpad((F.col("user_id") % symbols).cast("string"), 2, "0"))
    rows = events.select(symbol.alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), F.col("ts").alias("at"), "value")
    return rows.groupBy("symbol", F.col("hour").alias("ts")).agg(F.min_by("value", "at").alias("open"), F.max_by("value", "at").alias("close"))


def bars_from_lineitem(lineitem: DataFrame, unit: str = "week") -> DataFrame:
    """A symbol per supplier, so that the panel grows with the table: first and last unit price of each `unit`, by ship date,
    order and line, in one partial aggregate. Lines without a supplier, date or price per unit are left out."""
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    price = F.try_divide("l_extendedprice", "l_quantity")
    rows = lineitem.select(F.concat(F.lit("P"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("symbol"), F.date_trunc(unit, F.col("l_shipdate").cast("timestamp")).alias("bar_ts"), at.alias("at"), price.alias("price"))
    rows = rows.filter("symbol is not null and bar_ts is not null and price is not null")
    return rows.groupBy("symbol", F.col("bar_ts").alias("ts")).agg(F.min_by("price", "at").alias("open"), F.max_by("price", "at").alias("close"))


def duplicate_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "ts").agg(F.count("*").alias("n")).filter("n > 1")


def dedupe_bars(bars: DataFrame) -> DataFrame:
    order = Window.partitionBy("symbol", "ts").orderBy(F.col("close").asc_nulls_last())
    return bars.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def bar_index(bars: DataFrame) -> DataFrame:
    """ts, bar_idx: place in the sorted union of dates, counted by stretches of time."""
    return carried(bars.select("ts").distinct(), "ts", time_chunk(), {"bar_idx": Carry("count", F.lit(1), True)})


def with_bar_idx(bars: DataFrame) -> DataFrame:
    return bars.join(bar_index(bars), "ts")


def grid(bars: DataFrame) -> DataFrame:
    """Every symbol at every date, values missing where there was no bar. Both sides are small dimensions; the grid is
    the result."""
    cells = bars.select("symbol").distinct().crossJoin(bar_index(bars))
    return cells.join(bars, ["symbol", "ts"], "left")


def _first_closes(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min_by("close", F.when(F.col("close").isNotNull(), F.struct("ts"))).alias("_first"))


def dense_grid(bars: DataFrame) -> DataFrame:
    """The grid with closes carried forward by runs of bars; a leading gap takes the symbol's first close."""
    filled = carried(grid(bars), "bar_idx", bar_chunk(), {"_last": Carry("last", F.col("close"))}, ("symbol",))
    return filled.join(_first_closes(bars), "symbol", "left").select("symbol", "ts", "bar_idx", F.coalesce("_last", "_first").alias("close"))


def log_prices(bars: DataFrame) -> DataFrame:
    """logp and shift: a symbol whose smallest close is not positive is shifted by its size and 1e-6 first. The smallest is a
    partial aggregate, a row a symbol; a symbol's bars are never gathered."""
    low = bars.groupBy("symbol").agg(F.min("close").alias("_low"))
    shift = F.when(F.col("_low") <= 0, F.abs("_low") + 1e-6).otherwise(F.lit(0.0))
    x = bars.join(low.withColumnRenamed("symbol", "_symbol"), F.col("symbol").eqNullSafe(F.col("_symbol")))
    return x.select(*bars.columns, shift.alias("shift"), F.log(F.col("close") + shift).alias("logp"))


def dense_runs(bars: DataFrame) -> DataFrame:
    """log_prices(dense_grid(bars)) as arrays: symbol, shift, first_bar, logps, a row for each symbol and run of bars (chunks.BARS) that has
    a close, which reaches to the symbol's next row. A bar is shuffled once, and no grid is made. `bars` have a row a symbol and date;
    symbols without a close have no row. The dates, and then the arrays, are written to the shared folder."""
    dates = settle(bar_index(bars))
    end = dates.agg((F.max("bar_idx") + 1).alias("_end"))
    closes = bars.filter("symbol is not null and close is not null").select("symbol", "ts", "close").join(F.broadcast(dates), "ts")
    runs = closes.groupBy("symbol", bar_chunk().alias("_run")).agg(F.sort_array(F.collect_list(F.struct("bar_idx", "close"))).alias("_bars"), F.min("close").alias("_low"))
    runs = runs.crossJoin(F.broadcast(end)).withColumn("_from", F.expr("_bars[0].bar_idx"))
    whole = Window.partitionBy("symbol")
    ahead = whole.orderBy("_run")
    runs = runs.withColumn("_low", F.min("_low").over(whole)).withColumn("_next", F.coalesce(F.lead("_from").over(ahead), "_end"))
    runs = runs.withColumn("first_bar", F.when(F.lag("_run").over(ahead).isNotNull(), F.col("_from")).otherwise(F.lit(0).cast("long")))
    runs = runs.withColumn("shift", F.when(F.col("_low") <= 0, F.abs("_low") + 1e-6).otherwise(F.lit(0.0)))

    def held(x: Column, k: Column) -> Column:
        until = F.coalesce(F.get("_bars", k + 1)["bar_idx"], F.col("_next"))
        return F.array_repeat(F.log(x["close"] + F.col("shift")), (until - F.when(k == 0, F.col("first_bar")).otherwise(x["bar_idx"])).cast("int"))

    return settle(runs.select("symbol", "shift", "first_bar", F.flatten(F.transform("_bars", held)).alias("logps")))


def log_returns(series: DataFrame, order: str = "bar_idx", dense: bool = False) -> DataFrame:
    """ret: the difference to the row before. With `dense` each symbol has a row at every bar, and runs of bars that carry the
    bar before them are taken one by one; else a symbol's rows are ordered as a whole."""
    if not dense:
        return series.withColumn("ret", F.col("logp") - F.lag("logp").over(Window.partitionBy("symbol").orderBy(order)))
    x = with_halo(series, 2, "bar_idx")
    return x.withColumn("ret", F.col("logp") - F.lag("logp").over(Window.partitionBy("symbol", "_part").orderBy("bar_idx"))).filter("_own").drop("_part", "_own")


def wide_matrix(bars: DataFrame, symbols: list[str]) -> DataFrame:
    return bars.groupBy("ts").pivot("symbol", symbols).agg(F.first("close"))


def resample(bars: DataFrame, unit: str = "day") -> DataFrame:
    out = bars.groupBy("symbol", F.date_trunc(unit, "ts").alias("bar_ts"))
    return out.agg(F.min_by("open", "ts").alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", "ts").alias("close"), F.count("*").alias("n_bars"))


def normalised(bars: DataFrame) -> DataFrame:
    """norm: closes over the symbol's first one, which is a partial aggregate."""
    return bars.join(_first_closes(bars), "symbol").withColumn("norm", F.try_divide("close", "_first")).drop("_first")


def random_walk(bars: DataFrame, centre: float = 50.0, scale: float = 5000.0) -> DataFrame:
    """A price-like series from arbitrary values: the running sum of centred closes, missing ones counting as the centre."""
    run = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    moved = grid(bars).withColumn("logp", F.sum((F.coalesce("close", F.lit(centre)) - centre) / scale).over(run))
    return moved.select("symbol", "ts", "bar_idx", "logp", F.lit(0.0).alias("shift"), F.exp("logp").alias("close"))

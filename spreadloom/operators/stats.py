"""Pair and symbol statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.numeric import ratio
from spreadloom.operators.bars import log_returns
from spreadloom.operators.chunks import Carry, bar_chunk, carried, with_halo

KEYS = ["a", "b", "window_id"]
BLOCKS = ["block_a", "block_b"]


def pair_keys(rows: DataFrame) -> list[str]:
    """What a pair window is grouped by: with its blocks, where rows carry them, so that no exchange follows pair_rows()."""
    return KEYS + [c for c in BLOCKS if c in rows.columns]


def pair_rows(windowed: DataFrame, usable: DataFrame, benchmark: str, excluded: tuple[str, ...] = (), only: DataFrame | None = None, per_block: int = 64) -> DataFrame:
    """a, b, window_id, bar_idx, la, lb, lc: the logs of both legs and of the benchmark, for usable windows only.

    A symbol's window travels as one array. Symbols fall into blocks of about `per_block`; the join is on (window_id,
    block_a, block_b), so that what is shuffled is symbols x windows x blocks, not pairs x bars, and bars are laid out
    where the pair was met. With `only` (a, b, window_id) just these pair windows are laid out, fetched by leg.
    Memory is bound by a window's length; windows of a symbol that `usable` does not list meet nothing.
    """
    rows = windowed.join(usable, ["symbol", "window_id"], "left_semi")
    bars = F.array_sort(F.collect_list(F.struct("bar_idx", "logp")))
    arrays = rows.groupBy("symbol", "window_id").agg(F.first("shift").alias("shift"), bars.alias("bars"))
    bench = arrays.filter(F.col("symbol") == benchmark).select("window_id", F.col("bars.logp").alias("lc"))
    legs = arrays.filter(~F.col("symbol").isin(benchmark, *excluded))
    side = lambda n, *more: [F.col("symbol").alias(n), "window_id", F.col("shift").alias(f"shift_{n}"), F.col("bars.logp").alias(f"l{n}"), *more]
    first = legs.join(bench, "window_id").select(*side("a", F.col("bars.bar_idx").alias("bar_idx"), "lc"))
    second, blocks = legs.select(*side("b")), []
    if only is not None:
        met = only.select(*KEYS).join(first, ["a", "window_id"]).join(second, ["b", "window_id"])
    else:
        blocks = BLOCKS
        n = F.broadcast(usable.agg(F.ceil(F.countDistinct("symbol") / per_block).alias("_n")))
        own, all_ = lambda c: F.pmod(F.xxhash64(c), F.col("_n")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
        first = first.crossJoin(n).select(*first.columns, own("a").alias("block_a"), all_.alias("block_b"))
        second = second.crossJoin(n).select(*second.columns, all_.alias("block_a"), own("b").alias("block_b"))
        met = first.join(second, ["window_id", *blocks]).filter("a < b")
    return met.select(*KEYS, *blocks, "shift_a", "shift_b", F.inline(F.arrays_zip("bar_idx", "la", "lb", "lc")))


def rolling_z(series: DataFrame, n: int = 200, least: int = 10, value: str = "logp", key: str = "symbol", dense: bool = False) -> DataFrame:
    """z of the last n rows, which hold at least `least` values. Frames run in runs of bars that carry the n - 1 rows before
    them. With `dense` each key has a row at every bar; else its rows are numbered first."""
    x, place = series, "bar_idx"
    if not dense:
        x, place = carried(series, "bar_idx", bar_chunk(), {"_row": Carry("count", F.lit(1), True)}, (key,)), "_row"
    w = Window.partitionBy(key, "_part").orderBy(place).rowsBetween(-(n - 1), 0)
    std = F.stddev_samp(value).over(w)
    z = F.when((F.count(value).over(w) >= least) & (std > 0), (F.col(value) - F.avg(value).over(w)) / std)
    return with_halo(x, n, place).withColumn("z", z).filter("_own").select(*series.columns, "z")


def symbol_beta(series: DataFrame, benchmark: str) -> DataFrame:
    """Beta of each symbol's log returns to the benchmark's, both taken from one grid: sample covariance over population variance."""
    r = log_returns(series, dense=True)
    bench = r.filter(F.col("symbol") == benchmark).select("bar_idx", F.col("ret").alias("bench"))
    j = r.filter(F.col("symbol") != benchmark).join(bench, "bar_idx").filter("ret is not null and bench is not null")
    return j.groupBy("symbol").agg(ratio(F.covar_samp("ret", "bench"), F.var_pop("bench")).alias("beta"), F.corr("ret", "bench").alias("corr"), F.count("*").alias("n"))


def beta_summary(betas: DataFrame) -> DataFrame:
    return betas.agg(F.count("*").alias("n_symbols"), F.avg("beta").alias("mean_beta"), F.count_if(F.abs("beta") < 0.11).alias("near_zero"), F.count_if(F.col("beta") > 1).alias("above_one"), F.count_if(F.col("beta") < 0).alias("negative"))

"""A pair scan that can stop anywhere and go on: its output lies in partitions, and finished ones are not scanned again.

A partition is a run of windows and a pair of symbol blocks, the very task of window_statistics(). It is written by dynamic
partition overwrite, so a run that ends between writing and noting a partition writes it once more, with the same rows. New
bars extend the last run of windows and add further ones; new symbols get blocks of their own, so that partitions of older
symbols stay as they are. Bars that were scanned must not change, and new ones must follow them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.operators.panes import chunk_windows
from spreadloom.params import ScanParams
from spreadloom.plans.scan import scan_windows
from spreadloom.session import settle

PLACE = ["chunk", "block_a", "block_b"]
SIGNALS = "pair string, window_id long, start_index long, end_index long, hedge_ratio double, half_life double, p_value double, beta double, z double, signal int, qty1 double, qty2 double, dollar1 double, dollar2 double, chunk long, block_a long, block_b long"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the scan, empty where none was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def scan_signals(spark: SparkSession, path: str) -> DataFrame:
    """All signals found so far."""
    return _stored(spark, f"{path}/signals", SIGNALS).drop(*PLACE)


def symbol_blocks(series: DataFrame, p: ScanParams, path: str, per_block: int) -> DataFrame:
    """symbol, block: the blocks given before, and new ones for symbols seen for the first time, which are written."""
    spark = series.sparkSession
    schema = "symbol string, block long, batch long"
    known = _stored(spark, f"{path}/symbols", schema)
    seen = series.filter("symbol is not null").select("symbol").distinct().filter(~F.col("symbol").isin(p.benchmark, *p.excluded))
    new = settle(seen.join(known, "symbol", "left_anti"))
    n = new.count()
    if n:
        last = known.agg(F.max("block").alias("block"), F.max("batch").alias("batch")).first()
        first, batch = (-1 if v is None else v for v in (last.block, last.batch))
        block = F.pmod(F.xxhash64("symbol"), F.lit(-(-n // per_block))) + (first + 1)
        _overwrite(new.select("symbol", block.alias("block"), F.lit(batch + 1).cast("long").alias("batch")), f"{path}/symbols", "batch")
    return _stored(spark, f"{path}/symbols", schema).select("symbol", "block")


def pending_partitions(series: DataFrame, blocks: DataFrame, p: ScanParams, path: str) -> DataFrame:
    """chunk, block_a, block_b, windows: partitions that hold windows which no finished run has seen."""
    spark, size = series.sparkSession, chunk_windows([p.window], p.step)
    bars = series.agg(F.coalesce(F.max("bar_idx") + 1, F.lit(0)).alias("n")).first().n
    windows = max(0, (bars - p.window) // p.step + 1)
    windows = windows if p.max_windows is None else min(windows, p.max_windows)
    runs = spark.range(-(-windows // size)).select(F.col("id").alias("chunk"), F.least(F.lit(size).cast("long"), F.lit(windows) - F.col("id") * size).alias("windows"))
    one = blocks.select(F.col("block").alias("block_a")).distinct()
    tasks = one.join(one.withColumnRenamed("block_a", "block_b"), F.col("block_a") <= F.col("block_b")).crossJoin(runs)  # the tasks of a scan, no data
    done = _stored(spark, f"{path}/finished", "chunk long, block_a long, block_b long, windows long")
    return tasks.join(done, [*PLACE, "windows"], "left_anti").select(*PLACE, "windows")


def resume_scan(series: DataFrame, p: ScanParams, path: str, per_block: int = 64, runs_at_once: int = 16, stop_after: int | None = None) -> int:
    """Scan what of `series` (symbol, bar_idx, logp, shift) was not scanned yet into the folder `path`, and return how many
    steps that took. A step is `runs_at_once` runs of windows: it reads their bars only, writes their partitions and then notes
    them as finished. `stop_after` steps the call returns early. Other parameters than the folder's are refused. `series` is
    read at each step and is best settled."""
    spark = series.sparkSession
    name = f"{p!r} {per_block}"
    was = _stored(spark, f"{path}/parameters", "name string").first()
    if was is None:
        spark.createDataFrame([(name,)], "name string").write.mode("overwrite").parquet(f"{path}/parameters")
    elif was.name != name:
        raise ValueError(f"{path} holds a scan with {was.name}")
    blocks = symbol_blocks(series, p, path, per_block)
    pending = settle(pending_partitions(series, blocks, p, path))
    ends = pending.agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).first()
    size, steps = chunk_windows([p.window], p.step), 0
    for low in range(ends.low, ends.high + 1, runs_at_once) if ends.low is not None else ():
        high = min(low + runs_at_once - 1, ends.high)
        todo = pending.filter(F.col("chunk").between(low, high))
        if todo.isEmpty():
            continue
        if steps == stop_after:
            break
        bars = series.filter(F.col("bar_idx").between(low * size * p.step, ((high + 1) * size - 1) * p.step + p.window - 1))
        found = scan_windows(bars, p, [p.window], [p.vol_bars], ("a", "b"), blocks=blocks, only=todo.select(*PLACE))
        side = lambda c: blocks.select(F.col("symbol").alias(c), F.col("block").alias(f"_{c}"))
        placed = found.join(side("a"), "a").join(side("b"), "b").withColumn("chunk", F.expr(f"window_id div {size}"))
        placed = placed.withColumn("block_a", F.least("_a", "_b")).withColumn("block_b", F.greatest("_a", "_b"))
        columns = [c.split()[0] for c in SIGNALS.split(", ")]
        _overwrite(placed.select(*columns).repartition(*PLACE), f"{path}/signals", *PLACE)
        todo.write.mode("append").parquet(f"{path}/finished")
        steps += 1
    return steps

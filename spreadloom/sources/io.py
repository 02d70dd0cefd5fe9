"""Readers and writers of bars, signals, trades and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.functions.numeric import null_if_nan


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


#: Column types by name; other columns stay text. Values that do not fit are null.
SIGNAL_TYPES = {"start_index": "long", "end_index": "long", "window_id": "long", **dict.fromkeys(["hedge_ratio", "half_life", "p_value", "beta", "beta_btc", "z", "z_entry", "qty1", "qty2", "dollar1", "dollar2", "alloc_A_usd", "alloc_B_usd"], "double")}
TRADE_TYPES = {"entry_idx": "long", "exit_idx": "long", "hold_hours": "long", "entry_time": "timestamp", "exit_time": "timestamp", **dict.fromkeys(["entry_price_a", "entry_price_b", "qty_a", "qty_b", "alloc_a", "alloc_b", "entry_comm", "exit_price_a", "exit_price_b", "pnl_gross", "pnl_net", "exit_comm", "commission_total"], "double")}


def _typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Named columns cast to their types: one scan, and a schema that does not depend on the data."""
    number = lambda n, t: null_if_nan(F.col(n).try_cast("double")) if t == "double" else F.col(n).try_cast("double").cast(t) if t == "long" else F.try_to_timestamp(F.col(n).cast("string"))
    return df.withColumns({n: number(n, t) for n, t in types.items() if n in df.columns})


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.csv(path, header=True) if fmt == "csv" else spark.read.format(fmt).load(path)


def read_bars(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Bars with Date, Symbol, Close and perhaps Open as symbol, ts, open, close; open falls back to a null column, and a value
    that is no number or time is null."""
    df = _read(spark, path, fmt)
    require(df, "Date", "Symbol", "Close")
    opened = F.col("Open").try_cast("double") if "Open" in df.columns else F.lit(None).cast("double")
    return df.select(F.col("Symbol").alias("symbol"), F.try_to_timestamp(F.col("Date").cast("string")).alias("ts"), null_if_nan(opened).alias("open"), null_if_nan(F.col("Close").try_cast("double")).alias("close"))


def read_signals(spark: SparkSession, path: str, fmt: str = "csv", anchor: str = "end_date") -> DataFrame:
    """Signals with signal_time taken from the `anchor` column, else from the other date column; ties keep signal_id. A pair's
    beta_btc serves as its beta where there is no such column."""
    df = _typed(_read(spark, path, fmt), SIGNAL_TYPES)
    if "beta_btc" in df.columns and "beta" not in df.columns:
        df = df.withColumn("beta", F.col("beta_btc"))
    require(df, "pair")
    column = next((c for c in (anchor, "end_date", "start_date") if c in df.columns), None)
    if column is None:
        raise ValueError("signals need start_date or end_date")
    return df.withColumn("signal_time", F.try_to_timestamp(F.col(column).cast("string")))


def read_trades(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    df = _typed(_read(spark, path, fmt), TRADE_TYPES)
    require(df, "pair", "pnl_net")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One distributed write; an empty table still carries its schema."""
    w = df.write.mode(mode)
    w.csv(path, header=True) if fmt == "csv" else w.format(fmt).save(path)


def write_report(parts: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """The tables of a backtest (trades, metrics, equity, drawdown, ledger), each in a folder of its name."""
    for name, df in parts.items():
        write_table(df, f"{path}/{name}", fmt, mode)


def pending_pairs(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs that an earlier, appended scan has not finished."""
    return pairs.join(done, ["a", "b"], "left_anti")

"""Pair statistics of sliding windows. A task meets two blocks of symbols on a run of windows; each window's pairs are products of
matrices of centred bars, for all its pairs at once, and what a limit on z rules out is dropped before anything else is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16  # windows that a task takes at once
CELLS = 1 << 18  # pairs that are met at once
BLOCKS, WIDEST = 10, 8192  # blocks of symbols, unless they would hold more symbols than this
NARROW = 1e-9  # share of a leg's squares below which a spread's are taken from its bars

STATISTICS = "start_index long, end_index long, n long, hedge_ratio double, phi double, beta double, s_last double, s_mean double, s_std double, vol_a double, vol_b double, last_a double, last_b double, shift_a double, shift_b double"


class Limits(NamedTuple):
    """Windows that a caller wants: the others need not leave a task. A little more than these may."""

    z: float = 0.0
    half_life: float = math.inf
    beta: float = math.inf

    def near(self, z: np.ndarray, phi: np.ndarray, beta: np.ndarray) -> np.ndarray:
        out = np.ones(len(z), bool)
        if self.z > 0:
            out &= np.abs(z) >= self.z - 1e-6
        if self.half_life < math.inf:
            out &= (phi > 0) & (phi < 1) & (phi <= 0.5 ** (1 / (self.half_life + 0.01)) + 1e-9)
        if self.beta < math.inf:
            out &= np.abs(beta) <= self.beta + 1e-6
        return out


ROW = f"a string, b string, lookback int, vol_bars int, window_id long, {STATISTICS}"


def _spreads(v: np.ndarray, k: np.ndarray, l: np.ndarray, most: int = 8192) -> tuple[np.ndarray, ...]:
    """Hedge ratio of legs k and l and, of their spread, squares, lagged products, first and last value, bar by bar: equal
    legs have a spread of nothing but zeros."""
    parts = []
    for i in range(0, len(k), most):
        a, b = v[k[i : i + most]], v[l[i : i + most]]
        h = np.einsum("ij,ij->i", a, b) / np.einsum("ij,ij->i", b, b)
        s = a - h[:, None] * b
        parts.append((h, np.einsum("ij,ij->i", s, s), np.einsum("ij,ij->i", s[:, 1:], s[:, :-1]), s[:, 0], s[:, -1]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _block(symbols: list[str], shift: np.ndarray, logs: np.ndarray, mark: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], first_window: int, n_windows: int, step: int, lengths: list[int], vols: list[int], cap: int | None, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Statistics of the pairs in `n_windows` windows from `first_window` on. `symbols` are in order; each of `sides` holds
    rising places of first and of second legs, whose pairs in order of the symbols are wanted. `logs`: (symbol, bar) from the
    first window's first bar on, NaN where a bar is missing; `mark`: the benchmark's row."""
    finite = np.isfinite(logs)
    x, names = np.where(finite, logs, 0.0), pa.array(symbols, pa.string())
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [(n, kinds[t]) for n, t in (c.split() for c in ROW.split(", "))]
    for n, w in ((n, w) for n in lengths for w in range(n_windows)):
        at, window_id = w * step, first_window + w
        own, m = x[:, at : at + n], mark[at : at + n]
        if m.size < n or cap is not None and window_id >= cap or not np.isfinite(m).all() or not np.abs(m - m[0]).max() > 1e-8 + 1e-5 * abs(m[0]):
            continue
        fine = finite[:, at : at + n].all(1) & (np.maximum(own.max(1) - own[:, 0], own[:, 0] - own.min(1)) > 1e-8 + 1e-5 * np.abs(own[:, 0]))
        mean, last = own.mean(1), own[:, -1]
        v = own - mean[:, None]
        beside = np.zeros_like(v)  # the bar before and the bar after
        beside[:, 1:] += v[:, :-1]
        beside[:, :-1] += v[:, 1:]
        square, lag = np.einsum("ij,ij->i", v, v), np.einsum("ij,ij->i", v[:, 1:], v[:, :-1])
        inverse = np.divide(1.0, square, out=np.zeros_like(square), where=square > 0)
        dm = np.diff(m)
        dm -= dm.mean()
        moved, cross = (dm * dm).sum(), np.diff(own, axis=1) @ dm
        near = {}
        for vol in vols:
            taken = min(vol, n) - 1
            near[vol] = np.diff(logs[:, at + n - 1 - taken : at + n], axis=1).std(1) if taken > 0 else np.full(len(logs), np.nan)
        for firsts, seconds in sides:
            firsts, seconds = firsts[fine[firsts]], seconds[fine[seconds]]
            v2, beside2 = v[seconds], beside[seconds]
            wide = max(1, CELLS // max(1, len(seconds)))
            for s in range(0, len(firsts), wide):
                r = firsts[s : s + wide]
                after = int(np.searchsorted(seconds, r[0], "right"))
                c = seconds[after:]
                if not len(c):
                    break
                product, some = v[r] @ v2[after:].T, c > r[:, None]
                if limits.z > 0:  # z * z of all pairs, and a little room for rounding
                    h = product * inverse[c]
                    z = h * v[c, -1]
                    np.subtract(v[r, -1][:, None], z, out=z)
                    z *= z
                    h *= product
                    np.subtract(square[r][:, None], h, out=h)
                    h *= max(limits.z - 1e-6, 0.0) ** 2 / (n - 1)
                    h -= 1e-12 * square[r][:, None]
                    some &= z >= h
                i, j = np.nonzero(some)
                if not len(i):
                    continue
                k, l, ab, lags = r[i], c[j], product[i, j], (v[r] @ beside2[after:].T)[i, j]
                aa, bb = square[k], square[l]
                with np.errstate(all="ignore"):
                    h = np.where(bb > 0, ab / bb, np.nan)
                    ss = np.maximum(aa - 2 * h * ab + h * h * bb, 0)
                    lagged = lag[k] - h * lags + h * h * lag[l]
                    y, z = v[k, 0] - h * v[l, 0], v[k, -1] - h * v[l, -1]  # first and last of the spread, less its mean
                    thin = np.flatnonzero(ss <= NARROW * aa)
                    if len(thin):
                        h[thin], ss[thin], lagged[thin], y[thin], z[thin] = _spreads(v, k[thin], l[thin])
                    below = ss - z * z - z * z / (n - 1)
                    phi = np.where(below > 0, (lagged - y * z / (n - 1)) / below, np.nan)
                    beta = np.where((moved > 0) & (n > 5), (cross[k] - h * cross[l]) / (n - 2) / (moved / (n - 1)), np.nan)
                    std = np.sqrt(ss / (n - 1))
                    some = limits.near(np.where(std > 0, z / std, np.nan), phi, beta)
                k, l, h, phi, beta, z, std = (u[some] for u in (k, l, h, phi, beta, z, std))
                if not len(k):
                    continue
                s_mean, one = mean[k] - h * mean[l], np.ones(len(k), np.int64)
                a, b = names.take(pa.array(k)), names.take(pa.array(l))
                for vol in vols:
                    got = [a, b, one * n, one * vol, one * window_id, one * window_id * step, one * window_id * step + n - 1, one * n, h, phi, beta, s_mean + z, s_mean, std, near[vol][k], near[vol][l], last[k], last[l], shift[k], shift[l]]
                    yield pa.RecordBatch.from_arrays([u if isinstance(u, pa.Array) else pa.array(u, t, from_pandas=True) for u, (_, t) in zip(got, fields, strict=True)], names=[f for f, _ in fields])


def chunk_windows(lengths: Iterable[int], step: int) -> int:
    """Windows that a task takes at once: CHUNK, or as many as begin within the longest window."""
    return max(CHUNK, -(-max(lengths) // step))


def window_statistics(series: DataFrame, benchmark: str, lengths: Iterable[int], step: int, vol_bars: Iterable[int] = (60,), excluded: tuple[str, ...] = (), cap: int | None = None, per_block: int = 64, limits: Limits = Limits(), blocks: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """One row per pair a < b, window length, volatility length and window: a, b, lookback, vol_bars, window_id, STATISTICS,
    half_life and z, where both legs and the benchmark have every bar and are not flat (usable_windows()).

    `series`: symbol, bar_idx, logp, shift, or the runs of bars.dense_runs(). Window k of any length starts at bar k * step. A
    symbol's bars of CHUNK windows travel as one array (or as pieces of its runs), with those of the longest window that
    begins last among them, once to each pair of blocks that holds the symbol. Symbols stand in blocks of about `per_block`,
    but in BLOCKS at most as long as that makes blocks of up to WIDEST: a symbol's bars travel as often as there are
    blocks, so that what is shuffled is some ten times the series. A task meets two blocks on CHUNK windows, and gives its
    rows as it finds them. Windows beyond `limits` are left out where they are met. With `blocks` (symbol, block)
    symbols stand in given blocks, those without one nowhere; `only` (chunk, block_a, block_b) names the tasks wanted.
    """
    lengths, vols = sorted({int(n) for n in lengths}), sorted({int(v) for v in vol_bars})
    chunk = chunk_windows(lengths, step)
    stride, span = chunk * step, (chunk - 1) * step + lengths[-1]
    runs = "logps" in series.columns
    first, last = ("first_bar", "first_bar + size(logps) - 1") if runs else ("bar_idx", "bar_idx")
    low = F.greatest(F.lit(0).cast("long"), F.expr(f"({first} - {span} + {stride}) div {stride}"))
    high = F.expr(f"({last}) div {stride}")
    if cap is not None:
        high = F.least(high, F.lit((cap - 1) // chunk).cast("long"))
    bars = series.filter("symbol is not null" if runs else "symbol is not null and bar_idx is not null and logp is not null")
    bars = bars.filter((F.col("symbol") == benchmark) | ~F.col("symbol").isin(*excluded)).filter(low <= high).withColumn("chunk", F.explode(F.sequence(low, high)))
    if runs:
        start, end = F.greatest(F.col("first_bar"), F.col("chunk") * stride), F.least(F.expr(last), F.col("chunk") * stride + span - 1)
        part = F.slice("logps", (start - F.col("first_bar") + 1).cast("int"), (end - start + 1).cast("int"))
        arrays = bars.select("symbol", "chunk", "shift", start.alias("first_bar"), F.lit(None).cast("array<bigint>").alias("bar_idx"), part.alias("logp"))
    else:
        arrays = bars.groupBy("symbol", "chunk").agg(F.first("shift").alias("shift"), F.collect_list(F.struct("bar_idx", "logp")).alias("bars"))
        arrays = arrays.select("symbol", "chunk", "shift", F.lit(None).cast("long").alias("first_bar"), "bars.bar_idx", "bars.logp")
    block = F.pmod(F.xxhash64("symbol"), F.col("_n"))
    count = F.greatest(F.countDistinct("symbol"), F.lit(1))
    n = series.agg(F.greatest(F.least(F.ceil(count / per_block), F.lit(BLOCKS)), F.ceil(count / WIDEST)).alias("_n"))
    if blocks is not None:
        arrays, block = arrays.join(blocks.select("symbol", F.col("block").alias("_block")), "symbol", "left"), F.col("_block")
        n = blocks.agg((F.coalesce(F.max("block"), F.lit(0)) + 1).alias("_n"))
    dealt = arrays.crossJoin(F.broadcast(n)).withColumn("block", F.when(F.col("symbol") == benchmark, -1).otherwise(block)).filter("block is not null")
    every = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    dealt = dealt.withColumn("_one", F.explode(every)).withColumn("_other", F.explode(F.when(F.col("block") == -1, every).otherwise(F.array("block"))))
    dealt = dealt.filter("block <> -1 or _one <= _other").select(F.least("_one", "_other").alias("block_a"), F.greatest("_one", "_other").alias("block_b"), "chunk", "block", "symbol", "shift", "first_bar", "bar_idx", "logp")
    if only is not None:
        dealt = dealt.join(only, ["chunk", "block_a", "block_b"], "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("symbol").combine_chunks()
        chunk_, a, b = (table.column(c)[0].as_py() for c in ("chunk", "block_a", "block_b"))
        column = lambda c: table.column(c).combine_chunks()
        keys, values = column("symbol").dictionary_encode(), column("logp")
        row, symbols = keys.indices.to_numpy(), keys.dictionary.to_pylist()  # a symbol's pieces stand together
        sizes = np.diff(values.offsets.to_numpy())
        if table.column("bar_idx").null_count:
            bar = np.arange(sizes.sum()) + np.repeat(column("first_bar").to_numpy() - (np.cumsum(sizes) - sizes), sizes)
        else:
            bar = column("bar_idx").flatten().to_numpy()
        bar = bar - chunk_ * stride
        n_windows = min(chunk, (int(bar.max()) + 1 - lengths[0]) // step + 1) if len(bar) else 0
        if n_windows <= 0:
            return
        inside = bar < (width := (n_windows - 1) * step + lengths[-1])
        logs = np.full((len(symbols), width), np.nan)
        logs[np.repeat(row, sizes)[inside], bar[inside]] = values.flatten().to_numpy(zero_copy_only=False)[inside]
        piece = np.unique(row, return_index=True)[1]
        block, shift = column("block").to_numpy()[piece], column("shift").to_numpy()[piece]
        del table, keys, values, bar, inside
        own = np.flatnonzero(block != -1)
        at = np.flatnonzero(block == -1)
        if not len(at):
            return
        one, other = (np.flatnonzero(block[own] == k) for k in (a, b))
        sides = [(one, other), (other, one)] if a != b else [(one, one)]
        yield from _block([symbols[i] for i in own], shift[own], logs[own], logs[at[0]], sides, chunk_ * chunk, n_windows, step, lengths, vols, cap, limits)

    out = dealt.groupBy("chunk", "block_a", "block_b").applyInArrow(work, ROW)
    half = F.when((F.col("phi") > 0) & (F.col("phi") < 1) & (F.col("n") >= 10), F.bround(-F.log(F.lit(2.0)) / F.log("phi"), 2))
    z = F.when(F.col("s_std") > 0, (F.col("s_last") - F.col("s_mean")) / F.col("s_std"))
    return out.withColumn("half_life", half).withColumn("z", z)

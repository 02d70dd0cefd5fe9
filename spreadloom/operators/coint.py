"""Engle-Granger cointegration of pair windows, and relations that build on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.numeric import normal_cdf, ratio
from spreadloom.operators.stats import KEYS, pair_keys

# Response surfaces of MacKinnon (1994, 2010) for two variables with a constant, as remembered, not compared
# with the papers; the rejection rates in tests back the critical values only.
CRITICAL = {1: (-3.89644, -10.9519, -22.527), 5: (-3.33613, -6.1101, -6.823), 10: (-3.04445, -4.2412, -2.720)}
SMALL_P = (2.92, 1.5012, 0.039796)
LARGE_P = (2.1945, 0.64695, -0.29198, -0.042377)
LOWEST, TURN, HIGHEST = -18.86, -2.62, 0.92

CELLS = 1 << 20  # numbers in the arrays of a slice of windows at most
NEAR = 1e-9  # share of a sum of squares below which what is left of it is rounding


def critical_value(level: int, n: Column) -> Column:
    """Critical value at 1, 5 or 10 per cent of a window of n bars."""
    c0, c1, c2 = CRITICAL[level]
    t = n.cast("double") - 1
    return F.lit(c0) + F.lit(c1) / t + F.lit(c2) / (t * t)


def p_value(t: Column) -> Column:
    poly = lambda cs: sum((F.lit(c) * F.pow(t, F.lit(float(k))) for k, c in enumerate(cs)), F.lit(0.0))
    return F.when(t <= LOWEST, 0.0).when(t >= HIGHEST, 1.0).when(t <= TURN, normal_cdf(poly(SMALL_P))).otherwise(normal_cdf(poly(LARGE_P)))


def residuals(rows: DataFrame) -> DataFrame:
    """u: what a least-squares line of la on lb (with intercept) leaves, per pair and window."""
    whole = Window.partitionBy(*pair_keys(rows))
    return rows.withColumn("u", F.col("la") - F.regr_intercept("la", "lb").over(whole) - F.regr_slope("la", "lb").over(whole) * F.col("lb"))


def lag0_statistic(rows: DataFrame) -> DataFrame:
    """a, b, window_id, n, t: the Dickey-Fuller t of the residuals without lagged differences, in built-ins only. A window
    whose residuals are all zero (collinear legs) has t = -infinity as its limit; it is given as -1e9."""
    u = residuals(rows).withColumn("u1", F.lag("u").over(Window.partitionBy(*pair_keys(rows)).orderBy("bar_idx"))).withColumn("du", F.col("u") - F.col("u1"))
    g = u.groupBy(*pair_keys(rows)).agg(F.count("*").alias("n"), F.count("du").alias("m"), F.sum(F.col("u1") * F.col("du")).alias("xy"), F.sum(F.when(F.col("du").isNotNull(), F.col("u1") * F.col("u1"))).alias("xx"), F.sum(F.col("du") * F.col("du")).alias("yy"), F.max(F.abs("u")).alias("size"))
    slope = ratio(F.col("xy"), F.col("xx"))
    error = F.sqrt(ratio(F.greatest(F.col("yy") - slope * F.col("xy"), F.lit(0.0)), F.col("m") - 1))
    t = F.when(F.col("size") < 1e-10, F.lit(-1e9)).otherwise(ratio(slope * F.sqrt("xx"), error))
    return g.select(*KEYS, "n", t.alias("t"))


def _most_lags(n: int) -> int:
    return max(0, min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3))


def _at_once(n: int) -> int:
    """Windows of n bars taken together, so that their residuals, differences and cross products fill CELLS numbers at most."""
    return max(1, CELLS // (2 * n + 3 * (_most_lags(n) + 2) ** 2))


def _products(u: np.ndarray, du: np.ndarray, top: int, start: int) -> np.ndarray:
    """Cross products of (u, du lagged by 1 .. top, du) of each row over the bars from `start` on, at least `top`. Only the
    first row of lagged products is summed; the next ones differ from it by a bar at either end."""
    n = u.shape[1]
    y, level = du[:, start:], u[:, start:-1]
    lags = np.empty((len(u), top + 1, top + 1))
    for k in range(top + 1):
        lags[:, 0, k] = lags[:, k, 0] = np.einsum("bi,bi->b", y, du[:, start - k : n - 1 - k])
    for j in range(top):
        k = np.arange(j, top)
        lags[:, j + 1, k + 1] = lags[:, j, k] + du[:, [start - 1 - j]] * du[:, start - 1 - k] - du[:, [n - 2 - j]] * du[:, n - 2 - k]
        lags[:, k + 1, j + 1] = lags[:, j + 1, k + 1]
    out = np.empty((len(u), top + 2, top + 2))
    order = [*range(1, top + 1), 0]
    out[:, 1:, 1:] = lags[:, order][:, :, order]
    out[:, 0, 0] = np.einsum("bi,bi->b", level, level)
    for k in range(top + 1):
        at = k if k else top + 1
        out[:, 0, at] = out[:, at, 0] = np.einsum("bi,bi->b", level, du[:, start - k : n - 1 - k])
    return out


def _factor(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower triangular factors of the matrices, and whether no column but the last is close to a mix of those before it."""
    low, sound = np.zeros_like(gram), np.ones(len(gram), bool)
    for j in range(gram.shape[1]):
        pivot = gram[:, j, j] - (low[:, j, :j] ** 2).sum(1)
        if j < gram.shape[1] - 1:
            sound &= pivot > NEAR * gram[:, j, j]
        low[:, j, j] = np.sqrt(np.where(sound & (pivot > 0), pivot, 1.0))
        low[:, j + 1 :, j] = (gram[:, j + 1 :, j] - np.einsum("bik,bk->bi", low[:, j + 1 :, :j], low[:, j, :j])) / low[:, j, j, None]
    return low, sound


def _aic_batch(u: np.ndarray) -> np.ndarray:
    """t of every row of residuals; the number of lagged differences is the one of smallest AIC on the common sample.

    One factorisation of a window's cross products, the level first and the lags after it, gives the fits of all lags: each
    lag takes the square of its entry in the last row off the sum of squares. With the level last, t of the chosen fit stands in
    the same row. Windows whose regressors depend on each other, or whose fit is all but perfect, are fitted on their bars.
    """
    n_rows, n = u.shape
    top = _most_lags(n)
    du = np.diff(u, axis=1)
    m, t = n - 1 - top, np.full(n_rows, np.nan)
    with np.errstate(all="ignore"):
        gram = _products(u, du, top, top)
        low, sound = _factor(gram)
        left = gram[:, -1, -1, None] - np.cumsum(low[:, -1, :-1] ** 2, axis=1)
        sound &= left[:, -1] > NEAR * gram[:, -1, -1]
        best = (m * np.log(np.maximum(left, 1e-300) / m) + 2 * np.arange(1, top + 2)).argmin(1)
        for p in np.unique(best[sound]):
            rows = np.flatnonzero(sound & (best == p))
            own = _products(u[rows], du[rows], p, p)
            order = [*range(1, p + 1), 0, p + 1]
            low, fine = _factor(own[:, order][:, :, order])
            rest = own[:, -1, -1] - (low[:, -1, :-1] ** 2).sum(1)
            sound[rows] = fine = fine & (rest > NEAR * own[:, -1, -1])
            t[rows[fine]] = (low[:, -1, -2] / np.sqrt(rest / (n - 1 - p - p - 1)))[fine]
    some = max(1, CELLS // (n * (top + 2)))
    odd = np.flatnonzero(~sound)
    for s in range(0, len(odd), some):
        t[odd[s : s + some]] = _aic_by_design(u[odd[s : s + some]])
    return np.where(np.abs(u).max(1) < 1e-10, -1e9, t)


def _aic_by_design(u: np.ndarray) -> np.ndarray:
    """The same t from the regressors of every bar, by pseudo-inverses, for windows that a factorisation can't settle."""
    n_rows, n = u.shape
    top = _most_lags(n)
    du = np.diff(u, axis=1)

    def design(p: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack([u[:, start:-1]] + [du[:, start - k : n - 1 - k] for k in range(1, p + 1)], axis=2)
        return x, du[:, start:]

    x, y = design(top, top)
    gram, xy, yy, m = np.einsum("bij,bik->bjk", x, x), np.einsum("bij,bi->bj", x, y), (y * y).sum(1), y.shape[1]
    aic = np.full((n_rows, top + 1), np.inf)
    for p in range(top + 1):
        beta = np.einsum("bij,bj->bi", np.linalg.pinv(gram[:, : p + 1, : p + 1], hermitian=True), xy[:, : p + 1])
        ssr = np.maximum(yy - (beta * xy[:, : p + 1]).sum(1), 1e-300)
        aic[:, p] = m * np.log(ssr / m) + 2 * (p + 1)
    best, t = aic.argmin(1), np.empty(n_rows)
    for p in np.unique(best):
        rows = best == p
        x, y = design(p, p)
        x, y = x[rows], y[rows]
        inverse = np.linalg.pinv(np.einsum("bij,bik->bjk", x, x), hermitian=True)
        beta = np.einsum("bij,bj->bi", inverse, np.einsum("bij,bi->bj", x, y))
        rest = y - np.einsum("bij,bj->bi", x, beta)
        var = (rest * rest).sum(1) / (y.shape[1] - p - 1)
        with np.errstate(all="ignore"):
            t[rows] = beta[:, 0] / np.sqrt(var * inverse[:, 0, 0])
    return t


def aic_statistic(rows: DataFrame) -> DataFrame:
    """As `lag0_statistic`, with lagged differences chosen by AIC. A pair window travels as one array of its residuals."""
    arrays = residuals(rows).groupBy(*pair_keys(rows)).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("bar_idx", "u"))), lambda x: x["u"]).alias("u"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*KEYS, "n"]].assign(t=np.nan)
            for n, part in batch.groupby("n"):
                for s in range(0, len(part) if n >= 10 else 0, some := _at_once(n)):
                    rows = part.iloc[s : s + some]
                    out.loc[rows.index, "t"] = _aic_batch(np.stack(rows["u"].to_list()).astype(float))
            yield out

    found = arrays.mapInPandas(work, "a string, b string, window_id long, n long, t double")
    return found.withColumn("t", F.when(~F.isnan("t"), F.col("t")))


def engle_granger(rows: DataFrame, lags: str = "aic") -> DataFrame:
    """a, b, window_id, n, t, p, crit1, crit5, crit10 of every pair window in rows (a, b, window_id, bar_idx, la, lb)."""
    s = {"aic": aic_statistic, "lag0": lag0_statistic}[lags](rows)
    return s.withColumn("p", p_value(F.col("t"))).withColumns({f"crit{k}": critical_value(k, F.col("n")) for k in CRITICAL})


def coint_flag(max_half_life: float = 200.0) -> Column:
    ok = (F.col("p") < 0.05) & (F.col("t") < F.col("crit5")) & (F.col("half_life") > 0) & (F.col("half_life") <= max_half_life)
    return F.coalesce(ok, F.lit(False))


def coint_transitions(flags: DataFrame) -> DataFrame:
    """Windows (a, b, window_id, coint) where a relationship starts, breaks or comes back: change is 'start', 'break' or 'return'."""
    order = Window.partitionBy("a", "b").orderBy("window_id")
    seen = F.max(F.col("coint").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    change = F.when(F.col("coint") & F.coalesce(seen == 0, F.lit(True)), "start").when(F.col("coint") & ~F.lag("coint").over(order), "return").when(~F.col("coint") & F.lag("coint").over(order), "break")
    return flags.withColumn("change", change).filter("change is not null")


def pair_corr(rows: DataFrame) -> DataFrame:
    """Correlation of the legs' log returns in every pair window."""
    order = Window.partitionBy(*pair_keys(rows)).orderBy("bar_idx")
    r = rows.withColumn("ra", F.col("la") - F.lag("la").over(order)).withColumn("rb", F.col("lb") - F.lag("lb").over(order))
    return r.groupBy(*pair_keys(rows)).agg(F.corr("ra", "rb").alias("corr")).select(*KEYS, "corr")


def hurst(series: DataFrame, lags: tuple[int, ...] = (2, 4, 8, 16, 32)) -> DataFrame:
    """Hurst exponent of each symbol: slope of the log deviation of lagged differences on the log of the lag."""
    order = Window.partitionBy("symbol").orderBy("bar_idx")
    moved = series.select("symbol", *[(F.col("logp") - F.lag("logp", k).over(order)).alias(f"k{k}") for k in lags])
    wide = moved.groupBy("symbol").agg(*[F.stddev_samp(f"k{k}").alias(f"k{k}") for k in lags])
    long = wide.unpivot(["symbol"], [f"k{k}" for k in lags], "lag", "std").filter("std > 0")
    return long.groupBy("symbol").agg(F.regr_slope(F.log("std"), F.log(F.substring("lag", 2, 9).cast("double"))).alias("hurst"))

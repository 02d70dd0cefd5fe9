"""Column helpers: missing values are NULL, never NaN; division by zero is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def price_from_log(logp: Column, shift: Column) -> Column:
    return F.greatest(F.exp(logp) - shift, F.lit(1e-9))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, error under 7.5e-8 (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    # Fixed values of the approximation.
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x < 0, tail).otherwise(1 - tail)

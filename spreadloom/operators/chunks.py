"""Running values over an order without a task that holds all of it: an associative scan by chunks.

Rows fall into chunks of the order by a fixed function of their place. Every chunk is scanned on its own, its total is one
row, and only these rows are ordered as a whole; what came before a chunk is carried into it. A chunk is a stretch of time or
a run of bars, so a task holds at most as many rows (of one `by` group) as bars fit into it, however long the history.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BARS = 4096  # bars in a chunk of the bar index
DAYS = 90  # days in a chunk of time


def bar_chunk(bar: str = "bar_idx", bars: int = BARS) -> Column:
    return F.expr(f"floor(`{bar}` / {bars})").cast("long")


def time_chunk(ts: str = "ts", days: float = DAYS) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(days * 86400.0)).cast("long")


class Carry(NamedTuple):
    """A running value: sum, max, count and last (not null) of `value` over the rows up to the present one, or before it
    where `before`; lag is the value of the row before."""

    kind: str
    value: Column
    before: bool = False


def carried(rows: DataFrame, order: str, chunk: Column, carries: dict[str, Carry], by: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with a column for each of `carries`, in `order` within `by`; null where no row counts (count: 0).

    `chunk` must not fall as `order` rises. Places of equal `order` are taken in any order, as in a window. A null order
    comes first; rows with a null in `by` are left out. `rows` are read twice: for the totals, after a partial aggregate, and for the result. Rows that come from an aggregate by
    `order` share its exchange; others are better settled first.
    """
    x = rows.withColumn("_chunk", F.coalesce(chunk, F.lit(-(2**63))))
    place = Window.partitionBy(*by, "_chunk").orderBy(order)
    ahead = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals, offsets, out = [], {}, {}
    for name, c in carries.items():
        so_far = place.rowsBetween(Window.unboundedPreceding, -1 if c.before else 0)
        t, offset = f"_t_{name}", F.col(f"_o_{name}")
        at = F.struct(F.col(order).alias("at"))
        if c.kind == "sum":
            own = F.sum(c.value).over(so_far)
            totals.append(F.sum(c.value).alias(t))
            offsets[name], out[name] = F.sum(t).over(ahead), F.when(own.isNotNull() | offset.isNotNull(), F.coalesce(offset, F.lit(0)) + F.coalesce(own, F.lit(0)))
        elif c.kind == "count":
            totals.append(F.count(c.value).alias(t))
            offsets[name], out[name] = F.sum(t).over(ahead), F.coalesce(offset, F.lit(0)) + F.count(c.value).over(so_far)
        elif c.kind == "max":
            totals.append(F.max(c.value).alias(t))
            offsets[name], out[name] = F.max(t).over(ahead), F.greatest(offset, F.max(c.value).over(so_far))
        elif c.kind == "last":
            totals.append(F.max_by(c.value, F.when(c.value.isNotNull(), at)).alias(t))
            offsets[name], out[name] = F.last(t, True).over(ahead), F.coalesce(F.last(c.value, True).over(so_far), offset)
        elif c.kind == "lag":
            totals.append(F.max_by(c.value, at).alias(t))
            offsets[name] = F.lag(t).over(Window.partitionBy(*by).orderBy("_chunk"))
            out[name] = F.when(F.row_number().over(place) == 1, offset).otherwise(F.lag(c.value).over(place))
        else:
            raise ValueError(f"unknown running value {c.kind}")
    sums = x.groupBy(*by, "_chunk").agg(*totals)
    sums = sums.select(*by, "_chunk", *[c.alias(f"_o_{n}") for n, c in offsets.items()])
    return x.join(sums, [*by, "_chunk"]).select(*rows.columns, *[c.alias(n) for n, c in out.items()])


def with_halo(rows: DataFrame, n: int, place: str, bars: int = BARS) -> DataFrame:
    """Rows copied to each run of `bars` places in which a frame of n rows may need them: `_part` is the run, `_own` is false
    for the copies. `place` numbers the rows of each group without gaps; a run holds at most bars + n - 1 of a group's rows, and
    `rows` are read once."""
    first, last = F.expr(f"`{place}` div {bars}"), F.expr(f"(`{place}` + {n - 1}) div {bars}")
    return rows.withColumn("_part", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_part") == first)

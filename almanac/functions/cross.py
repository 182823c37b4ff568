"""Columns over the cross-section of a date, and over an instrument's past."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def past(key: str = "inst", order: str = "t"):
    return W.partitionBy(key).orderBy(order)


def trailing(w: int, key: str = "inst", order: str = "t"):
    """The last w calendar positions, the current one included."""
    return past(key, order).rowsBetween(-(w - 1), 0)


def full(agg, x: Column, w: int, frame) -> Column:
    """An aggregate of a trailing window, null unless each of its w positions has a value."""
    return F.when(F.count(x).over(frame) == w, agg(x).over(frame))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (an infinity would end as null)."""
    return F.when(b != 0, a / b)


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers divide: infinite over 0, null for 0 / 0 and where either is null."""
    return F.when(b != 0, a / b).when((b == 0) & (a > 0), float("inf")).when((b == 0) & (a < 0), float("-inf"))


def mean_rank(x: Column, *by) -> Column:
    """Rank with ties averaged, within the groups; rows without a value have none and do not count. One sort gives the rank and its ties."""
    w = W.partitionBy(*by).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), F.rank().over(w) + (F.count("*").over(w.rangeBetween(W.currentRow, W.currentRow)) - 1) / 2)


def percent_rank(x: Column, *by) -> Column:
    return mean_rank(x, *by) / F.count(x).over(W.partitionBy(*by))


def standard(x: Column, *by) -> Column:
    """Mean 0 and population deviation 1 within the groups; null where nothing varies."""
    w = W.partitionBy(*by)
    return ratio(x - F.avg(x).over(w), F.stddev_pop(x).over(w))


def pearson(a: str, b: str, least: int) -> Column:
    """Correlation of a group's pairs; null under `least` pairs or where one side is constant."""
    scale = F.stddev_samp(a) * F.stddev_samp(b)
    return F.when((F.count("*") >= least) & (scale > 0), F.covar_samp(a, b) / F.nullif(scale, F.lit(0.0)))

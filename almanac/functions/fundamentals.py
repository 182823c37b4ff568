"""Columns of published statements and of what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions.cross import full, past, ratio, trailing

#: Industry codes and the first words of older labels that mean the financial sector, and the mark of an older label.
FINANCIAL_CODES = ("J66", "J67", "J68", "J69")
FINANCIAL_WORDS = ("金融保险业", "金融业")
LEGACY = "LEGACY:"


def positive_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def lagged_yield(x: Column) -> Column:
    """1 / x of the calendar date before, where that is positive."""
    before = F.lag(x).over(past())
    return F.when(before > 0, 1 / before)


def illiquidity(returns: str = "returns", amount: str = "amount", dates: int = 20) -> Column:
    """log(1 + a million times the mean of |return| over amount) of the last dates, which must all have both; amounts of 0 are missing."""
    move = ratio(F.abs(returns), F.when(F.col(amount) > 0, F.col(amount)))
    return F.log1p(full(F.avg, move, dates, trailing(dates)) * 1e6)


def close_to(a: Column, b: Column, relative: float = 2e-5, absolute: float = 2e-5) -> Column:
    """Whether a is within absolute + relative * |b| of b; not symmetric."""
    return F.abs(a - b) <= F.lit(absolute) + F.lit(relative) * F.abs(b)


def cash_surplus(cash_to_sales: Column, cash_to_profit: Column, margin: Column) -> Column:
    """Cash from operations less profit, as shares of sales, where the three ratios agree with each other."""
    return F.when(close_to(cash_to_profit * margin, cash_to_sales), cash_to_sales - margin)


def signed_log(x: Column) -> Column:
    """The sign of a percentage times log(1 + |x| / 100)."""
    return F.signum(x) * F.log1p(F.abs(x) / 100)


def industry_key(label: Column) -> Column:
    """The letter and two digits that a label begins with, else the label behind LEGACY:; null for an empty one. A label without either a code or a Chinese character fails the query."""
    s = F.trim(label)
    code = F.nullif(F.regexp_extract(s, r"^([A-S]\d{2})", 1), F.lit(""))
    sound = s.rlike("[\\x{4e00}-\\x{9fff}]") & ~s.contains("�")
    old = F.when(sound, F.concat(F.lit(LEGACY), s)).otherwise(F.raise_error(F.lit("unrecognized industry label")))
    return F.when(s.isNull() | (s == ""), None).when(code.isNotNull(), code).otherwise(old)


def is_financial(key: Column) -> Column:
    """Whether an industry key is of the financial sector, by code or by the first part of an older label."""
    old = F.element_at(F.split(F.replace(key, F.lit(LEGACY), F.lit("")), "-", 2), 1)
    return F.coalesce(key.isin(*FINANCIAL_CODES) | (key.startswith(LEGACY) & old.isin(*FINANCIAL_WORDS)), F.lit(False))


def regime(level: Column, dates: int = 60, edge: float = 0.05) -> Column:
    """bull, bear or sideways by the change of a benchmark level over so many rows of the window's order; null before them."""
    from pyspark.sql import Window as W

    change = level / F.lag(level, dates).over(W.orderBy("dt")) - 1
    return F.when(change > edge, "bull").when(change < -edge, "bear").when(change.isNotNull(), "sideways")

"""Checks that refuse bad input: each returns its violations as rows (rule, n), one aggregation over the data; `refuse` raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class ValidationError(ValueError):
    pass


def refuse(*violations: DataFrame) -> None:
    """Raise if any rule is broken. Only the rules come to the driver."""
    found = [(r.rule, r.n) for v in violations for r in v.collect() if r.n]
    if found:
        raise ValidationError("; ".join(f"{rule}: {n}" for rule, n in found))


def counted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule. A rule that is null does not count."""
    one = df.agg(*(F.count_if(c).alias(k) for k, c in rules.items()))
    return one.unpivot([], list(rules), "rule", "n")


def bad_number(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))


def bar_violations(bars: DataFrame, index: str = "SH000300") -> DataFrame:
    """Raw bars (instrument, dt, prices, volume, amount, tradestatus, isST): repeated bars, missing status, and prices, volumes and amounts that a traded bar cannot have."""
    prices = ("open", "high", "low", "close")
    on = F.coalesce((F.col("tradestatus") == 1) | (F.col("instrument") == index), F.lit(False)) & (F.coalesce("volume", F.lit(0.0)) > 0)
    wrong = reduce(lambda a, b: a | b, (bad_number(c) | (F.col(c) <= 0) for c in prices))
    order = (F.col("high") < F.greatest(*prices)) | (F.col("low") > F.least(*prices))
    x = bars.withColumn("_again", F.row_number().over(W.partitionBy("instrument", "dt").orderBy(F.lit(1))) > 1)
    return counted(x, {
        "duplicate_bar": F.col("_again"),
        "missing_status": (F.col("instrument") != index) & (F.col("tradestatus").isNull() | F.col("isST").isNull()),
        "invalid_active_price": on & wrong,
        "invalid_price_order": on & order,
        "missing_traded_volume_or_amount": on & (F.col("volume").isNull() | F.col("amount").isNull()),
        "negative_volume_or_amount": (F.col("volume") < 0) | (F.col("amount") < 0),
    })


def factor_violations(factors: DataFrame, instruments: DataFrame) -> DataFrame:
    """Adjustment factors (code, effective_date, factor): repeated dates, values that are not positive numbers, codes that only factors have."""
    x = factors.withColumn("_again", F.row_number().over(W.partitionBy("code", "effective_date").orderBy(F.lit(1))) > 1)
    known = instruments.select("code", F.lit(True).alias("_known")).distinct()
    x = x.join(known, "code", "left")
    return counted(x, {"duplicate_date": F.col("_again"), "invalid_factor": bad_number("factor") | (F.col("factor") <= 0), "unknown_code": F.col("_known").isNull()})


def membership_violations(snapshots: DataFrame, calendar: DataFrame, size: int | None = None) -> DataFrame:
    """Snapshots (dt, code, updated): dates without one, dates off the calendar, repeated members, updates after the date, dates of another size."""
    days = snapshots.groupBy("dt").agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"), F.count_if(F.to_date("updated") > F.col("dt")).alias("future"))
    both = calendar.select("dt", F.lit(True).alias("_day")).distinct().join(days, "dt", "full_outer")
    rules = {"missing_date": F.col("n").isNull(), "date_off_calendar": F.col("_day").isNull(), "duplicate_member": F.col("n") > F.col("codes"), "future_update": F.col("future") > 0}
    if size is not None:
        rules["wrong_size"] = F.col("codes") != size
    return counted(both, rules)


def period_violations(df: DataFrame, at: str, protected) -> DataFrame:
    """Observations on or after the first protected date."""
    return counted(df, {"protected_period": F.col(at) >= F.lit(protected).cast("date")})


def prediction_violations(predictions: DataFrame, labels: DataFrame, dates: DataFrame) -> DataFrame:
    """Scores (dt, inst, score) against labels (dt, inst, label) and the expected dates: repeated or non-finite scores, rows that only one side has, dates that are missing or unexpected."""
    p = predictions.withColumn("_again", F.row_number().over(W.partitionBy("dt", "inst").orderBy(F.lit(1))) > 1)
    both = p.withColumn("_p", F.lit(True)).join(labels.select("dt", "inst", F.lit(True).alias("_l")).distinct(), ["dt", "inst"], "full_outer")
    rows = counted(both, {"duplicate_prediction": F.col("_again"), "nonfinite_prediction": F.col("_p") & bad_number("score"), "not_aligned": F.col("_p").isNull() | F.col("_l").isNull()})
    days = predictions.select("dt", F.lit(True).alias("_p")).distinct().join(dates.select("dt", F.lit(True).alias("_d")).distinct(), "dt", "full_outer")
    empty = predictions.agg((F.count("*") == 0).cast("long").alias("n")).select(F.lit("empty").alias("rule"), "n")
    return rows.unionByName(counted(days, {"date_coverage": F.col("_p").isNull() | F.col("_d").isNull()})).unionByName(empty)


def report_violations(daily: DataFrame) -> DataFrame:
    """A portfolio report (dt, ret, bench, cost, turnover): repeated dates, non-finite values, negative turnover or cost, trading without cost, losses of everything."""
    x = daily.withColumn("_again", F.row_number().over(W.partitionBy("dt").orderBy(F.lit(1))) > 1)
    wrong = reduce(lambda a, b: a | b, map(bad_number, ("ret", "bench", "cost", "turnover")))
    return counted(x, {"duplicate_date": F.col("_again"), "nonfinite": wrong, "negative_turnover": F.col("turnover") < 0, "cost": (F.col("cost") < 0) | ((F.col("turnover") > 0) & (F.col("cost") <= 0)), "ruin": F.col("ret") - F.col("cost") <= -1})


def off_schedule(daily: DataFrame, schedule: DataFrame) -> DataFrame:
    """Dates with costs that are not dates of trading."""
    return daily.where("cost <> 0").join(schedule.select("dt"), "dt", "left_anti")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, columns...): rows that only one of two tables has, repeats counted. Empty if they are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def one_to_one(a: DataFrame, b: DataFrame, on: list[str], suffix: str = "_right") -> DataFrame:
    """Inner join of two tables that must have each key once; a repeated key fails the query. Columns that both have get the suffix on the right."""

    def once(df: DataFrame) -> DataFrame:
        n = F.count("*").over(W.partitionBy(*on))
        return df.withColumn("_once", F.when(n > 1, F.raise_error(F.lit("a key is repeated"))).otherwise(F.lit(True))).where("_once").drop("_once")

    shared = (set(a.columns) & set(b.columns)) - set(on)
    return once(a).join(once(b.withColumnsRenamed({c: c + suffix for c in shared})), on)

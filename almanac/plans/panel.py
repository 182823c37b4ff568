"""Dense panels from bars, and the universe over time.

The standard tables stand in for a market: an instrument is a supplier, a date is a month, a bar is the
supplier's shipped lines of the month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.functions.cross import past, ratio, trailing
from almanac.sources.tables import table


def bars(spark: SparkSession, sf_dir: str, every: str = "month") -> DataFrame:
    """(inst, dt, open, high, low, close, vwap, volume, amount). Sums are decimal, so they do not depend on the order of rows; open is the price of the first line."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    total = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double")
    first = F.min_by(price, F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("inst"), F.trunc("l_shipdate", every).alias("dt"))
    return out.agg(total("l_extendedprice").alias("amount"), total("l_quantity").alias("volume"), F.max(price).alias("high"), F.min(price).alias("low"), first.alias("open")).withColumn("close", ratio(F.col("amount"), F.col("volume"))).withColumn("vwap", F.col("close"))


def calendar(dates: DataFrame) -> DataFrame:
    """(dt, t): the ordered distinct dates, a few thousand at most."""
    return dates.select("dt").distinct().withColumn("t", F.row_number().over(W.orderBy("dt")))


def dense(bars_: DataFrame, instruments: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """A row for each date and instrument; fields are null where there is no bar. `dates` (dt), by default the bars', become an array in each instrument's row."""
    days = calendar(bars_ if dates is None else dates).agg(F.sort_array(F.collect_list(F.struct("t", "dt"))).alias("d")).select("d").scalar()
    grid = instruments.select("inst", F.explode(days).alias("d")).select("d.dt", "d.t", "inst")
    return grid.join(bars_, ["dt", "inst"], "left")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense monthly panel with returns, turnover (volume against the trailing year) and membership."""
    dates = table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("dt"))
    p = dense(bars(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("inst")), dates)
    p = p.withColumn("returns", ratio(F.col("close"), F.lag("close").over(past())) - 1)
    p = p.withColumn("turnover", ratio(F.col("volume"), F.sum("volume").over(trailing(12))))
    p = p.withColumn("_before", F.lag("amount").over(past()))
    place = F.row_number().over(W.partitionBy("dt").orderBy(F.desc_nulls_last("_before"), "inst"))
    held = F.count("_before").over(W.partitionBy("dt"))
    return p.withColumn("is_member", F.col("_before").isNotNull() & (place <= F.ceil(held * 0.6))).drop("_before")


def intervals(members: DataFrame) -> DataFrame:
    """(inst, start_dt, end_dt): closed intervals of membership over the calendar; leaving and coming back gives two."""
    island = F.col("t") - F.row_number().over(past())
    return members.where("is_member").select("inst", "dt", "t").withColumn("island", island).groupBy("inst", "island").agg(F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt")).drop("island")


def expand(intervals_: DataFrame, dates: DataFrame) -> DataFrame:
    """(dt, inst) of each calendar date (dt, t) within an interval: its ends become positions and every position a row, so all joins are equalities."""
    at = lambda c: dates.select(F.col("dt").alias(f"{c}_dt"), F.col("t").alias(f"_{c}"))
    rows = intervals_.join(at("start"), "start_dt").join(at("end"), "end_dt").select("inst", F.explode(F.sequence("_start", "_end")).alias("t"))
    return rows.join(dates.select("dt", "t"), "t").select("dt", "inst")


def eligible(panel: DataFrame, limit: float = 0.095) -> DataFrame:
    """exec_ok: traded, and the change is within the limit in both directions, compared as 32-bit numbers."""
    change, edge = F.col("returns").cast("float"), F.lit(limit).cast("float")
    return panel.withColumn("exec_ok", F.col("close").isNotNull() & (F.col("close") > 0) & F.coalesce(~((change >= edge) | (change <= -edge)), F.lit(True)))


def yearly_unions(panel: DataFrame) -> DataFrame:
    """(year, members, stayed, left_next_year): instruments that were members at any time of a year, and of these the ones that were at any time of the next."""
    ever_ = panel.where("is_member").select("inst", F.year("dt").alias("year")).distinct()
    next_ = ever_.select(F.col("inst").alias("_i"), (F.col("year") - 1).alias("_y"))
    both = ever_.join(next_, (F.col("inst") == F.col("_i")) & (F.col("year") == F.col("_y")), "left")
    return both.groupBy("year").agg(F.count("*").alias("members"), F.count("_i").alias("stayed"), (F.count("*") - F.count("_i")).alias("left_next_year"))


def changes(panel: DataFrame) -> DataFrame:
    """(dt, entered, left): members that were none on the calendar date before, and the reverse."""
    was = F.coalesce(F.lag("is_member").over(past()), F.lit(False))
    return panel.withColumn("_was", was).groupBy("dt").agg(F.count_if(F.col("is_member") & ~F.col("_was")).alias("entered"), F.count_if(F.col("_was") & ~F.col("is_member")).alias("left"))


def ever(panel: DataFrame, mask) -> DataFrame:
    """(inst): instruments for which a mask holds on any date."""
    return panel.groupBy("inst").agg(F.bool_or(mask).alias("_ever")).where("_ever").select("inst")

"""As-of and interval joins by slices of time: a key's line is cut, so that no task holds the whole of a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Days of a slice of time. A key's rows are dealt out by slice, so that a hot key is many tasks.
SLICE = 366


def cell(at: Column, width: int) -> Column:
    """The number of the slice of time, `width` days long, in which a date or time lies."""
    return F.floor(F.unix_date(at.cast("date")) / width)


def asof(signals: DataFrame, events: DataFrame, key: str, on: str, at: str, values: list[str], strict: bool = True, max_age: int | None = None, width: int = SLICE) -> DataFrame:
    """signals with the latest event's `at` and values; strict takes events before the signal's date only.

    The newest event wins even where its value is null, and is dropped whole when it is older than max_age days.
    Of events of one date the last by values counts. Signals without a key or date have none, and events without
    either are never taken.

    Two levels: the last event of each key and slice is repeated at the head of the slices that follow, up to the next one with
    an event, and signals, events and heads are filled forward within their slice alone. So the largest task is a
    slice of a key, and rows are shuffled once.
    """
    event = F.struct(F.col(at).alias("at"), *(F.col(v).alias(v) for v in values))
    told = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), cell(F.col(at), width).alias("_c"), F.col(at).alias("_d"), F.lit(1 if strict else 0).alias("_o"), event.alias("_e"))
    rows = signals.select(F.col(key), cell(F.col(on), width).alias("_c"), F.col(on).alias("_d"), F.lit(0 if strict else 1).alias("_o"), F.lit(None).cast(told.schema["_e"].dataType).alias("_e"), F.struct(*signals.columns).alias("_s"))
    newest = told.groupBy(key, "_c").agg(F.max("_e").alias("_e"))
    ends = [F.coalesce(F.lead("_c").over(W.partitionBy(key).orderBy("_c")), signals.select(cell(F.max(on), width)).scalar())]
    if max_age is not None:
        ends.append(cell(F.date_add(F.col("_e.at").cast("date"), max_age), width))
    until = F.least(*ends) if len(ends) > 1 else ends[0]
    heads = newest.withColumn("_u", until).where("_u > _c").select(key, F.explode(F.sequence(F.col("_c") + 1, F.col("_u"))).alias("_c"), F.lit(None).cast(told.schema["_d"].dataType).alias("_d"), F.lit(-1).alias("_o"), "_e")
    w = W.partitionBy(key, "_c").orderBy("_d", "_o", "_e").rowsBetween(W.unboundedPreceding, 0)
    sources = told.unionByName(heads).withColumn("_s", F.lit(None).cast(rows.schema["_s"].dataType))
    out = rows.unionByName(sources).withColumn("_e", F.last("_e", ignorenulls=True).over(w)).where("_s is not null")
    fresh = F.lit(True) if max_age is None else F.datediff("_d", "_e.at") <= max_age
    return out.select("_s.*", *(F.when(fresh, F.col(f"_e.{v}")).alias(v) for v in ["at", *values]))


def repeated_periods(events: DataFrame, key: str, published: str, period: str) -> DataFrame:
    """Keys that fiscal precedence cannot order: two events of one publication date and period, or a period after its publication."""
    same = events.groupBy(key, published, period).agg(F.count("*").alias("n"))
    return same.select(key, published, period, F.when(F.col("n") > 1, "duplicate_period").when(F.col(period) > F.col(published), "period_after_publication").alias("reason")).where("reason is not null")


def current_periods(events: DataFrame, key: str, published: str, period: str, order: str | None = None, width: int = SLICE) -> DataFrame:
    """Events that are not behind: of each publication date the newest period, and none older than one published before.

    Without `order`, two events of one publication date and period, or a period after its publication, are refused
    when the rows are read; with it the highest `order` counts and nothing is refused. Events without a key or publication date
    are never known and do not come.
    """
    if order is None:
        n = F.count("*").over(W.partitionBy(key, published, period))
        bad = (n > 1) | (F.col(period) > F.col(published))
        events = events.withColumn("_ok", F.when(bad, F.raise_error(F.lit("ambiguous or impossible fiscal period"))).otherwise(F.lit(True))).where("_ok").drop("_ok")
        order = period
    # The newest period of the slices before heads each slice, so one window within slices does the rest.
    kind = lambda c: events.schema[c].dataType
    rows = events.where(F.col(key).isNotNull() & F.col(published).isNotNull()).select(F.col(key).alias("_k"), cell(F.col(published), width).alias("_c"), F.col(published).alias("_p"), F.col(period).alias("_q"), F.col(order).alias("_r"), F.struct(*events.columns).alias("_e"))
    ahead = W.partitionBy("_k").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    heads = rows.groupBy("_k", "_c").agg(F.max("_q").alias("_q")).select("_k", "_c", F.lit(None).cast(kind(published)).alias("_p"), F.max("_q").over(ahead).alias("_q"), F.lit(None).cast(kind(order)).alias("_r"), F.lit(None).cast(rows.schema["_e"].dataType).alias("_e"))
    w = W.partitionBy("_k", "_c").orderBy("_p", F.desc("_q"), F.desc("_r"))
    newest = F.max("_q").over(w.rowsBetween(W.unboundedPreceding, 0))
    out = rows.unionByName(heads.where("_q is not null")).withColumn("_first", ~F.lag("_p").over(w).eqNullSafe(F.col("_p"))).withColumn("_m", newest)
    return out.where("_e is not null and _first and _q >= _m").select("_e.*")


def next_date(events: DataFrame, dates: DataFrame, at: str) -> DataFrame:
    """events with next_dt, the first calendar date after `at`; null beyond the end. Every row stays, also equal ones.

    The calendar becomes one row per day up to its last date, so an equality join finds the date.
    """
    following = dates.select("dt").distinct().select(F.col("dt"), F.lead("dt").over(W.orderBy("dt")).alias("next_dt")).where("next_dt is not null")
    days = following.select("next_dt", F.explode(F.sequence("dt", F.date_sub("next_dt", 1))).alias("_day"))
    first = dates.agg(F.min("dt")).scalar()
    found = events.join(days, F.col(at) == F.col("_day"), "left").drop("_day")
    return found.withColumn("next_dt", F.coalesce("next_dt", F.when(F.col(at) < first, first)))


def in_cells(intervals: DataFrame, width: int) -> DataFrame:
    """intervals once for every slice of time that they touch, as `_c`. Those that end before they start, or lack an end, touch none.

    They are to be joined by sorting: Spark takes their size for that of the intervals before they were cut, and would send all slices through the driver.
    """
    span = F.sequence(cell(F.col("start_dt"), width), cell(F.col("end_dt"), width))
    return intervals.where("start_dt <= end_dt").withColumn("_c", F.explode(span)).hint("merge")


def within(events: DataFrame, intervals: DataFrame, key: str, at: str, width: int = 32) -> DataFrame:
    """Events whose date lies in any interval (key, start_dt, end_dt) of their key, ends included: a semi join, so none is doubled.

    Intervals are matched by key and slice of time, then tested exactly: an event meets the intervals near its date, not all of its key.
    """
    e = events.withColumn("_c", cell(F.col(at), width)).alias("e")
    i = in_cells(intervals.select(key, "start_dt", "end_dt"), width).alias("i")
    near = (F.col(f"e.{key}") == F.col(f"i.{key}")) & (F.col("e._c") == F.col("i._c"))
    return e.join(i, near & F.col(f"e.{at}").between(F.col("i.start_dt"), F.col("i.end_dt")), "left_semi").drop("_c")


def containing(events: DataFrame, intervals: DataFrame, key: str, at: str, width: int = 32) -> DataFrame:
    """Each event with each interval of its key that contains its date: columns of events, then the other columns of intervals. A date lies in one slice, so each pair comes once."""
    e = events.withColumn("_c", cell(F.col(at), width))
    i = in_cells(intervals, width).withColumnRenamed(key, "_k")
    return e.join(i, (F.col(key) == F.col("_k")) & (e["_c"] == i["_c"]) & F.col(at).between(F.col("start_dt"), F.col("end_dt"))).drop("_k", "_c")


def overlapping_pairs(left: DataFrame, right: DataFrame, key: str, width: int = 32) -> DataFrame:
    """Pairs of intervals of one key that share a date: columns of left, and those of right behind `other_`.

    A pair meets in every slice that both touch; it is kept in the one where the later of the two starts.
    """
    a = in_cells(left, width)
    b = in_cells(right, width).select(*(F.col(c).alias(f"other_{c}") for c in (*right.columns, "_c")))
    touch = (F.col("start_dt") <= F.col("other_end_dt")) & (F.col("other_start_dt") <= F.col("end_dt"))
    once = F.col("_c") == cell(F.greatest("start_dt", "other_start_dt"), width)
    return a.join(b, (F.col(key) == F.col(f"other_{key}")) & (F.col("_c") == F.col("other__c")) & touch & once).drop("_c", f"other_{key}", "other__c")


def overlapping(intervals: DataFrame, start, end) -> DataFrame:
    """Intervals that share a date with [start, end]."""
    return intervals.where((F.col("start_dt") <= F.lit(end).cast("date")) & (F.col("end_dt") >= F.lit(start).cast("date")))

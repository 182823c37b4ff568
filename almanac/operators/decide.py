"""Decisions on factors from their statistics: fixed rules over one row per factor, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The thresholds of the rules.
RULES = {"min_coverage": 0.7, "min_days": 100, "min_rank_ic": 0.01, "min_positive_ratio": 0.5, "max_pool_corr": 0.9}
METRICS = {"coverage": "min_coverage", "days": "min_days", "rank_ic": "min_rank_ic", "positive_rank_ic_ratio": "min_positive_ratio"}


def under(c: str, least: float) -> Column:
    x = F.col(c).cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < least)


def decide(stats: DataFrame, rules: dict[str, float] = RULES, missing_exposures: tuple[str, ...] = ()) -> DataFrame:
    """stats (coverage, days, rank_ic, positive_rank_ic_ratio, net_excess_annual, pool_corr) with status and reasons.

    REJECT for a metric that is missing or under its threshold, a net excess that is not positive, or a correlation of at least
    max_pool_corr with the pool of kept factors. Otherwise FORWARD if an exposure could not be measured or there is no pool, else KEEP.
    """
    gate = lambda name: F.lit(f"validation_gate:{name}")
    net = F.col("net_excess_annual").cast("double")
    bad = [F.when(under(m, rules[t]), gate(m)) for m, t in METRICS.items()]
    bad += [F.when(under("net_excess_annual", float("-inf")) | (net <= 0), gate("net_excess_annual")), F.when(F.abs("pool_corr") >= rules["max_pool_corr"], F.lit("redundant_with_existing_keep_pool"))]
    open_ = [F.lit(f"missing_exposure:{e}") for e in missing_exposures] + [F.when(F.col("pool_corr").isNull(), F.lit("existing_keep_pool_unavailable"))]
    x = stats.withColumn("_bad", F.array_compact(F.array(*bad))).withColumn("_open", F.array_compact(F.array(*open_)))
    status = F.when(F.size("_bad") > 0, "REJECT").when(F.size("_open") > 0, "FORWARD").otherwise("KEEP")
    reasons = F.when(F.size("_bad") > 0, F.col("_bad")).when(F.size("_open") > 0, F.col("_open")).otherwise(F.array(F.lit("all_validation_gates_passed")))
    return x.withColumn("status", status).withColumn("reasons", reasons).drop("_bad", "_open")


def screen_pass(yearly: DataFrame, totals: DataFrame, by: str, min_coverage: float, min_rank_ic: float, max_q: float) -> DataFrame:
    """(by, passed) from (by, year, coverage, rank_ic) and (by, rank_ic, q): every year covered and positive, the whole mean and q within their limits."""
    years = yearly.groupBy(by).agg(F.min(F.coalesce(F.col("coverage") >= min_coverage, F.lit(False))).alias("_covered"), F.min(F.coalesce(F.col("rank_ic") > 0, F.lit(False))).alias("_positive"))
    ok = F.col("_covered") & F.col("_positive") & F.coalesce(F.col("rank_ic") >= min_rank_ic, F.lit(False)) & F.coalesce(F.col("q") <= max_q, F.lit(False))
    return totals.join(years, by).select(by, ok.alias("passed"))


def supplementary(yearly: DataFrame, totals: DataFrame, by: str, full_years: list[int], min_coverage: float, min_rank_ic: float, max_q: float, positive_years: int) -> DataFrame:
    """(by, status, covered, positive_full_years, queue): every year must be covered, but only whole years count towards the positive ones."""
    years = yearly.groupBy(by).agg(F.min(F.coalesce(F.col("coverage") >= min_coverage, F.lit(False))).alias("covered"), F.count_if(F.col("year").isin(*full_years) & (F.col("rank_ic") > 0)).alias("positive_full_years"))
    ok = F.col("covered") & F.coalesce(F.col("rank_ic") >= min_rank_ic, F.lit(False)) & F.coalesce(F.col("q") <= max_q, F.lit(False)) & (F.col("positive_full_years") >= positive_years)
    return totals.join(years, by).select(by, F.when(ok, "IC_SCREEN_PASS").otherwise("IC_SCREEN_REJECT").alias("status"), "covered", "positive_full_years", F.when(F.col("covered"), "DATA_READY_FOR_BOUNDED_MODEL_PROTOCOL").otherwise("DATA_COVERAGE_BLOCKED").alias("queue"))


def joint_gate(increments: DataFrame, min_rank_ic: float, max_q: float, min_annual: float, positive_years: int, days: int = 238) -> DataFrame:
    """increments (rank_ic_mean, q, net_mean, net_low, positive_full_years) with decision GO or NO_GO: signal and net return must both gain, the latter surely."""
    ok = (F.col("rank_ic_mean") >= min_rank_ic) & (F.col("q") <= max_q) & (F.col("net_mean") * days >= min_annual) & (F.col("net_low") > 0) & (F.col("positive_full_years") >= positive_years)
    return increments.withColumn("decision", F.when(ok, "GO").otherwise("NO_GO"))


def survivors(claimed: DataFrame, recomputed: DataFrame, by: str, status: str = "status", passing: str = "FORWARD") -> DataFrame:
    """(by) of factors whose recomputed verdict passes. One whose claimed status says otherwise fails the query: a status string alone admits nothing."""
    x = claimed.select(by, F.col(status).alias("_s")).join(recomputed.select(by, "passed"), by)
    wrong = F.col("passed") != (F.col("_s") == passing)
    # One condition: as two, the optimizer would leave out the rows that do not pass before they are checked.
    return x.where(F.when(wrong, F.raise_error(F.lit("a claimed status differs from its metrics")).cast("boolean")).otherwise(F.col("passed"))).select(by)


def first_of_family(candidates: DataFrame, family: str, order: str, name: str, ok: Column) -> DataFrame:
    """(family, name): of each family the first candidate in its declared order that qualifies, not the best one."""
    return candidates.where(ok).groupBy(family).agg(F.min_by(name, order).alias(name))


def winner(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The row of the largest value, of equal ones the first in the declared order."""
    return rows.orderBy(F.desc_nulls_last(value), order).limit(1)


def coverage_gate(cells: DataFrame, by: str, least_cross_section: int, least_dates: int, least_year: int, years: list[int]) -> DataFrame:
    """(by, observed, eligible_dates, gate) from cells (by, dt, value): dates with enough values, in all and in every named year."""
    daily = cells.where("value is not null").groupBy(by, "dt").agg(F.count("*").alias("n"))
    good = F.col("n") >= least_cross_section
    each = [F.count_if(good & (F.year("dt") == y)) >= least_year for y in years]
    ok = F.count_if(good) >= least_dates
    for e in each:
        ok = ok & e
    return daily.groupBy(by).agg(F.sum("n").alias("observed"), F.count_if(good).alias("eligible_dates"), F.when(ok, "PASS_COVERAGE_ONLY").otherwise("NO_GO_DATA_COVERAGE").alias("gate"))


def rebalance_dates(calendar: DataFrame, every: int) -> DataFrame:
    """(dt, signal_dt): every so many dates from the first, with the calendar date before each, whose scores are traded."""
    w = W.orderBy("t")
    x = calendar.withColumn("signal_dt", F.lag("dt").over(w)).withColumn("_n", F.row_number().over(w) - 1)
    return x.where(F.pmod("_n", F.lit(every)) == 0).select("dt", "signal_dt")


def common_support(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a finite value in every column, so that all variants see the same rows; labels are not asked."""
    for c in columns:
        x = F.col(c).cast("double")
        df = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df

"""Scores against forward labels: preprocessing, labels, daily correlations and what is drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.functions.cross import finite, mean_rank, past, pearson, percent_rank, ratio, standard

#: Fixed value: scales a uniform rank to about unit deviation.
NORMAL = 3.46


def preprocess(panel: DataFrame, raw: str, mask: str, out: str = "score") -> DataFrame:
    """Members' values clipped to the date's 1 % and 99 % quantiles (linear) and standardized with the population deviation. NaN and infinities are null.

    The quantiles are a window over the date, so the panel is shuffled once and not joined to itself.
    """
    df = panel.withColumn("_x", F.when(F.col(mask), finite(F.col(raw))))
    df = df.withColumn("_q", F.percentile("_x", F.array(F.lit(0.01), F.lit(0.99))).over(W.partitionBy("dt")))
    df = df.withColumn("_x", F.when(F.col("_x").isNotNull(), F.greatest(F.least("_x", F.col("_q")[1]), F.col("_q")[0])))
    return df.withColumn(out, standard(F.col("_x"), "dt")).drop("_x", "_q")


def forward_labels(panel: DataFrame, h: int, end=None, out: str = "label") -> DataFrame:
    """close[t+1+h] / close[t+1] - 1 for members that can be traded on both dates, the exit not after `end`."""
    if type(h) is not int or not 1 <= h <= 252:
        raise ValueError("a label's horizon is 1 to 252 dates")
    w = past()
    ok = F.col("is_member") & F.lead("exec_ok", 1).over(w) & F.lead("exec_ok", h + 1).over(w)
    if end is not None:
        ok = ok & (F.lead("dt", h + 1).over(w) <= F.lit(end).cast("date"))
    return panel.withColumn(out, F.when(ok, ratio(F.lead("close", h + 1).over(w), F.lead("close", 1).over(w)) - 1))


def daily_ic(df: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = ("dt",), least: int = 30) -> DataFrame:
    """(by, n, ic, rank_ic): Pearson of the pairs that are complete and finite, and of their average ranks taken within the pairs."""
    pairs = df.select(*by, finite(F.col(score)).alias("x"), finite(F.col(label)).alias("y")).where("x is not null and y is not null")
    pairs = pairs.withColumn("rx", mean_rank(F.col("x"), *by)).withColumn("ry", mean_rank(F.col("y"), *by))
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), pearson("x", "y", least).alias("ic"), pearson("rx", "ry", least).alias("rank_ic"))


def summarize(daily: DataFrame, *by: str, more: list | None = None) -> DataFrame:
    """Days, pairs, and of either correlation the mean, deviation, ratio and share above 0; and more aggregates."""
    out = [F.count("rank_ic").alias("days"), F.sum("n").alias("pairs"), *(more or [])]
    for c in ("ic", "rank_ic"):
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double"))).alias(f"{c}_positive")]
    return daily.groupBy(*by).agg(*out).withColumn("icir", ratio(F.col("ic_mean"), F.col("ic_std"))).withColumn("rank_icir", ratio(F.col("rank_ic_mean"), F.col("rank_ic_std")))


def decay(df: DataFrame, horizons: tuple[int, ...] = (1, 2, 5, 10, 20), score: str = "score", least: int = 30) -> DataFrame:
    """(h, summary..., last_usable): correlations with the labels of each horizon, and the last date that has one. One pass over the panel for all horizons."""
    w = past()
    wide = df.select("dt", F.col(score).alias("score"), *((ratio(F.lead("close", h + 1).over(w), F.lead("close", 1).over(w)) - 1).alias(str(h)) for h in horizons))
    long = wide.unpivot(["dt", "score"], [str(h) for h in horizons], "h", "label").withColumn("h", F.col("h").cast("int"))
    daily = daily_ic(long, by=("h", "dt"), least=least)
    return summarize(daily, "h", more=[F.max(F.when(F.col("ic").isNotNull(), F.col("dt"))).alias("last_usable")])


def correlations(df: DataFrame, names: list[str], least: int = 30) -> DataFrame:
    """(a, b, rho, days): mean daily rank correlation of each pair a <= b of columns, over the rows that have both."""
    from almanac.operators.statistics import pairwise_rank_correlation

    return pairwise_rank_correlation(df, names, least)


def normalized_label(label: str, day: str = "dt"):
    """A label's rank within its date, centred and scaled to about unit deviation."""
    return (percent_rank(F.col(label), day) - 0.5) * NORMAL


def folds(calendar: DataFrame, years: list[int], start=None, end=None, reach: int = 2) -> DataFrame:
    """(test_year, part, start_dt, end_dt, n): of each year training on all before the year before it, validation on that one, test on the year itself.

    Training and validation lose their last `reach` dates of the calendar (dt, t), whose labels reach into the next part. Parts that are empty then do not come.
    """
    c = calendar.withColumn("test_year", F.explode(F.array(*map(F.lit, years))))
    y, none = F.year("dt"), F.lit(True)
    c = c.where((none if start is None else F.col("dt") >= F.lit(start).cast("date")) & (none if end is None else F.col("dt") <= F.lit(end).cast("date")))
    c = c.withColumn("part", F.when(y < F.col("test_year") - 1, "train").when(y == F.col("test_year") - 1, "valid").when(y == F.col("test_year"), "test")).where("part is not null")
    back = F.row_number().over(W.partitionBy("test_year", "part").orderBy(F.desc("t")))
    return c.withColumn("_back", back).where((F.col("_back") > reach) | (F.col("part") == "test")).groupBy("test_year", "part").agg(F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"), F.count("*").alias("n"))


def waterfall(df: DataFrame, masks: dict, *by) -> DataFrame:
    """(by, cells, masks...): how many rows are left after each mask and all before it, one aggregation."""
    left, out = F.lit(True), [F.count("*").alias("cells")]
    for name, mask in masks.items():
        left = left & F.coalesce(mask, F.lit(False))
        out.append(F.count_if(left).alias(name))
    return df.groupBy(*by).agg(*out)


def quantile_spread(df: DataFrame, fraction: float = 0.2, least: int = 30) -> DataFrame:
    """(dt, n, k, top, bottom, long_short, top_labels, bottom_labels): mean labels of the best and worst k = ceil(n * fraction) of a date's n scores, ties by instrument.

    Groups are formed from the scores alone; the labels that there are in them are averaged, and counted. A date
    with fewer than `least` complete pairs has null means. Scores of a date without any are not reported.
    """
    if not 0 < fraction <= 0.5:
        raise ValueError("a fraction lies in (0, 0.5]")
    day = W.partitionBy("dt")
    x = df.select("dt", "inst", finite(F.col("score")).alias("score"), finite(F.col("label")).alias("label")).where("score is not null")
    x = x.withColumn("n", F.count("*").over(day)).withColumn("r", F.row_number().over(day.orderBy(F.desc("score"), "inst"))).withColumn("k", F.ceil(F.round(F.col("n") * fraction, 9)))
    top, bottom = (F.when(c, F.col("label")) for c in (F.col("r") <= F.col("k"), F.col("r") > F.col("n") - F.col("k")))
    out = x.groupBy("dt", "n", "k").agg(F.avg(top).alias("top"), F.avg(bottom).alias("bottom"), F.count(top).alias("top_labels"), F.count(bottom).alias("bottom_labels"), F.count("label").alias("_pairs"))
    usable = lambda c: F.when(F.col("_pairs") >= least, c)
    return out.select("dt", "n", "k", usable(F.col("top")).alias("top"), usable(F.col("bottom")).alias("bottom"), usable(F.col("top") - F.col("bottom")).alias("long_short"), "top_labels", "bottom_labels")


def neutralize(df: DataFrame, score: str, size: str, industry: str, min_group: int = 5, least: int = 30, out: str = "neutral") -> DataFrame:
    """Residual of score on size and industry within each date, by partialling out the industry means, scaled to deviation 1.

    Rows without a finite score and size or without an industry are left out, and so are groups under min_group; a date needs `least` rows, size must vary and the rows exceed the columns by more than 5.
    """
    x = df.withColumns({c: finite(F.col(c)) for c in (score, size)}).where(F.col(score).isNotNull() & F.col(size).isNotNull() & F.col(industry).isNotNull())
    group, day = W.partitionBy("dt", industry), W.partitionBy("dt")
    x = x.withColumn("_g", F.count("*").over(group)).where(F.col("_g") >= min_group)
    x = x.withColumn("_y", F.col(score) - F.avg(score).over(group)).withColumn("_z", F.col(size) - F.avg(size).over(group))
    x = x.withColumn("_n", F.count("*").over(day)).withColumn("_c", F.size(F.collect_set(industry).over(day)) + 1).withColumn("_sd", F.stddev_samp(size).over(day))
    slope = F.coalesce(ratio(F.sum(F.col("_y") * F.col("_z")).over(day), F.sum(F.col("_z") * F.col("_z")).over(day)), F.lit(0.0))
    x = x.withColumn("_r", F.col("_y") - slope * F.col("_z")).where((F.col("_n") >= least) & (F.col("_sd") > 0) & (F.col("_n") > F.col("_c") + 5))
    scale = F.stddev_pop("_r").over(day)
    return x.withColumn(out, F.when(scale > 1e-12, F.col("_r") / scale)).drop("_g", "_y", "_z", "_n", "_c", "_sd", "_r")


def bh_adjust(df: DataFrame, p: str, out: str = "q", family: int | None = None) -> DataFrame:
    """Step-up adjusted p-values of one family (a bounded number of hypotheses), 1 at most. A larger `family` is filled up with values of 1."""
    everything = W.partitionBy(F.lit(1))
    rank = F.row_number().over(everything.orderBy(p))
    size = F.count("*").over(everything)
    ranked = df.withColumn("_k", rank).withColumn("_m", F.greatest(size, F.lit(family)) if family else size)
    down = everything.orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k")).over(down))).drop("_k", "_m")


def top_k(df: DataFrame, k: int) -> DataFrame:
    """(dt, inst): the k best scores of the date before, ties by instrument."""
    before = df.withColumn("_s", F.lag("score").over(past())).where("_s is not null")
    return before.withColumn("_r", F.row_number().over(W.partitionBy("dt").orderBy(F.desc("_s"), "inst"))).where(F.col("_r") <= k).drop("_s", "_r")


def holdings_report(df: DataFrame, k: int, fee: float) -> DataFrame:
    """(dt, ret, bench, turnover, cost): equal-weight returns of the k best, against all instruments.

    turnover is the part of the weight that changes hands from date to date, cost the fee on it; the first date buys everything.
    """
    w, date = past(), W.partitionBy("dt")
    x = df.select("dt", "t", "inst", "returns", F.lag("score").over(w).alias("_s"))
    place = F.row_number().over(date.orderBy(F.desc_nulls_last("_s"), "inst"))
    x = x.withColumn("_held", F.col("_s").isNotNull() & (place <= k))
    x = x.withColumn("weight", F.when(F.col("_held"), 1 / F.count_if("_held").over(date)).otherwise(F.lit(0.0)))
    x = x.withColumn("_moved", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))))
    daily = x.groupBy("dt").agg(F.avg(F.when(F.col("weight") > 0, F.col("returns"))).alias("ret"), F.avg("returns").alias("bench"), (F.sum("_moved") / 2).alias("turnover"), F.sum("weight").alias("_all"))
    first = F.min(F.when(F.col("_all") > 0, F.col("dt"))).over(W.partitionBy(F.lit(1)))
    daily = daily.withColumn("turnover", F.when(F.col("dt") == first, 2 * F.col("turnover")).otherwise(F.col("turnover")))
    return daily.where("ret is not null and bench is not null").select("dt", "ret", "bench", "turnover", (fee * F.col("turnover")).alias("cost"))


def portfolio_metrics(daily: DataFrame, days: int = 238) -> DataFrame:
    """One row from (dt, ret, cost, bench, turnover): growth before and after costs, drawdown from the initial 1, and the excess over the benchmark by sums.

    Bad reports (see validate.report_violations) are for the caller to refuse. The dates are those of one portfolio, a few thousand.
    """
    line = W.partitionBy(F.lit(1)).orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    x = daily.withColumn("net", F.col("ret") - F.col("cost")).withColumn("nav", F.exp(F.sum(F.log1p("net")).over(line))).withColumn("excess", F.sum(F.col("net") - F.col("bench")).over(line))
    x = x.withColumn("down", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(line)) - 1).withColumn("excess_down", F.col("excess") - F.greatest(F.lit(0.0), F.max("excess").over(line)))
    diff = F.col("net") - F.col("bench")
    return x.agg(
        F.count("*").alias("n_days"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("gross_return"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("net_return"), (F.exp(F.sum(F.log1p("net")) * days / F.count("*")) - 1).alias("cagr"),
        F.least(F.lit(0.0), F.min("down")).alias("max_drawdown"), (F.avg(diff) * days).alias("excess_annual"), (F.avg(diff) / F.nullif(F.stddev_samp(diff), F.lit(0.0)) * F.sqrt(F.lit(days))).alias("excess_ir"), F.least(F.lit(0.0), F.min("excess_down")).alias("excess_drawdown"),
        (F.avg(F.col("ret") - F.col("bench")) * days).alias("gross_excess_annual"), F.avg("turnover").alias("mean_turnover"), (F.avg("cost") * days).alias("annual_cost"),
    )


def risk_analysis(daily: DataFrame, x: str, days: int = 238) -> DataFrame:
    """One row of a return series: mean and deviation of a day, annual mean, ratio and drawdown, all by sums."""
    line = W.partitionBy(F.lit(1)).orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    y = daily.withColumn("_sum", F.sum(x).over(line)).withColumn("_down", F.col("_sum") - F.max("_sum").over(line))
    return y.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), (F.avg(x) * days).alias("annual"), (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * F.sqrt(F.lit(days))).alias("ir"), F.min("_down").alias("drawdown"))

"""Published statements as events: earlier periods, what a value depends on, and when it can be known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.functions.cross import ratio


def with_prior(statements: DataFrame, key: str, period: str, columns: list[str], prior: Column, suffix: str = "_prior") -> DataFrame:
    """statements with the columns of the key's statement of another period: a self join by equality, null where there is none."""
    other = statements.select(F.col(key).alias("_k"), F.col(period).alias("_p"), *(F.col(c).alias(c + suffix) for c in columns))
    return statements.withColumn("_want", prior).join(other, (F.col(key) == F.col("_k")) & (F.col("_want") == F.col("_p")), "left").drop("_k", "_p", "_want")


def year_before(period: str) -> Column:
    """The same quarter of the year before, at its month's end."""
    return F.last_day(F.add_months(period, -12))


def opening(period: str) -> Column:
    """The last day of the year before, whose balance opens a period."""
    return F.make_date(F.year(period) - 1, F.lit(12), F.lit(31))


def dependency_events(df: DataFrame, value: Column, current: list[Column], needed: list[Column], keys: list[str]) -> DataFrame:
    """(keys, published, value, complete): when a value that needs several releases can be known.

    current are publication dates of the period's own releases, needed those of all that the value depends on, null if absent.
    The first current release clears what was known of the period before, with a null value unless everything is there by then;
    if all dependencies exist, the last of them brings the value. Rows without a current release give nothing.
    """
    complete = ~F.greatest(*(c.isNull().cast("int") for c in needed)).cast("boolean") if len(needed) > 1 else needed[0].isNotNull()
    first = F.least(*current) if len(current) > 1 else current[0]
    last = F.greatest(first, *needed)
    x = df.withColumn("_first", first).withColumn("_complete", complete).withColumn("_at", F.when(F.col("_complete"), last).otherwise(F.col("_first"))).where("_first is not null")
    v = F.when(F.col("_complete") & ~F.isnan(value) & (F.abs(value) != float("inf")), value)
    here = F.struct(F.col("_first").alias("published"), F.when(F.col("_at") == F.col("_first"), v).alias("value"))
    later = F.struct(F.col("_at").alias("published"), v.alias("value"))
    rows = F.when(F.col("_complete") & (F.col("_at") > F.col("_first")), F.array(here, later)).otherwise(F.array(here))
    return x.select(*keys, F.col("_complete").alias("complete"), F.explode(rows).alias("_e")).select(*keys, "_e.published", "_e.value", "complete")


#: Kinds of organisation whose margin is on total income.
FINANCIAL_KINDS = ("银行", "证券", "保险")


def reconstructed(income: DataFrame, balance: DataFrame, conservative: bool = True) -> DataFrame:
    """(code, period, field, published, value, complete): return on equity and net margin from the statements themselves, as events.

    income has (code, period, notice, updated, parent_profit, profit, income, total_income, kind), balance (code, period, notice, updated, equity),
    one row per code and period. roe is the parent's profit over the mean of opening and closing equity and needs both balances; margin is profit over
    income, over total income for financial kinds. A value over 0 is null. With `conservative` a value waits for the
    last update of what it needs, and is null where an update's date is not known. Rows of a period with neither statement do not come.
    """
    i = income.select("code", "period", F.struct("notice", "updated", "parent_profit", "profit", "income", "total_income", "kind").alias("i"))
    b = balance.select("code", "period", F.struct("notice", "updated", "equity").alias("b"))
    x = i.join(b, ["code", "period"], "full_outer")
    before = b.select(F.col("code").alias("_k"), F.col("period").alias("_p"), F.col("b").alias("o"))
    x = x.join(before, (F.col("code") == F.col("_k")) & (opening("period") == F.col("_p")), "left").drop("_k", "_p")
    roe = ratio(F.col("i.parent_profit"), (F.col("b.equity") + F.col("o.equity")) / 2)
    margin = ratio(F.col("i.profit"), F.when(F.col("i.kind").isin(*FINANCIAL_KINDS), F.col("i.total_income")).otherwise(F.col("i.income")))
    out = []
    for name, value, current, needed in (("roe", roe, "bi", "bio"), ("margin", margin, "i", "i")):
        notices, updates = [F.col(f"{n}.notice") for n in needed], [F.col(f"{n}.updated") for n in needed]
        dates = notices
        if conservative:
            known = ~F.array_contains(F.array(*(u.isNull() for u in updates)), True)
            value, dates = F.when(known, value), [F.when(known, F.greatest(n, u)).otherwise(n) for n, u in zip(notices, updates, strict=True)]
        whole = [F.when(n.isNotNull(), d) for d, n in zip(dates, notices, strict=True)]
        out.append(dependency_events(x.withColumn("field", F.lit(name)), value, [F.col(f"{n}.notice") for n in current], whole, ["code", "period", "field"]))
    return out[0].unionByName(out[1]).select("code", "period", "field", "published", "value", "complete")


def whole_history(requests: DataFrame, answers: DataFrame, by: list[str], on: list[str], first: str, second: str) -> DataFrame:
    """(by, source, planned, answered): a key takes its whole history from `first` only if every planned request has an answer there, else all of it from `second`."""
    hit = answers.select(*on, F.lit(1).alias("_hit")).distinct()
    got = requests.join(hit, on, "left").groupBy(*by).agg(F.count("*").alias("planned"), F.count("_hit").alias("answered"))
    return got.select(*by, F.when(F.col("planned") == F.col("answered"), first).otherwise(second).alias("source"), "planned", "answered")


def missing_requests(requests: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """Planned requests without an answer."""
    return requests.join(answers.select(*on).distinct(), on, "left_anti")


def latest(rows: DataFrame, key: str, order: str, kept: Column | None = None) -> DataFrame:
    """Of each key the row of the highest `order`; with `kept`, only where that row has it: an older row never stands in for it."""
    newest = _latest(rows, key, order)
    return newest if kept is None else newest.where(kept)


def _latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def first_by(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first k rows of each key by `order`, which tells rows apart."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_n") <= k).drop("_n")


def modal_period(rows: DataFrame, by: str, period: str) -> DataFrame:
    """(by, period, n, off_modal): the most frequent period, the newest of equally frequent ones, and the share of rows in others."""
    c = rows.where(F.col(period).isNotNull()).groupBy(by, period).agg(F.count("*").alias("_n"))
    out = c.groupBy(by).agg(F.max_by(period, F.struct("_n", period)).alias("period"), F.max("_n").alias("n"), (1 - F.max("_n") / F.sum("_n")).alias("off_modal"))
    return out


def errors(df: DataFrame, a: str, b: str, by: list[str], tolerances: tuple[float, ...] = (1e-6, 1e-4)) -> DataFrame:
    """(by, n, pairs, median, p95, most, within_i...): absolute differences of two readings."""
    d = df.withColumn("_d", F.abs(F.col(a) - F.col(b)))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.count("_d").alias("pairs"), F.percentile("_d", 0.5).alias("median"), F.percentile("_d", 0.95).alias("p95"), F.max("_d").alias("most"), *(F.count_if(F.col("_d") <= t).alias(f"within_{i}") for i, t in enumerate(tolerances)))


def age_quantiles(df: DataFrame, age: str, by: list[str]) -> DataFrame:
    """(by, median, p95, most) of ages in days, exact."""
    return df.groupBy(*by).agg(*(F.percentile(age, p).alias(n) for p, n in ((0.5, "median"), (0.95, "p95"), (1.0, "most"))))

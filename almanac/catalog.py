"""The library's queries over the standard tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import dsl, fundamentals
from almanac.functions.cross import past, ratio
from almanac.operators import asof, decide, evaluate, events
from almanac.plans import panel
from almanac.sources.tables import table


def r(c, digits: int = 6):
    """Rounded for comparison, without a negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)).alias(c if isinstance(c, str) else "x")


#: Pairs that a date needs for a correlation.
LEAST = 30


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the momentum score and the two-date label."""
    p = dsl.evaluate(panel.eligible(panel.market(spark, sf_dir)), {"mom": "close / Ref(close, 3) - 1"})
    # The label before the cross-section: one shuffle by instrument serves both, and one by date what follows.
    w = past()
    p = p.withColumn("label", ratio(F.lead("close", 3).over(w), F.lead("close", 1).over(w)) - 1)
    return evaluate.preprocess(p.withColumn("_all", F.lit(True)), "mom", "_all")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = evaluate.daily_ic(scored(spark, sf_dir), least=LEAST)
    return _summary(daily.withColumn("year", F.year("dt")), "year")


def _summary(daily: DataFrame, *by: str) -> DataFrame:
    s = evaluate.summarize(daily, *by)
    return s.select(*by, "days", "pairs", *(r(c) for c in s.columns if c not in (*by, "days", "pairs")))


MARKET = """
bars AS (SELECT l_suppkey AS inst, date_trunc('month', l_shipdate)::DATE AS dt, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS amount, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS volume,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS open FROM lineitem GROUP BY 1, 2),
cal AS (SELECT dt, row_number() OVER (ORDER BY dt)::INT AS t FROM (SELECT DISTINCT dt FROM bars)),
dense AS (SELECT c.dt, c.t, i.s_suppkey AS inst, b.amount / b.volume AS close, b.open, b.high, b.low, b.volume, b.amount FROM cal c CROSS JOIN supplier i LEFT JOIN bars b ON b.dt = c.dt AND b.inst = i.s_suppkey),
p0 AS (SELECT *, close / lag(close) OVER i - 1 AS returns, volume / nullif(sum(volume) OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 0) AS turnover, lag(amount) OVER i AS before FROM dense WINDOW i AS (PARTITION BY inst ORDER BY t)),
market AS (SELECT * EXCLUDE (before), before IS NOT NULL AND row_number() OVER (PARTITION BY dt ORDER BY before DESC NULLS LAST, inst) <= ceil(count(before) OVER (PARTITION BY dt) * 0.6) AS is_member FROM p0)
"""
SCORED = (
    MARKET
    + """,
m0 AS (SELECT *, close / lag(close, 3) OVER i - 1 AS mom, lead(close, 3) OVER i / lead(close, 1) OVER i - 1 AS label FROM market WINDOW i AS (PARTITION BY inst ORDER BY t)),
q AS (SELECT dt, quantile_cont(mom, 0.01) AS lo, quantile_cont(mom, 0.99) AS hi FROM m0 GROUP BY dt),
m1 AS (SELECT m0.*, CASE WHEN mom IS NOT NULL THEN greatest(least(mom, hi), lo) END AS x FROM m0 JOIN q USING (dt)),
scored AS (SELECT *, (x - avg(x) OVER (PARTITION BY dt)) / nullif(stddev_pop(x) OVER (PARTITION BY dt), 0) AS score FROM m1)
"""
)
def ic_sql(source: str, score: str = "score", label: str = "label", by: str = "dt") -> str:
    return f"""
pairs AS (SELECT {by}, {score} AS x, {label} AS y FROM {source} WHERE {score} IS NOT NULL AND {label} IS NOT NULL),
ranked AS (SELECT {by}, x, y, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2 AS ry FROM pairs),
daily AS (SELECT {by}, count(*) AS n, CASE WHEN count(*) >= {LEAST} AND stddev_samp(x) * stddev_samp(y) > 0 THEN covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) END AS ic,
  CASE WHEN count(*) >= {LEAST} AND stddev_samp(rx) * stddev_samp(ry) > 0 THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS rank_ic FROM ranked GROUP BY {by})
"""


SUMMARY = ", ".join(["count(rank_ic) AS days", "sum(n)::BIGINT AS pairs"] + [f"round(avg({c}), 6) + 0.0 AS {c}_mean, round(stddev_samp({c}), 6) + 0.0 AS {c}_std, round(avg(CASE WHEN {c} IS NOT NULL THEN ({c} > 0)::INT::DOUBLE END), 6) + 0.0 AS {c}_positive" for c in ("ic", "rank_ic")] + ["round(avg(ic) / nullif(stddev_samp(ic), 0), 6) + 0.0 AS icir", "round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 6) + 0.0 AS rank_icir"])
Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


@query("panel_bars_month", f"WITH {MARKET} SELECT inst, dt, amount, volume, amount / volume AS close, open, high, low FROM bars")
def panel_bars_month(spark, d):
    return panel.bars(spark, d).select("inst", "dt", "amount", "volume", "close", "open", "high", "low")


@query("panel_dense_returns", f"WITH {MARKET} SELECT dt, t, inst, close, round(returns, 6) + 0.0 AS returns, round(turnover, 6) + 0.0 AS turnover FROM market")
def panel_dense_returns(spark, d):
    return panel.market(spark, d).select("dt", "t", "inst", "close", r("returns"), r("turnover"))


@query("membership_intervals", f"WITH {MARKET}, k AS (SELECT inst, dt, t - row_number() OVER (PARTITION BY inst ORDER BY t) AS island FROM market WHERE is_member) SELECT inst, min(dt) AS start_dt, max(dt) AS end_dt FROM k GROUP BY inst, island")
def membership_intervals(spark, d):
    return panel.intervals(panel.market(spark, d))


@query("membership_expand", f"WITH {MARKET} SELECT dt, inst FROM market WHERE is_member")
def membership_expand(spark, d):
    m = panel.market(spark, d)
    return panel.expand(panel.intervals(m), panel.calendar(table(spark, d, "lineitem").select(F.trunc("l_shipdate", "month").alias("dt"))))


@query(
    "adjust_factor_asof",
    f"WITH {MARKET}, f AS (SELECT l_suppkey AS inst, (date_trunc('year', l_shipdate) + INTERVAL 3 MONTH)::DATE AS at, 1 + sum(l_tax::DECIMAL(18,4))::DOUBLE / count(*) AS factor FROM lineitem GROUP BY 1, 2) "
    "SELECT m.dt, m.inst, round(coalesce(f.factor, 1.0), 6) AS factor, m.close * coalesce(f.factor, 1.0) AS adjusted FROM market m ASOF LEFT JOIN f ON m.inst = f.inst AND m.dt >= f.at",
)
def adjust_factor_asof(spark, d):
    li = table(spark, d, "lineitem")
    f = li.groupBy(F.col("l_suppkey").alias("inst"), F.add_months(F.trunc("l_shipdate", "year"), 3).alias("at")).agg((1 + F.sum(F.col("l_tax").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("factor"))
    out = asof.asof(panel.market(spark, d).select("dt", "inst", "close"), f, "inst", "dt", "at", ["factor"], strict=False)
    return out.select("dt", "inst", F.round(F.coalesce("factor", F.lit(1.0)), 6).alias("factor"), (F.col("close") * F.coalesce("factor", F.lit(1.0))).alias("adjusted"))


@query("execution_eligibility", f"WITH {MARKET} SELECT dt, inst, close IS NOT NULL AND close > 0 AND coalesce(NOT (returns::FLOAT >= 0.095::FLOAT OR returns::FLOAT <= -(0.095::FLOAT)), true) AS exec_ok FROM market")
def execution_eligibility(spark, d):
    return panel.eligible(panel.market(spark, d)).select("dt", "inst", "exec_ok")


def _dsl(spark, d, expressions: dict[str, str], member=None) -> DataFrame:
    return dsl.evaluate(panel.market(spark, d), expressions, member).select("dt", "inst", *(r(c) for c in expressions))


def _dsl_sql(**columns: str) -> str:
    return f"WITH {MARKET} SELECT dt, inst, {', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in columns.items())} FROM market WINDOW i AS (PARTITION BY inst ORDER BY t)"


def _win(agg: str, x: str, w: int) -> str:
    f = f"OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} = {w} THEN {agg}({x}) {f} END"


@query("dsl_ref_delta", _dsl_sql(mom="close / lag(close, 3) OVER i - 1", delta="(close - lag(close, 2) OVER i) / close", same="close - close"))
def dsl_ref_delta(spark, d):
    return _dsl(spark, d, {"mom": "close / Ref(close, 3) - 1", "delta": "Delta(close, 2) / close", "same": "Delta(close, 0)"})


@query("dsl_mean_std_min_max", _dsl_sql(mean=f"({_win('avg', 'close', 4)}) / close", std=_win("stddev_samp", "returns", 6), low=f"({_win('min', 'close', 5)}) / close", high=f"({_win('max', 'close', 5)}) / close"))
def dsl_mean_std_min_max(spark, d):
    return _dsl(spark, d, {"mean": "Mean(close, 4) / close", "std": "Std(returns, 6)", "low": "Min(close, 5) / close", "high": "Max(close, 5) / close"})


@query(
    "dsl_tsrank",
    f"WITH {MARKET}, a AS (SELECT dt, inst, close, list(close) OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS l FROM market) "
    "SELECT dt, inst, CASE WHEN close IS NOT NULL AND len(list_filter(l, lambda v: v IS NOT NULL)) = 6 THEN round((len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2) / 6, 6) END AS tsrank FROM a",
)
def dsl_tsrank(spark, d):
    return _dsl(spark, d, {"tsrank": "TsRank(close, 6)"})


@query(
    "dsl_rank_members",
    f"WITH {MARKET}, x AS (SELECT dt, inst, CASE WHEN is_member THEN volume END AS v FROM market) "
    "SELECT dt, inst, CASE WHEN v IS NOT NULL THEN round((rank() OVER (PARTITION BY dt, v IS NOT NULL ORDER BY v) + (count(*) OVER (PARTITION BY dt, v) - 1) / 2) / count(v) OVER (PARTITION BY dt), 6) END AS rank FROM x",
)
def dsl_rank_members(spark, d):
    return _dsl(spark, d, {"rank": "Rank(volume)"}, "is_member")


@query("dsl_log_abs_div", _dsl_sql(log="CASE WHEN close / nullif(lag(close) OVER i, 0) > 0 THEN ln(close / nullif(lag(close) OVER i, 0)) END", abs="abs(returns)", body="(close - low) / (high - low + 0.001)", neg="-(returns * 2.0)"))
def dsl_log_abs_div(spark, d):
    return _dsl(spark, d, {"log": "Log(close / Ref(close, 1))", "abs": "Abs(returns)", "body": "(close - low) / (high - low + 0.001)", "neg": "-Mul(returns, 2)"})


_SEED_SQL = {
    "MOM_20": "close / lag(close, 20) OVER i - 1", "MOM_60": "close / lag(close, 60) OVER i - 1", "REV_5": "-(close / lag(close, 5) OVER i - 1)", "VOL_20": _win("stddev_samp", "returns", 20),
    "TURNOVER_MEAN_20": _win("avg", "turnover", 20), "TURNOVER_CHANGE_20": f"({_win('avg', 'turnover', 5)}) / nullif({_win('avg', 'turnover', 20)}, 0) - 1", "VOLUME_RATIO_5_20": f"({_win('avg', 'volume', 5)}) / nullif({_win('avg', 'volume', 20)}, 0)",
    "PRICE_POSITION_60": f"(close - ({_win('min', 'low', 60)})) / nullif(({_win('max', 'high', 60)}) - ({_win('min', 'low', 60)}), 0)",
}


@query(
    "seed_factors_long",
    f"WITH {MARKET}, w AS (SELECT dt, inst, {', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in _SEED_SQL.items())} FROM market WINDOW i AS (PARTITION BY inst ORDER BY t)) "
    + " UNION ALL ".join(f"SELECT '{k}' AS factor, dt, inst, {k} AS value FROM w WHERE {k} IS NOT NULL" for k in _SEED_SQL),
)
def seed_factors_long(spark, d):
    wide = _dsl(spark, d, dsl.SEEDS)
    return wide.unpivot(["dt", "inst"], list(dsl.SEEDS), "factor", "value").where("value is not null").select("factor", "dt", "inst", "value")


@query("preprocess_scores", f"WITH {SCORED} SELECT dt, inst, round(score, 6) + 0.0 AS score FROM scored")
def preprocess_scores(spark, d):
    return scored(spark, d).select("dt", "inst", r("score", 6))


_FWD = MARKET + ", e AS (SELECT *, close IS NOT NULL AND close > 0 AND coalesce(NOT (returns::FLOAT >= 0.095::FLOAT OR returns::FLOAT <= -(0.095::FLOAT)), true) AS exec_ok FROM market), fl AS (SELECT dt, inst, CASE WHEN is_member AND lead(exec_ok, 1) OVER i AND lead(exec_ok, 3) OVER i AND lead(dt, 3) OVER i <= DATE '2000-12-31' THEN lead(close, 3) OVER i / lead(close, 1) OVER i - 1 END AS label FROM e WINDOW i AS (PARTITION BY inst ORDER BY t))"


@query("forward_labels_h", f"WITH {_FWD} SELECT dt, inst, round(label, 6) + 0.0 AS label FROM fl WHERE label IS NOT NULL")
def forward_labels_h(spark, d):
    return evaluate.forward_labels(panel.eligible(panel.market(spark, d)), 2, "2000-12-31").where("label is not null").select("dt", "inst", r("label"))


@query("daily_ic", f"WITH {SCORED}, {ic_sql('scored')} SELECT dt, n, round(ic, 6) + 0.0 AS ic, round(rank_ic, 6) + 0.0 AS rank_ic FROM daily")
def daily_ic(spark, d):
    return evaluate.daily_ic(scored(spark, d), least=LEAST).select("dt", "n", r("ic"), r("rank_ic"))


@query("ic_summary_by_year", f"WITH {SCORED}, {ic_sql('scored')} SELECT year(dt)::INT AS year, {SUMMARY} FROM daily GROUP BY 1")
def ic_summary_by_year(spark, d):
    return flagship(spark, d)


@query(
    "ic_decay",
    f"WITH {SCORED}, h AS (SELECT unnest([1, 2, 5, 10, 20]) AS h), l AS (SELECT h, s.dt, s.score, b.close / a.close - 1 AS label FROM scored s CROSS JOIN h JOIN dense a ON a.inst = s.inst AND a.t = s.t + 1 JOIN dense b ON b.inst = s.inst AND b.t = s.t + 1 + h), {ic_sql('l', by='h, dt')} SELECT h, {SUMMARY}, max(dt) FILTER (ic IS NOT NULL) AS last_usable FROM daily GROUP BY h",
)
def ic_decay(spark, d):
    out = evaluate.decay(scored(spark, d).drop("label"), least=LEAST)
    return out.select("h", "days", "pairs", "last_usable", *(r(c) for c in out.columns if c not in ("h", "days", "pairs", "last_usable")))


@query(
    "regime_stability",
    f"WITH {SCORED}, {ic_sql('scored')}, b AS (SELECT dt, sum(amount::DECIMAL(28,4))::DOUBLE / sum(volume::DECIMAL(28,4))::DOUBLE AS level FROM bars GROUP BY dt), g AS (SELECT dt, level / lag(level, 3) OVER (ORDER BY dt) - 1 AS m FROM b), "
    f"x AS (SELECT daily.*, CASE WHEN m > 0.01 THEN 'bull' WHEN m < -0.01 THEN 'bear' WHEN m IS NOT NULL THEN 'sideways' END AS regime FROM daily JOIN g USING (dt)) SELECT regime, {SUMMARY} FROM x WHERE regime IS NOT NULL GROUP BY regime",
)
def regime_stability(spark, d):
    daily = evaluate.daily_ic(scored(spark, d), least=LEAST)
    total = lambda c: F.sum(F.col(c).cast("decimal(28,4)")).cast("double")
    level = panel.bars(spark, d).groupBy("dt").agg((total("amount") / total("volume")).alias("level"))
    regime = level.select("dt", fundamentals.regime(F.col("level"), 3, 0.01).alias("regime"))
    return _summary(daily.join(regime, "dt").where("regime is not null"), "regime")


_PAIRS = ("mom", "rev", "vol")
_CORR = f"""WITH {MARKET}, f AS (SELECT dt, inst, close / lag(close, 3) OVER i - 1 AS mom, -(close / lag(close, 5) OVER i - 1) AS rev, {_win('stddev_samp', 'returns', 6)} AS vol FROM market WINDOW i AS (PARTITION BY inst ORDER BY t)),
l AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, dt, {a} AS score, {b} AS label FROM f" for i, a in enumerate(_PAIRS) for b in _PAIRS[i:])}), {ic_sql("l", by="a, b, dt")}
SELECT a, b, round(avg(rank_ic), 6) + 0.0 AS rho, count(rank_ic) AS days FROM daily GROUP BY a, b"""


@query("factor_correlation", _CORR)
def factor_correlation(spark, d):
    f = dsl.evaluate(panel.market(spark, d), {"mom": "close / Ref(close, 3) - 1", "rev": "-(close / Ref(close, 5) - 1)", "vol": "Std(returns, 6)"})
    return evaluate.correlations(f, list(_PAIRS), LEAST).select("a", "b", r("rho"), "days")


@query(
    "quantile_spread",
    f"WITH {SCORED}, x AS (SELECT dt, inst, label, count(*) OVER (PARTITION BY dt) AS n, row_number() OVER (PARTITION BY dt ORDER BY score DESC, inst) AS r FROM scored WHERE score IS NOT NULL), y AS (SELECT *, ceil(round(n * 0.2, 9))::BIGINT AS k FROM x), "
    "z AS (SELECT dt, n, k, count(label) AS pairs, avg(CASE WHEN r <= k THEN label END) AS top, avg(CASE WHEN r > n - k THEN label END) AS bottom, count(label) FILTER (r <= k) AS top_labels, count(label) FILTER (r > n - k) AS bottom_labels FROM y GROUP BY dt, n, k) "
    f"SELECT dt, n, k, CASE WHEN pairs >= {LEAST} THEN round(top, 6) + 0.0 END AS top, CASE WHEN pairs >= {LEAST} THEN round(bottom, 6) + 0.0 END AS bottom, CASE WHEN pairs >= {LEAST} THEN round(top - bottom, 6) + 0.0 END AS long_short, top_labels, bottom_labels FROM z",
)
def quantile_spread(spark, d):
    return evaluate.quantile_spread(scored(spark, d), least=LEAST).select("dt", "n", F.col("k").cast("long"), r("top"), r("bottom"), r("long_short"), "top_labels", "bottom_labels")


@query("coverage_by_year", f"WITH {SCORED} SELECT year(dt)::INT AS year, count(*) AS cells, count(close) AS traded, count(*) FILTER (is_member) AS members, count(*) FILTER (is_member AND score IS NOT NULL) AS covered, round(count(*) FILTER (is_member AND score IS NOT NULL) / nullif(count(*) FILTER (is_member), 0), 6) AS coverage FROM scored GROUP BY 1")
def coverage_by_year(spark, d):
    s, member = scored(spark, d), F.col("is_member")
    got = F.count_if(member & F.col("score").isNotNull())
    return s.groupBy(F.year("dt").alias("year")).agg(F.count("*").alias("cells"), F.count("close").alias("traded"), F.count_if(member).alias("members"), got.alias("covered"), F.round(ratio(got, F.count_if(member)), 6).alias("coverage"))


_STATS = f"""WITH {SCORED}, {ic_sql('scored')}, c AS (SELECT count(*) FILTER (is_member AND score IS NOT NULL) / count(*) FILTER (is_member) AS coverage FROM scored), s AS (SELECT count(rank_ic) AS days, avg(rank_ic) AS rank_ic, avg((rank_ic > 0)::INT::DOUBLE) AS positive FROM daily),
t AS (SELECT v.net, v.pool, v.worse, c.coverage - greatest(v.worse, 0) AS coverage, round(s.days * (1 - v.worse))::BIGINT AS days, s.rank_ic - v.worse AS rank_ic, s.positive - v.worse AS positive FROM c, s, (VALUES (0.02, NULL, 0), (0.02, 0.5, 0), (-0.01, 0.95, 0), (0.02, 0.5, 0.2), (NULL, 0.1, -0.2)) AS v(net, pool, worse)),
g AS (SELECT *, list_filter([CASE WHEN coverage < 0.85 THEN 'validation_gate:coverage' END, CASE WHEN days < 75 THEN 'validation_gate:days' END, CASE WHEN rank_ic IS NULL OR rank_ic < -0.1 THEN 'validation_gate:rank_ic' END, CASE WHEN positive IS NULL OR positive < 0.3 THEN 'validation_gate:positive_rank_ic_ratio' END, CASE WHEN net IS NULL OR net <= 0 THEN 'validation_gate:net_excess_annual' END, CASE WHEN abs(pool) >= 0.9 THEN 'redundant_with_existing_keep_pool' END], lambda x: x IS NOT NULL) AS bad,
list_filter(['missing_exposure:industry', CASE WHEN pool IS NULL THEN 'existing_keep_pool_unavailable' END], lambda x: x IS NOT NULL) AS waiting FROM t)
SELECT net::DOUBLE AS net_excess_annual, worse::DOUBLE AS worse, days, CASE WHEN len(bad) > 0 THEN 'REJECT' ELSE 'FORWARD' END AS status, array_to_string(CASE WHEN len(bad) > 0 THEN bad ELSE waiting END, ',') AS reasons FROM g"""


@query("factor_decision", _STATS)
def factor_decision(spark, d):
    """The rules on one factor as it is and made worse, under assumptions about its net excess and the pool; the thresholds fit a panel of months, and every gate fires in one case."""
    s = scored(spark, d)
    ic = evaluate.daily_ic(s, least=LEAST).agg(F.count("rank_ic").alias("days"), F.avg("rank_ic").alias("rank_ic"), F.avg(F.when(F.col("rank_ic").isNotNull(), (F.col("rank_ic") > 0).cast("double"))).alias("positive_rank_ic_ratio"))
    coverage = s.agg((F.count_if(F.col("is_member") & F.col("score").isNotNull()) / F.count_if("is_member")).alias("coverage"))
    cases = F.explode(F.array(*(F.struct(F.lit(n).cast("double").alias("net_excess_annual"), F.lit(p).cast("double").alias("pool_corr"), F.lit(float(w)).alias("worse")) for n, p, w in ((0.02, None, 0), (0.02, 0.5, 0), (-0.01, 0.95, 0), (0.02, 0.5, 0.2), (None, 0.1, -0.2)))))
    stats = ic.withColumn("coverage", coverage.scalar()).select("*", cases.alias("c")).select("coverage", "days", "rank_ic", "positive_rank_ic_ratio", "c.*")
    worse = F.col("worse")
    stats = stats.withColumns({"coverage": F.col("coverage") - F.greatest(worse, F.lit(0.0)), "days": F.round(F.col("days") * (1 - worse)).cast("long"), "rank_ic": F.col("rank_ic") - worse, "positive_rank_ic_ratio": F.col("positive_rank_ic_ratio") - worse})
    out = decide.decide(stats, {"min_coverage": 0.85, "min_days": 75, "min_rank_ic": -0.1, "min_positive_ratio": 0.3, "max_pool_corr": 0.9}, ("industry",))
    return out.select("net_excess_annual", "worse", "days", "status", F.array_join("reasons", ",").alias("reasons"))


_EVENTS = """ev AS (SELECT o_custkey AS code, o_orderdate::DATE AS pub, (date_trunc('quarter', o_orderdate::DATE - (o_orderkey % 400)::INT) - INTERVAL 1 DAY)::DATE AS stat, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS x, o_orderkey AS k FROM orders),
e1 AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY code, pub ORDER BY stat DESC, k DESC) = 1),
e2 AS (SELECT * FROM (SELECT *, max(stat) OVER (PARTITION BY code ORDER BY pub ROWS UNBOUNDED PRECEDING) AS m FROM e1) WHERE stat >= m),
months AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS dt FROM orders), sig AS (SELECT dt, code FROM months CROSS JOIN (SELECT DISTINCT o_custkey AS code FROM orders))"""


def _events(spark, d) -> DataFrame:
    day = F.to_date("o_orderdate")
    stat = F.date_sub(F.trunc(F.date_sub(day, (F.col("o_orderkey") % 400).cast("int")), "quarter"), 1)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("code"), day.alias("pub"), stat.alias("stat"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("x"), F.col("o_orderkey").alias("k"))


def _signals(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    # The calendar is one array, a few dates a year.
    days = o.select(F.trunc("o_orderdate", "month").alias("dt")).distinct().agg(F.sort_array(F.collect_list("dt"))).scalar()
    return o.select(F.col("o_custkey").alias("code")).distinct().select("code", F.explode(days).alias("dt"))


@query("asof_events_strict", f"WITH {_EVENTS} SELECT s.dt, s.code, CASE WHEN s.dt - e.pub <= 400 THEN e.pub END AS pub, CASE WHEN s.dt - e.pub <= 400 THEN e.x END AS x FROM sig s ASOF LEFT JOIN e2 e ON s.code = e.code AND s.dt > e.pub")
def asof_events_strict(spark, d):
    e = asof.current_periods(_events(spark, d), "code", "pub", "stat", "k")
    return asof.asof(_signals(spark, d), e.select("code", "pub", "x"), "code", "dt", "pub", ["x"], max_age=400).select("dt", "code", F.col("at").alias("pub"), "x")


@query("asof_two_age_panel", f"WITH {_EVENTS} SELECT s.dt, s.code, CASE WHEN s.dt - e.pub <= 400 AND s.dt - e.stat <= 550 THEN e.x END AS x FROM sig s ASOF LEFT JOIN e2 e ON s.code = e.code AND s.dt > e.pub")
def asof_two_age_panel(spark, d):
    e = asof.current_periods(_events(spark, d), "code", "pub", "stat", "k")
    j = asof.asof(_signals(spark, d), e.select("code", "pub", "stat", "x"), "code", "dt", "pub", ["stat", "x"], max_age=400)
    return j.select("dt", "code", F.when(F.datediff("dt", "stat") <= 550, F.col("x")).alias("x"))


@query(
    "event_quarantine",
    f"WITH {_EVENTS}, raw AS (SELECT code, pub, stat, k, CASE WHEN k % 13 = 0 THEN 'bad' WHEN k % 17 = 0 THEN '' ELSE x::VARCHAR END AS v FROM ev), z AS (SELECT *, try_cast(nullif(v, '') AS DOUBLE) AS num, count(*) OVER (PARTITION BY code, pub, stat) AS n FROM raw) "
    "SELECT k, CASE WHEN v IS NOT NULL AND v <> '' AND num IS NULL THEN 'malformed_number' WHEN n > 1 THEN 'ambiguous_duplicate' WHEN stat > pub THEN 'invalid_date' WHEN code IS NULL THEN 'invalid_key' END AS reason, num FROM z",
)
def event_quarantine(spark, d):
    raw = _events(spark, d).withColumn("v", F.when(F.col("k") % 13 == 0, "bad").when(F.col("k") % 17 == 0, "").otherwise(F.col("x").cast("string")))
    return events.quarantine(raw, "code", "pub", "stat", "v", "num").select("k", "reason", "num")


@query("modal_period", f"WITH {_EVENTS}, c AS (SELECT date_trunc('month', pub)::DATE AS dt, stat, count(*) AS n FROM ev GROUP BY 1, 2) SELECT dt, arg_max(stat, (n, stat)) AS period, max(n) AS n, round(1 - max(n) / sum(n), 6) AS mixing FROM c GROUP BY dt")
def modal_period(spark, d):
    c = _events(spark, d).groupBy(F.trunc("pub", "month").alias("dt"), "stat").agg(F.count("*").alias("n"))
    return c.groupBy("dt").agg(F.max_by("stat", F.struct("n", "stat")).alias("period"), F.max("n").alias("m"), F.round(1 - F.max("n") / F.sum("n"), 6).alias("mixing")).withColumnRenamed("m", "n")


@query("next_trading_date", f"WITH {_EVENTS} SELECT k, pub, (SELECT min(dt) FROM months WHERE dt > pub) AS next_dt FROM ev")
def next_trading_date(spark, d):
    dates = table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("dt")).distinct()
    return asof.next_date(_events(spark, d).select("k", "pub"), dates, "pub")


@query(
    "neutralize_fwl",
    f"WITH {SCORED}, b AS (SELECT s.dt, s.inst, s.score AS y0, ln(s.amount) AS z0, n.n_regionkey AS g FROM scored s JOIN supplier u ON u.s_suppkey = s.inst JOIN nation n ON n.n_nationkey = u.s_nationkey WHERE s.score IS NOT NULL AND s.amount > 0), "
    "c AS (SELECT *, count(*) OVER (PARTITION BY dt, g) AS k FROM b), e AS (SELECT *, y0 - avg(y0) OVER w AS y, z0 - avg(z0) OVER w AS z, count(*) OVER d AS n, stddev_samp(z0) OVER d AS sd, (SELECT count(DISTINCT g) FROM c c2 WHERE c2.dt = c.dt AND c2.k >= 5) + 1 AS cols FROM c WHERE k >= 5 WINDOW w AS (PARTITION BY dt, g), d AS (PARTITION BY dt)), "
    "f AS (SELECT dt, inst, y - coalesce(sum(y * z) OVER (PARTITION BY dt) / nullif(sum(z * z) OVER (PARTITION BY dt), 0), 0) * z AS res FROM e WHERE n >= 30 AND sd > 0 AND n > cols + 5) SELECT dt, inst, round(res / stddev_pop(res) OVER (PARTITION BY dt), 6) + 0.0 AS neutral FROM f",
)
def neutralize_fwl(spark, d):
    home = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("inst"), F.col("n_regionkey").alias("g"))
    x = scored(spark, d).join(home, "inst").withColumn("size", F.when(F.col("amount") > 0, F.ln("amount")))
    return evaluate.neutralize(x, "score", "size", "g").select("dt", "inst", r("neutral", 6))


@query(
    "bh_adjust",
    f"WITH {SCORED}, {ic_sql('scored')}, p AS (SELECT year(dt)::INT AS year, 1 / (1 + abs(avg(rank_ic)) * count(*)) AS p FROM daily GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p) SELECT year, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM k",
)
def bh_adjust(spark, d):
    p = evaluate.daily_ic(scored(spark, d), least=LEAST).groupBy(F.year("dt").alias("year")).agg((1 / (1 + F.abs(F.avg("rank_ic")) * F.count("*"))).alias("p"))
    return evaluate.bh_adjust(p, "p").select("year", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


_TOP = f"WITH {SCORED}, s AS (SELECT dt, inst, returns, lag(score) OVER (PARTITION BY inst ORDER BY t) AS z FROM scored), k AS (SELECT * FROM s WHERE z IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dt ORDER BY z DESC, inst) <= 30)"


@query("topk_portfolio", _TOP + " SELECT dt, inst FROM k")
def topk_portfolio(spark, d):
    return evaluate.top_k(scored(spark, d), 30).select("dt", "inst")


def reports_sql(k: int, fee: float, name: str) -> str:
    """Common tables (name): a report of the k best scores of the date before."""
    return f"""{name}w AS (SELECT dt, inst, t, returns, CASE WHEN z IS NOT NULL AND rk <= {k} THEN 1 / count(*) FILTER (z IS NOT NULL AND rk <= {k}) OVER (PARTITION BY dt) ELSE 0 END AS weight FROM
  (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY z DESC NULLS LAST, inst) AS rk FROM (SELECT dt, inst, t, returns, lag(score) OVER (PARTITION BY inst ORDER BY t) AS z FROM scored))),
{name}m AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY inst ORDER BY t), 0)) AS moved FROM {name}w),
{name}d AS (SELECT dt, avg(CASE WHEN weight > 0 THEN returns END) AS ret, avg(returns) AS bench, sum(moved) / 2 AS turnover, sum(weight) AS held FROM {name}m GROUP BY dt),
{name} AS (SELECT dt, ret / 10 AS ret, bench / 10 AS bench, tt AS turnover, {fee} * tt AS cost FROM (SELECT *, CASE WHEN dt = min(CASE WHEN held > 0 THEN dt END) OVER () THEN 2 * turnover ELSE turnover END AS tt FROM {name}d) WHERE ret IS NOT NULL AND bench IS NOT NULL)"""


def report(spark, d, k: int = 30, fee: float = 0.002) -> DataFrame:
    """Monthly returns are taken as a tenth, so that growth stays moderate."""
    out = evaluate.holdings_report(scored(spark, d), k, fee)
    return out.withColumns({"ret": F.col("ret") / 10, "bench": F.col("bench") / 10})


@query(
    "portfolio_metrics",
    f"WITH {SCORED}, {reports_sql(30, 0.002, 'p')}, y AS (SELECT *, ret - cost AS net, exp(sum(ln(1 + ret - cost)) OVER w) AS nav, sum(ret - cost - bench) OVER w AS ex FROM p WINDOW w AS (ORDER BY dt ROWS UNBOUNDED PRECEDING)), z AS (SELECT *, nav / greatest(1.0, max(nav) OVER w) - 1 AS dd, ex - greatest(0.0, max(ex) OVER w) AS ed FROM y WINDOW w AS (ORDER BY dt ROWS UNBOUNDED PRECEDING)) "
    "SELECT count(*) AS n_days, round(exp(sum(ln(1 + ret))) - 1, 6) AS gross_return, round(exp(sum(ln(1 + net))) - 1, 6) AS net_return, round(exp(sum(ln(1 + net)) * 12 / count(*)) - 1, 6) AS cagr, round(least(0.0, min(dd)), 6) AS max_drawdown, round(avg(net - bench) * 12, 6) AS excess_annual, round(avg(net - bench) / nullif(stddev_samp(net - bench), 0) * sqrt(12), 6) AS excess_ir, round(least(0.0, min(ed)), 6) AS excess_drawdown, round(avg(ret - bench) * 12, 6) AS gross_excess_annual, round(avg(turnover), 6) AS mean_turnover, round(avg(cost) * 12, 6) AS annual_cost FROM z",
)
def portfolio_metrics(spark, d):
    m = evaluate.portfolio_metrics(report(spark, d), 12)
    return m.select("n_days", *(F.round(c, 6).alias(c) for c in m.columns if c != "n_days"))


@query("event_dedup_conflict", "WITH e AS (SELECT user_id, event_type, ts::DATE AS day, floor(value / 25)::BIGINT AS bucket, event_id FROM events), g AS (SELECT user_id, event_type, day, bucket, count(*) AS n, min(event_id) AS first_id FROM e GROUP BY ALL) SELECT user_id, event_type, day, bucket, n, first_id, CASE WHEN count(*) OVER (PARTITION BY user_id, event_type, day) > 1 THEN 'CONFLICT' ELSE 'VALID' END AS status FROM g")
def event_dedup_conflict(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), F.floor(F.col("value") / 25).alias("bucket"), "event_id")
    return events.merge_same_day(e, ["user_id", "event_type", "day"], "bucket", "event_id").select("user_id", "event_type", "day", "bucket", "n", F.col("ids")[0].alias("first_id"), "status")


@query("event_active_until", "WITH e AS (SELECT user_id, datediff('day', DATE '2024-01-01', ts::DATE)::INT AS t, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT user_id, t, n, least(t + 5, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), t + 5)) - 1 AS until FROM e")
def event_active_until(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t")).agg(F.count("*").alias("n"))
    return events.active_until(e, "user_id", "t", 5)


@query("purged_folds", f"WITH {MARKET}, y AS (SELECT unnest(range(1998, 2002))::INT AS test_year), c AS (SELECT test_year, dt, t, CASE WHEN year(dt) < test_year - 1 THEN 'train' WHEN year(dt) = test_year - 1 THEN 'valid' WHEN year(dt) = test_year THEN 'test' END AS part FROM y CROSS JOIN cal), k AS (SELECT *, row_number() OVER (PARTITION BY test_year, part ORDER BY t DESC) AS back FROM c WHERE part IS NOT NULL) SELECT test_year, part, min(dt) AS start_dt, max(dt) AS end_dt, count(*) AS n FROM k WHERE back > 2 OR part = 'test' GROUP BY ALL")
def purged_folds(spark, d):
    return evaluate.folds(panel.calendar(panel.bars(spark, d)), [1998, 1999, 2000, 2001])


@query("label_rank_normalize", f"WITH {SCORED}, x AS (SELECT dt, inst, label FROM scored WHERE label IS NOT NULL) SELECT dt, inst, round(((rank() OVER (PARTITION BY dt ORDER BY label) + (count(*) OVER (PARTITION BY dt, label) - 1) / 2) / count(*) OVER (PARTITION BY dt) - 0.5) * 3.46, 9) + 0.0 AS norm FROM x")
def label_rank_normalize(spark, d):
    x = scored(spark, d).where("label is not null")
    return x.select("dt", "inst", r(evaluate.normalized_label("label"), 9).alias("norm"))


@query("request_plan", "WITH s AS (SELECT s_suppkey AS symbol FROM supplier), m AS (SELECT unnest(['profit', 'growth']) AS method), y AS (SELECT unnest(range(1995, 2002))::INT AS year), q AS (SELECT unnest([1, 2, 3, 4])::INT AS quarter) SELECT symbol, method, year, quarter FROM s CROSS JOIN m CROSS JOIN y CROSS JOIN q WHERE year < 2001 OR quarter <= 3")
def request_plan(spark, d):
    plan = table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.explode(F.array(F.lit("profit"), F.lit("growth"))).alias("method"))
    return plan.withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001)))).withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(4)))).where("year < 2001 or quarter <= 3")


@query("illiquidity", f"WITH {MARKET} SELECT dt, inst, round(ln(1 + 1e6 * ({_win('avg', 'z', 20)})), 6) + 0.0 AS illiquidity FROM (SELECT *, abs(returns) / nullif(amount, 0) AS z FROM market)")
def illiquidity(spark, d):
    return panel.market(spark, d).select("dt", "inst", r(fundamentals.illiquidity()).alias("illiquidity"))


def queries() -> dict:
    from almanac import catalog_checks, catalog_ledger, catalog_more, catalog_proofs  # noqa: F401

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    from almanac import catalog_checks, catalog_ledger, catalog_more, catalog_proofs  # noqa: F401

    return dict(O)

"""More queries over the standard tables: canonical bars, statements, ledgers, decisions, statistics and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.catalog import LEAST, MARKET, SCORED, _win, ic_sql, query, r, report, reports_sql, scored
from almanac.functions import dsl, fundamentals
from almanac.functions.cross import past, ratio
from almanac.operators import asof, decide, evaluate, ledger, statements, statistics, validate
from almanac.plans import canonical, panel
from almanac.sources.tables import table

# Canonical bars: the market's months as raw text, every seventh of a supplier's bars suspended.
_RAW = f"""{MARKET}, steps AS (SELECT l_suppkey AS inst, (date_trunc('year', l_shipdate) + INTERVAL 3 MONTH)::DATE AS at, 1 + sum(l_tax::DECIMAL(18,4))::DOUBLE / count(*) AS factor FROM lineitem GROUP BY 1, 2),
raw AS (SELECT inst, dt, open, high, low, close, volume, amount, turnover * 100 AS turnover, returns, (inst + t) % 7 = 0 AS is_suspended FROM market WHERE close IS NOT NULL),
canon AS (SELECT raw.*, coalesce(steps.factor, 1.0) AS factor, NOT is_suspended AND close > 0 AS active FROM raw ASOF LEFT JOIN steps ON raw.inst = steps.inst AND raw.dt >= steps.at)"""


def _canonical(spark, d) -> DataFrame:
    m = panel.market(spark, d).where("close is not null")
    text = lambda c: F.col(c).cast("string")
    raw = m.select(F.concat(F.lit("sh."), text("inst")).alias("code"), F.date_format("dt", "yyyy-MM-dd").alias("date"), *(text(c).alias(c) for c in ("open", "high", "low", "close", "volume", "amount")), (F.col("turnover") * 100).cast("string").alias("turn"), (F.col("returns") * 100).cast("string").alias("pctChg"), F.when((F.col("inst") + F.col("t")) % 7 == 0, "0").otherwise("1").alias("tradestatus"), F.lit("0").alias("isST"))
    li = table(spark, d, "lineitem")
    steps = li.groupBy(F.concat(F.lit("sh."), F.col("l_suppkey").cast("string")).alias("code"), F.add_months(F.trunc("l_shipdate", "year"), 3).alias("effective_date")).agg((1 + F.sum(F.col("l_tax").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("factor"))
    return canonical.canonical(raw, steps)


@query(
    "canonical_adjusted",
    f"WITH {_RAW} SELECT 'SH' || inst AS instrument, dt, {', '.join(f'round(CASE WHEN active THEN {c} * factor END, 6) + 0.0 AS {c}' for c in ('open', 'high', 'low', 'close'))}, round(CASE WHEN active THEN volume / factor END, 6) + 0.0 AS volume, round(CASE WHEN active THEN amount / nullif(volume, 0) * factor END, 6) + 0.0 AS vwap, round(CASE WHEN active THEN turnover / 100 END, 6) + 0.0 AS turnover, active AS tradable, "
    "active AND coalesce(NOT (returns::FLOAT >= 0.095::FLOAT OR returns::FLOAT <= -(0.095::FLOAT)), true) AS exec_ok FROM canon",
)
def canonical_adjusted(spark, d):
    x = canonical.adjusted(_canonical(spark, d))
    return x.select("instrument", "dt", *(r(c) for c in ("open", "high", "low", "close", "volume", "vwap", "turnover")), "tradable", "exec_ok")


@query("circulating_cap", f"WITH {_RAW} SELECT 'SH' || inst AS instrument, dt, round(CASE WHEN active AND volume > 0 AND turnover BETWEEN 0.01 AND 100 THEN ln(close * volume / (turnover / 100)) END, 9) + 0.0 AS log_cap FROM canon")
def circulating_cap(spark, d):
    return _canonical(spark, d).select("instrument", "dt", r(fundamentals.positive_log(canonical.circulating_cap()), 9).alias("log_cap"))


@query(
    "bar_validation",
    f"WITH {_RAW}, y AS (SELECT inst, dt, CASE WHEN k % 61 = 1 THEN -open ELSE open END AS open, CASE WHEN k % 67 = 2 THEN low / 2 ELSE high END AS high, CASE WHEN k % 71 = 3 THEN NULL ELSE low END AS low, close, CASE WHEN k % 73 = 4 THEN -volume ELSE volume END AS volume, CASE WHEN k % 79 = 5 THEN NULL ELSE amount END AS amount, CASE WHEN k % 83 = 6 THEN NULL ELSE (NOT is_suspended)::INT END AS status, k FROM (SELECT *, inst * 7 + year(dt) * 12 + month(dt) AS k FROM canon)), "
    "z AS (SELECT * FROM y UNION ALL SELECT * FROM y WHERE k % 59 = 0), v AS (SELECT *, coalesce(status = 1, false) AND coalesce(volume, 0) > 0 AS act, row_number() OVER (PARTITION BY inst, dt) AS again FROM z) "
    "SELECT unnest(['duplicate_bar', 'missing_status', 'invalid_active_price', 'invalid_price_order', 'missing_traded_volume_or_amount', 'negative_volume_or_amount']) AS rule, unnest([count(*) FILTER (again > 1), count(*) FILTER (status IS NULL), count(*) FILTER (act AND (open IS NULL OR open <= 0 OR high IS NULL OR high <= 0 OR low IS NULL OR low <= 0 OR close IS NULL OR close <= 0)), count(*) FILTER (act AND (high < greatest(open, high, low, close) OR low > least(open, high, low, close))), count(*) FILTER (act AND (volume IS NULL OR amount IS NULL)), count(*) FILTER (volume < 0 OR amount < 0)]) AS n FROM v",
)
def bar_validation(spark, d):
    """Bars with planted faults of every kind."""
    x = _canonical(spark, d).withColumn("tradestatus", (~F.col("is_suspended")).cast("int")).withColumn("isST", F.col("is_st").cast("int"))
    k = F.substring("instrument", 3, 9).cast("long") * 7 + F.year("dt") * 12 + F.month("dt")
    bad = {"open": F.when(k % 61 == 1, -F.col("open")).otherwise(F.col("open")), "high": F.when(k % 67 == 2, F.col("low") / 2).otherwise(F.col("high")), "low": F.when(k % 71 != 3, F.col("low")), "volume": F.when(k % 73 == 4, -F.col("volume")).otherwise(F.col("volume")), "amount": F.when(k % 79 != 5, F.col("amount")), "tradestatus": F.when(k % 83 != 6, F.col("tradestatus"))}
    y = x.withColumns(bad)
    return validate.bar_violations(y.unionByName(y.where(k % 59 == 0)))


@query("value_yield_lagged", f"WITH {MARKET} SELECT dt, inst, round(CASE WHEN lag(close) OVER i > 0 THEN 1 / lag(close) OVER i END, 9) + 0.0 AS yield FROM market WINDOW i AS (PARTITION BY inst ORDER BY t)")
def value_yield_lagged(spark, d):
    return panel.market(spark, d).select("dt", "inst", r(fundamentals.lagged_yield(F.col("close")), 9).alias("yield"))


@query("paper_factors", f"WITH {MARKET} SELECT dt, inst, round(CASE WHEN open <> 0 AND close / open > 0 THEN ln(close / open) END, 6) + 0.0 AS \"OPEN_TO_CLOSE\", round((close - open) / (high - low + 0.001), 6) + 0.0 AS \"BODY\", round(CASE WHEN high <> low THEN (close - open) / (high - low) END, 6) + 0.0 AS body_plain, round(close - lag(close, 5) OVER i, 6) + 0.0 AS change5 FROM market WINDOW i AS (PARTITION BY inst ORDER BY t)")
def paper_factors(spark, d):
    names = dsl.PAPER | {"body_plain": "(close - open) / (high - low)", "change5": "Delta(close, 5)"}
    return dsl.evaluate(panel.market(spark, d), names).select("dt", "inst", *(r(c) for c in names))


@query("candidate_factors", f"WITH {MARKET}, c AS (SELECT dt, inst, close / lag(close, 5) OVER i - 1 AS m5, close / lag(close, 20) OVER i - 1 AS m20, turnover / nullif({_win('avg', 'turnover', 20)}, 0) AS t20, turnover / nullif({_win('avg', 'turnover', 60)}, 0) AS t60 FROM market WINDOW i AS (PARTITION BY inst ORDER BY t)) SELECT dt, inst, round(-m5 / (1 + t20), 6) + 0.0 AS \"QUIET_REVERSAL\", round(m20 * t60 / (1 + t60), 6) + 0.0 AS \"ACTIVE_CONTINUATION\" FROM c")
def candidate_factors(spark, d):
    return dsl.evaluate(panel.market(spark, d), dsl.CANDIDATES).select("dt", "inst", *(r(c) for c in dsl.CANDIDATES))


# Statements: a supplier's quarters, each published 20 to 79 days after its end.
_STATEMENTS = """st AS (SELECT l_suppkey AS code, last_day(date_trunc('quarter', l_shipdate)::DATE + INTERVAL 2 MONTH)::DATE AS period, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS profit FROM lineitem GROUP BY 1, 2),
pub AS (SELECT *, (period + (20 + (code * 7 + year(period) + month(period)) % 60)::INT)::DATE AS published FROM st WHERE (code + month(period) + year(period)) % 13 <> 0)"""


def _statements(spark, d) -> DataFrame:
    q = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    st = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("code"), q.alias("period")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("profit"))
    y, m = F.year("period"), F.month("period")
    return st.withColumn("published", F.date_add("period", (20 + (F.col("code") * 7 + y + m) % 60).cast("int"))).where((F.col("code") + m + y) % 13 != 0)


@query(
    "yoy_dependency_events",
    f"WITH {_STATEMENTS}, j AS (SELECT a.code, a.period, a.published AS first, b.published IS NOT NULL AS complete, greatest(a.published, coalesce(b.published, a.published)) AS last, (a.profit - b.profit) / nullif(abs(b.profit), 0) AS value FROM pub a LEFT JOIN pub b ON a.code = b.code AND last_day(a.period - INTERVAL 12 MONTH)::DATE = b.period) "
    "SELECT code, period, first AS published, CASE WHEN complete AND last = first THEN round(value, 6) + 0.0 END AS value, complete FROM j UNION ALL SELECT code, period, last, round(value, 6) + 0.0, complete FROM j WHERE complete AND last > first",
)
def yoy_dependency_events(spark, d):
    x = statements.with_prior(_statements(spark, d), "code", "period", ["profit", "published"], statements.year_before("period"))
    value = (F.col("profit") - F.col("profit_prior")) / F.nullif(F.abs("profit_prior"), F.lit(0.0))
    out = statements.dependency_events(x, value, [F.col("published")], [F.col("published"), F.col("published_prior")], ["code", "period"])
    return out.select("code", "period", "published", r("value"), "complete")


@query("opening_balance", f"WITH {_STATEMENTS} SELECT a.code, a.period, a.profit, b.profit AS profit_prior FROM pub a LEFT JOIN pub b ON a.code = b.code AND make_date(year(a.period) - 1, 12, 31) = b.period")
def opening_balance(spark, d):
    return statements.with_prior(_statements(spark, d), "code", "period", ["profit"], statements.opening("period")).select("code", "period", "profit", "profit_prior")


_REQUESTS = f"{_STATEMENTS}, rq AS (SELECT code, period FROM (SELECT DISTINCT code FROM st) CROSS JOIN (SELECT DISTINCT period FROM st WHERE year(period) >= 2000)), ans AS (SELECT code, period FROM pub WHERE code % 3 <> 0 OR month(period) <> 3)"


def _requests(spark, d) -> tuple[DataFrame, DataFrame]:
    s = _statements(spark, d)
    q = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    li = table(spark, d, "lineitem")
    periods = li.select(q.alias("period")).distinct().where("year(period) >= 2000").agg(F.collect_list("period").alias("p")).select("p").scalar()
    return li.select(F.col("l_suppkey").alias("code")).distinct().withColumn("period", F.explode(periods)), s.where("code % 3 <> 0 or month(period) <> 3").select("code", "period")


@query("source_assignment", f"WITH {_REQUESTS} SELECT q.code, CASE WHEN count(*) = count(a.period) THEN 'primary' ELSE 'fallback' END AS source, count(*) AS planned, count(a.period) AS answered FROM rq q LEFT JOIN ans a ON a.code = q.code AND a.period = q.period GROUP BY q.code")
def source_assignment(spark, d):
    requests, answers = _requests(spark, d)
    return statements.whole_history(requests, answers, ["code"], ["code", "period"], "primary", "fallback")


@query("missing_requests", f"WITH {_REQUESTS} SELECT code, period FROM rq EXCEPT SELECT code, period FROM ans")
def missing_requests(spark, d):
    requests, answers = _requests(spark, d)
    return statements.missing_requests(requests, answers, ["code", "period"])


@query("registry_latest_keep", "SELECT user_id, event_id, event_type, coalesce(event_type = 'purchase', false) AS keep FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def registry_latest_keep(spark, d):
    """Each user's latest event, and whether it is a purchase: one that was followed by another event does not count."""
    keep = F.coalesce(F.col("event_type") == "purchase", F.lit(False)).alias("keep")
    return statements.latest(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type", keep)


@query("reading_errors", "SELECT event_type, count(*) AS n, count(value) AS pairs, round(median(abs(value - round(value, 1))), 9) + 0.0 AS median, round(quantile_cont(abs(value - round(value, 1)), 0.95), 9) + 0.0 AS p95, count(*) FILTER (abs(value - round(value, 1)) <= 0.01) AS within_0 FROM events GROUP BY 1")
def reading_errors(spark, d):
    e = table(spark, d, "events").withColumn("rounded", F.round("value", 1))
    return statements.errors(e, "value", "rounded", ["event_type"], (0.01,)).select("event_type", "n", "pairs", r("median", 9), r("p95", 9), "within_0")


@query("age_quantiles", f"WITH {_STATEMENTS} SELECT code, median(published - period) AS median, quantile_cont(published - period, 0.95) AS p95, max(published - period)::DOUBLE AS most FROM pub GROUP BY code")
def age_quantiles(spark, d):
    return statements.age_quantiles(_statements(spark, d).withColumn("age", F.datediff("published", "period")), "age", ["code"])


@query("industry_keys", "SELECT l.label, CASE WHEN l.label = '' THEN NULL WHEN regexp_matches(l.label, '^[A-S][0-9][0-9]') THEN l.label[1:3] ELSE 'LEGACY:' || l.label END AS key, l.label LIKE 'J66%' OR l.label LIKE '金融业%' AS financial FROM (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'C' || (10 + n_nationkey) || '制造' WHEN 1 THEN '' WHEN 2 THEN 'J66货币' ELSE '金融业-' || n_nationkey END AS label FROM nation) l")
def industry_keys(spark, d):
    k = F.col("n_nationkey")
    label = F.when(k % 4 == 0, F.concat(F.lit("C"), (10 + k).cast("string"), F.lit("制造"))).when(k % 4 == 1, "").when(k % 4 == 2, "J66货币").otherwise(F.concat(F.lit("金融业-"), k.cast("string")))
    x = table(spark, d, "nation").select(label.alias("label")).withColumn("key", fundamentals.industry_key(F.col("label")))
    return x.withColumn("financial", fundamentals.is_financial(F.col("key")))


# Ledgers: a customer's orders are a chain; each event names the one before it, but one in 97 names nothing.
_CHAIN = """ch AS (SELECT o_custkey AS chain, o_orderkey AS event, o_orderdate::DATE AS available, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE lag(o_orderkey) OVER w END AS supersedes, CASE WHEN o_orderkey % 101 = 0 THEN 'QUARANTINED_TEST' ELSE 'OK' END AS data_status, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey)),
broken AS (SELECT chain, min(reason) AS reason FROM (SELECT chain, CASE WHEN data_status LIKE 'QUARANTINED%' THEN 'quarantined_chain' WHEN before IS NOT NULL AND supersedes IS DISTINCT FROM before THEN 'unverified_predecessor' END AS reason FROM ch) WHERE reason IS NOT NULL GROUP BY chain)"""


def _chains(spark, d) -> DataFrame:
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("event"), F.to_date("o_orderdate").alias("available"))
    before = F.lag("event").over(W.partitionBy("chain").orderBy("available", "event"))
    return x.withColumn("supersedes", F.when(F.col("event") % 97 != 0, before)).withColumn("data_status", F.when(F.col("event") % 101 == 0, "QUARANTINED_TEST").otherwise("OK"))


@query("broken_chains", f"WITH {_CHAIN} SELECT chain, reason FROM broken")
def broken_chains(spark, d):
    return ledger.broken_chains(_chains(spark, d), "chain", "event", "available", "supersedes")


@query("revision_chain_asof", f"WITH {_CHAIN}, y AS (SELECT unnest(range(1993, 2002))::INT AS year), sig AS (SELECT c_custkey AS chain, make_date(year, 1, 1) AS dt FROM customer CROSS JOIN y), ok AS (SELECT chain, available, max(event) AS event FROM ch WHERE chain NOT IN (SELECT chain FROM broken) GROUP BY 1, 2) SELECT s.chain, s.dt, o.event FROM sig s ASOF LEFT JOIN ok o ON s.chain = o.chain AND s.dt >= o.available")
def revision_chain_asof(spark, d):
    signals = table(spark, d, "customer").select(F.col("c_custkey").alias("chain"), F.explode(F.sequence(F.lit(1993), F.lit(2001))).alias("year")).select("chain", F.make_date("year", F.lit(1), F.lit(1)).alias("dt"))
    return ledger.chain_asof(signals, _chains(spark, d), "chain", "dt", "event", "available", "supersedes").select("chain", "dt", "event")


@query(
    "vendor_growth_compare",
    """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'QUARANTINED_A' ELSE 'OK' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'RANGE' WHEN 1 THEN 'POINT' ELSE 'OPEN_LOWER' END AS kind, (o_orderkey % 200 - 100)::DECIMAL(30,10) AS lo, (o_orderkey % 200 - 100 + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END)::DECIMAL(30,10) AS hi,
CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE (o_orderkey % 200 - 100)::VARCHAR || '.0' || (o_orderkey % 3)::VARCHAR END AS va, (o_orderkey % 200 - 100 + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END)::VARCHAR || '.0' || (o_orderkey % 3)::VARCHAR AS vb FROM orders),
y AS (SELECT *, TRY_CAST(va AS DECIMAL(30,10)) AS a, TRY_CAST(vb AS DECIMAL(30,10)) AS b FROM x), z AS (SELECT *, greatest(abs(least(a, b) - lo), abs(greatest(a, b) - hi)) AS gap FROM y),
v AS (SELECT *, CASE WHEN status LIKE 'QUARANTINED%' THEN 'QUARANTINED_PRIMARY' WHEN va = '' THEN 'MISSING_VENDOR_BOUND' WHEN a IS NULL THEN 'INVALID_VENDOR_NUMBER' WHEN kind = 'OPEN_LOWER' OR (kind = 'POINT' AND a <> b) THEN 'NOT_COMPARABLE_VALUE_KIND' WHEN gap <= 0.011 THEN 'AGREES_WITHIN_0_011_PP' ELSE 'SOURCE_DIFFERENCE' END AS verdict FROM z)
SELECT k, verdict AS status, CASE WHEN verdict IN ('AGREES_WITHIN_0_011_PP', 'SOURCE_DIFFERENCE') THEN gap::DOUBLE END AS difference FROM v""",
)
def vendor_growth_compare(spark, d):
    k = F.col("o_orderkey")
    lo = k % 200 - 100
    hi = lo + F.when(k % 3 == 0, 10).otherwise(0)
    vendor = lambda c: F.concat(c.cast("string"), F.lit(".0"), (k % 3).cast("string"))
    kind = F.when(k % 3 == 0, "RANGE").when(k % 3 == 1, "POINT").otherwise("OPEN_LOWER")
    got = ledger.compare_growth(F.when(k % 17 == 0, "QUARANTINED_A").otherwise("OK"), kind, lo, hi, lo, F.when(k % 11 == 0, "").when(k % 11 == 1, "n/a").otherwise(vendor(lo)), vendor(hi))
    return table(spark, d, "orders").select(k.alias("k"), got.alias("g")).select("k", "g.status", "g.difference")


@query("text_extract_unique_match", r"WITH x AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\b([a-z]+)@([a-z]+)\b', 0)) AS m FROM documents) SELECT doc_id, CASE WHEN len(m) = 1 THEN split_part(m[1], '@', 1) END AS name, CASE WHEN len(m) = 1 THEN split_part(m[1], '@', 2) END AS host FROM x")
def text_extract_unique_match(spark, d):
    x = table(spark, d, "documents").select("doc_id", ledger.only_match(F.col("text"), r"\b([a-z]+)@([a-z]+)\b", 2).alias("m"))
    return x.select("doc_id", F.get("m", F.lit(0)).alias("name"), F.get("m", F.lit(1)).alias("host"))


@query("memory_retrieval", "SELECT p_partkey, p_name, list_contains(w, 'small')::INT + list_contains(w, 'ring')::INT + list_contains(w, 'blue')::INT AS relevance FROM (SELECT p_partkey, p_name, regexp_extract_all(lower(p_name), '[a-z0-9_]+') AS w FROM part) WHERE relevance > 0 ORDER BY relevance DESC, p_partkey LIMIT 50")
def memory_retrieval(spark, d):
    return ledger.retrieve(table(spark, d, "part"), F.col("p_name"), "p_partkey", "small blue ring", 50).select("p_partkey", "p_name", "relevance")


# Resampling: starts come from a hash, so SQL draws the same blocks.
def bootstrap_sql(source: str, block: int, samples: int, seed: int) -> str:
    """Common tables (bs): factor, n, mean, low, high, p of the series in `source` (factor, dt, x)."""
    return f"""bo AS (SELECT factor, x, row_number() OVER (PARTITION BY factor ORDER BY dt) - 1 AS p, count(*) OVER (PARTITION BY factor) AS n FROM {source}),
bw AS (SELECT factor, n, count(x) AS k, avg(x) AS mean FROM bo GROUP BY 1, 2),
bd AS (SELECT n, s, i, ('0x' || substr(md5('{seed}:' || s || ':' || i), 1, 12))::BIGINT % n AS start FROM (SELECT DISTINCT n FROM bw), range(1, {samples} + 1) a(s), range(1, 400) b(i) WHERE i <= ceil(n / {block})),
bp AS (SELECT n, s, (start + j) % n AS p FROM bd, range({block}) c(j) WHERE (i - 1) * {block} + j < n),
bm AS (SELECT factor, s, avg(x) AS m FROM bp JOIN bo USING (n, p) GROUP BY 1, 2),
bq AS (SELECT factor, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, (1 + count(*) FILTER (m - mean >= mean)) / (count(*) + 1) AS p FROM bm JOIN bw USING (factor) GROUP BY 1),
bs AS (SELECT factor, n, CASE WHEN k >= {max(40, 2 * block)} THEN mean END AS mean, CASE WHEN k >= {max(40, 2 * block)} THEN low END AS low, CASE WHEN k >= {max(40, 2 * block)} THEN high END AS high, CASE WHEN k >= {max(40, 2 * block)} THEN bq.p ELSE 1 END AS p FROM bw JOIN bq USING (factor))"""


# Decisions and statistics over three factors.
_FACTORS = {"mom": "close / Ref(close, 3) - 1", "rev": "-(close / Ref(close, 5) - 1)", "vol": "Std(returns, 6)"}
_LONG = f"""{MARKET}, f AS (SELECT dt, inst, close / lag(close, 3) OVER i - 1 AS mom, -(close / lag(close, 5) OVER i - 1) AS rev, {_win('stddev_samp', 'returns', 6)} AS vol, lead(close, 3) OVER i / lead(close, 1) OVER i - 1 AS label FROM market WINDOW i AS (PARTITION BY inst ORDER BY t)),
l AS (SELECT 'mom' AS factor, dt, mom AS score, label FROM f UNION ALL SELECT 'rev', dt, rev, label FROM f UNION ALL SELECT 'vol', dt, vol, label FROM f), {ic_sql('l', by='factor, dt')}"""


def _features(spark, d) -> DataFrame:
    w = past()
    return dsl.evaluate(panel.market(spark, d), _FACTORS).withColumn("label", ratio(F.lead("close", 3).over(w), F.lead("close", 1).over(w)) - 1)


def _long(spark, d) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("factor"), F.col(n).alias("score")) for n in _FACTORS)))
    return _features(spark, d).select("dt", "label", each.alias("e")).select("dt", "label", "e.*")


def _judged(daily: DataFrame) -> DataFrame:
    """(factor, rank_ic, q): the mean and the adjusted p-value of each factor, in a family of four."""
    p = statistics.bootstrap(daily, "rank_ic", ["factor"], block=6, samples=200, seed=7)
    q = evaluate.bh_adjust(p, "p", family=4).select(F.col("factor").alias("_f"), "q")
    return daily.groupBy("factor").agg(F.avg("rank_ic").alias("rank_ic")).join(q, F.col("factor") == F.col("_f")).drop("_f")


#: What _judged says, as common tables; `t` has factor, rank_ic and q.
_JUDGED_SQL = f"""sr AS (SELECT factor, dt, rank_ic AS x FROM daily), {bootstrap_sql('sr', 6, 200, 7)}, kq AS (SELECT *, row_number() OVER (ORDER BY p) AS k FROM bs),
aq AS (SELECT factor, least(1.0, min(p * 4 / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM kq), t AS (SELECT factor, avg(rank_ic) AS rank_ic, any_value(q) AS q FROM daily JOIN aq USING (factor) GROUP BY 1)"""


@query(
    "screen_gate",
    f"""WITH {_LONG}, {_JUDGED_SQL}, y AS (SELECT factor, year(dt) AS year, avg(rank_ic) AS rank_ic, count(rank_ic) / count(*) AS coverage FROM daily GROUP BY 1, 2),
g AS (SELECT factor, bool_and(coalesce(coverage >= 0.5, false)) AS covered, bool_and(coalesce(rank_ic > 0, false)) AS positive FROM y GROUP BY 1)
SELECT factor, covered AND positive AND coalesce(rank_ic >= -0.05, false) AND q <= 0.5 AS passed FROM t JOIN g USING (factor)""",
)
def screen_gate(spark, d):
    daily = evaluate.daily_ic(_long(spark, d), by=("factor", "dt"), least=LEAST)
    yearly = daily.groupBy("factor", F.year("dt").alias("year")).agg(F.avg("rank_ic").alias("rank_ic"), (F.count("rank_ic") / F.count("*")).alias("coverage"))
    return decide.screen_pass(yearly, _judged(daily), "factor", 0.5, -0.05, 0.5)


@query(
    "supplementary_gate",
    f"""WITH {_LONG}, {_JUDGED_SQL}, y AS (SELECT factor, year(dt) AS year, avg(rank_ic) AS rank_ic, count(rank_ic) / count(*) AS coverage FROM daily GROUP BY 1, 2),
g AS (SELECT factor, bool_and(coalesce(coverage >= 0.2, false)) AS covered, count(*) FILTER (year IN (1996, 1997, 1998, 1999) AND rank_ic > 0) AS positive_full_years FROM y GROUP BY 1)
SELECT factor, CASE WHEN covered AND coalesce(rank_ic >= -0.05, false) AND q <= 0.5 AND positive_full_years >= 1 THEN 'IC_SCREEN_PASS' ELSE 'IC_SCREEN_REJECT' END AS status, covered, positive_full_years, CASE WHEN covered THEN 'DATA_READY_FOR_BOUNDED_MODEL_PROTOCOL' ELSE 'DATA_COVERAGE_BLOCKED' END AS queue FROM t JOIN g USING (factor)""",
)
def supplementary_gate(spark, d):
    daily = evaluate.daily_ic(_long(spark, d), by=("factor", "dt"), least=LEAST)
    yearly = daily.groupBy("factor", F.year("dt").alias("year")).agg(F.avg("rank_ic").alias("rank_ic"), (F.count("rank_ic") / F.count("*")).alias("coverage"))
    return decide.supplementary(yearly, _judged(daily), "factor", [1996, 1997, 1998, 1999], 0.2, -0.05, 0.5, 1)


@query("coverage_gate", f"WITH {_LONG}, n AS (SELECT factor, dt, count(score) AS n FROM l WHERE score IS NOT NULL GROUP BY 1, 2) SELECT factor, sum(n)::BIGINT AS observed, count(*) FILTER (n >= 50) AS eligible_dates, CASE WHEN count(*) FILTER (n >= 50) >= 70 AND count(*) FILTER (n >= 50 AND year(dt) = 1996) >= 12 THEN 'PASS_COVERAGE_ONLY' ELSE 'NO_GO_DATA_COVERAGE' END AS gate FROM n GROUP BY factor")
def coverage_gate(spark, d):
    return decide.coverage_gate(_long(spark, d).withColumnRenamed("score", "value"), "factor", 50, 70, 12, [1996])


@query("pairwise_correlation", f"""WITH {_LONG}, p AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, dt, {a} AS score, {b} AS label FROM f" for i, a in enumerate(_FACTORS) for b in list(_FACTORS)[i:])}), {ic_sql('p', by='a, b, dt').replace('pairs AS', 'pairs2 AS').replace('FROM pairs', 'FROM pairs2').replace('ranked AS', 'ranked2 AS').replace('FROM ranked', 'FROM ranked2').replace('daily AS', 'daily2 AS')}
SELECT a, b, round(avg(rank_ic), 6) + 0.0 AS rho, count(rank_ic) AS days FROM daily2 GROUP BY a, b""")
def pairwise_correlation(spark, d):
    return statistics.pairwise_rank_correlation(_features(spark, d), list(_FACTORS), LEAST).select("a", "b", r("rho"), "days")


_STD = f"{_LONG}, s AS (SELECT {', '.join(f'({n} - avg({n}) OVER (PARTITION BY dt)) / nullif(stddev_samp({n}) OVER (PARTITION BY dt), 0) AS {n}' for n in _FACTORS)} FROM f), c AS (SELECT * FROM s WHERE mom IS NOT NULL AND rev IS NOT NULL AND vol IS NOT NULL)"


@query("feature_covariance", f"WITH {_STD} {' UNION ALL '.join(f'''SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 6) + 0.0 AS cov FROM c''' for i, a in enumerate(_FACTORS) for b in list(_FACTORS)[i:])}")
def feature_covariance(spark, d):
    return statistics.covariance(statistics.daily_standard(_features(spark, d), list(_FACTORS)), list(_FACTORS)).select("a", "b", r("cov"))


@query("pca_projection")
def pca_projection(spark, d):
    """No SQL: eigenvectors. Compared with numpy in the tests."""
    x = statistics.daily_standard(_features(spark, d), list(_FACTORS))
    return statistics.fit_basis(x, list(_FACTORS), target=0.99, least=100).project(x).select("dt", "inst", "PC01", "PC02")


@query("paired_increment", f"WITH {SCORED}, {reports_sql(30, 0.002, 'p')}, {reports_sql(10, 0.002, 'top')} SELECT p.dt, year(p.dt)::INT AS year, round((top.ret - top.cost) - (p.ret - p.cost), 9) + 0.0 AS increment FROM p JOIN top USING (dt)")
def paired_increment(spark, d):
    """The ten best against the thirty best."""
    return statistics.paired_increment(report(spark, d, 10), report(spark, d, 30)).select("dt", "year", r("increment", 9))


@query("annual_increments", f"WITH {SCORED}, {reports_sql(30, 0.002, 'p')}, {reports_sql(10, 0.002, 'top')}, i AS (SELECT year(p.dt)::INT AS year, (top.ret - top.cost) - (p.ret - p.cost) AS x FROM p JOIN top USING (dt)) SELECT year, round(avg(x) * 12, 6) + 0.0 AS increment, count(x) AS dates FROM i GROUP BY year UNION ALL SELECT NULL, round(avg(x) * 12, 6) + 0.0, count(x) FROM i")
def annual_increments(spark, d):
    return statistics.annual_increments(statistics.paired_increment(report(spark, d, 10), report(spark, d, 30)), 12).select("year", r("increment"), "dates")


@query("double_fee_excess", f"WITH {SCORED}, {reports_sql(30, 0.002, 'p')} SELECT round(avg(ret - cost - bench) * 12, 6) + 0.0 AS excess, round(avg(ret - 2 * cost - bench) * 12, 6) + 0.0 AS stressed FROM p")
def double_fee_excess(spark, d):
    return statistics.double_fee_excess(report(spark, d), 12).select(r("excess"), r("stressed"))


@query("risk_analysis", f"WITH {SCORED}, {reports_sql(30, 0.002, 'p')}, y AS (SELECT *, sum(ret) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS s FROM p), z AS (SELECT *, s - max(s) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS down FROM y) SELECT round(avg(ret), 9) + 0.0 AS mean, round(stddev_samp(ret), 9) + 0.0 AS std, round(avg(ret) * 12, 6) + 0.0 AS annual, round(avg(ret) / stddev_samp(ret) * sqrt(12), 6) + 0.0 AS ir, round(min(down), 6) + 0.0 AS drawdown FROM z")
def risk_analysis(spark, d):
    return evaluate.risk_analysis(report(spark, d), "ret", 12).select(r("mean", 9), r("std", 9), r("annual"), r("ir"), r("drawdown"))


@query("off_schedule", f"WITH {SCORED}, {reports_sql(30, 0.002, 'p')}, s AS (SELECT dt FROM (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS n FROM cal) WHERE n % 3 = 0) SELECT dt, round(cost, 9) + 0.0 AS cost FROM p WHERE cost <> 0 AND dt NOT IN (SELECT dt FROM s)")
def off_schedule(spark, d):
    """A portfolio that trades on every date against a schedule of every third."""
    return validate.off_schedule(report(spark, d), decide.rebalance_dates(panel.calendar(panel.bars(spark, d)), 3)).select("dt", r("cost", 9))


@query(
    "exposure_report",
    f"WITH {SCORED}, l AS (SELECT 'size' AS exposure, dt, score, close AS label FROM scored UNION ALL SELECT 'turnover', dt, score, turnover FROM scored), {ic_sql('l', by='exposure, dt')}, m AS (SELECT exposure, avg(rank_ic) AS value, count(rank_ic) AS days FROM daily GROUP BY 1) SELECT e.exposure, CASE WHEN e.exposure NOT IN ('size', 'turnover') THEN 'MISSING_DATA' WHEN value IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'AVAILABLE' END AS status, round(value, 6) + 0.0 AS value, coalesce(days, 0) AS days FROM (SELECT unnest(['size', 'industry', 'volatility', 'turnover']) AS exposure) e LEFT JOIN m USING (exposure)",
)
def exposure_report(spark, d):
    return statistics.exposures(scored(spark, d), "score", {"size": "close", "turnover": "turnover"}, least=LEAST).select("exposure", "status", r("value"), "days")


@query("point_in_intervals", "WITH o AS (SELECT o_orderkey AS k, o_custkey AS inst, o_orderdate::DATE AS dt FROM orders), i AS (SELECT c_custkey AS inst, make_date(1995 + (c_custkey % 3)::INT, 1, 1) AS s, make_date(1997 + (c_custkey % 3)::INT, 6, 30) AS e FROM customer) SELECT k, inst, dt FROM o WHERE EXISTS (SELECT 1 FROM i WHERE i.inst = o.inst AND o.dt BETWEEN i.s AND i.e)")
def point_in_intervals(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("inst"), F.to_date("o_orderdate").alias("dt"))
    shift = (F.col("c_custkey") % 3).cast("int")
    i = table(spark, d, "customer").select(F.col("c_custkey").alias("inst"), F.make_date(1995 + shift, F.lit(1), F.lit(1)).alias("start_dt"), F.make_date(1997 + shift, F.lit(6), F.lit(30)).alias("end_dt"))
    return asof.within(o, i, "inst", "dt")


@query("rebalance_dates", f"WITH {MARKET}, x AS (SELECT dt, lag(dt) OVER (ORDER BY t) AS signal_dt, t FROM cal) SELECT dt, signal_dt FROM x WHERE (t - 1) % 3 = 0")
def rebalance_dates(spark, d):
    return decide.rebalance_dates(panel.calendar(panel.bars(spark, d)), 3)


@query("membership_validation", "WITH days AS (SELECT o_orderdate::DATE AS dt, count(*) AS n, count(DISTINCT o_custkey) AS codes, bool_or(o_orderkey % 199 = 0) AS late FROM orders GROUP BY 1), cal AS (SELECT DISTINCT l_shipdate::DATE AS dt FROM lineitem), b AS (SELECT days.dt AS a, cal.dt AS c, n, codes, late FROM days FULL JOIN cal ON days.dt = cal.dt) SELECT unnest(['missing_date', 'date_off_calendar', 'duplicate_member', 'future_update']) AS rule, unnest([count(*) FILTER (a IS NULL), count(*) FILTER (c IS NULL), count(*) FILTER (n > codes), count(*) FILTER (late)]) AS n FROM b")
def membership_validation(spark, d):
    day = F.to_date("o_orderdate")
    snapshots = table(spark, d, "orders").select(day.alias("dt"), F.col("o_custkey").alias("code"), F.date_add(day, F.when(F.col("o_orderkey") % 199 == 0, 3).otherwise(-1)).alias("updated"))
    return validate.membership_violations(snapshots, table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("dt")))

"""Queries that make each check, refusal, reader and rule act on planted cases, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.catalog import LEAST, MARKET, SCORED, query, r, scored
from almanac.catalog_more import _FACTORS, _LONG, _STATEMENTS, _features, _long, _statements, bootstrap_sql
from almanac.functions import dsl, fundamentals
from almanac.functions.cross import finite
from almanac.operators import decide, evaluate, events, ledger, statements, statistics, validate
from almanac.plans import canonical, panel
from almanac.sources import files
from almanac.sources.shared import shared_dir
from almanac.sources.tables import string_csv, table


@query(
    "prediction_checks",
    f"""WITH {SCORED}, s AS (SELECT dt, inst, t, score, label FROM scored WHERE score IS NOT NULL), pr AS (SELECT dt, inst, t, CASE WHEN inst % 19 = 2 AND t % 7 = 0 THEN NULL ELSE score END AS x FROM s WHERE inst % 23 <> 1 AND t % 31 <> 0), p AS (SELECT * FROM pr UNION ALL SELECT * FROM pr WHERE inst % 17 = 3 AND t % 10 = 0),
l AS (SELECT dt, inst FROM s WHERE label IS NOT NULL), b AS (SELECT p.*, p.dt IS NOT NULL AS here, l.dt IS NOT NULL AS there, row_number() OVER (PARTITION BY p.dt, p.inst) AS again FROM p FULL JOIN l ON p.dt = l.dt AND p.inst = l.inst),
d AS (SELECT a.dt AS a, c.dt AS c FROM (SELECT DISTINCT dt FROM p) a FULL JOIN (SELECT DISTINCT dt FROM l) c ON a.dt = c.dt)
SELECT unnest(['duplicate_prediction', 'nonfinite_prediction', 'not_aligned', 'date_coverage', 'empty']) AS rule, unnest([(SELECT count(*) FILTER (here AND again > 1) FROM b), (SELECT count(*) FILTER (here AND x IS NULL) FROM b), (SELECT count(*) FILTER (NOT here OR NOT there) FROM b), (SELECT count(*) FILTER (a IS NULL OR c IS NULL) FROM d), 0]) AS n""",
)
def prediction_checks(spark, d):
    """Scores with repeats, holes, missing instruments and missing dates against the labels."""
    s = scored(spark, d).where("score is not null").select("dt", "inst", "t", "score", "label")
    i, t = F.col("inst"), F.col("t")
    p = s.where((i % 23 != 1) & (t % 31 != 0)).withColumn("score", F.when((i % 19 == 2) & (t % 7 == 0), F.lit(float("nan"))).otherwise(F.col("score")))
    p = p.unionByName(p.where((i % 17 == 3) & (t % 10 == 0))).select("dt", "inst", "score")
    labels = s.where("label is not null").select("dt", "inst", "label")
    return validate.prediction_violations(p, labels, labels.select("dt"))


_DAILY = """dy AS (SELECT l_shipdate::DATE AS dt, dayofyear(l_shipdate) AS y, avg(l_discount::DECIMAL(18,4)) AS a, avg(l_tax::DECIMAL(18,4)) AS b FROM lineitem GROUP BY 1, 2),
rp AS (SELECT dt, y, CASE WHEN y % 80 = 4 THEN NULL WHEN y % 90 = 5 THEN -1.5 ELSE a END AS ret, b AS bench, CASE WHEN y % 50 = 1 THEN -0.01 WHEN y % 60 = 2 THEN 0 ELSE 0.001 END AS cost, CASE WHEN y % 70 = 3 THEN -0.1 ELSE 0.5 END AS turnover FROM dy)"""


def _daily_report(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("dt")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("bench")).withColumn("y", F.dayofyear("dt"))
    y = F.col("y")
    return li.select("dt", "y", F.when(y % 80 == 4, float("nan")).when(y % 90 == 5, -1.5).otherwise(F.col("a")).alias("ret"), "bench", F.when(y % 50 == 1, -0.01).when(y % 60 == 2, 0.0).otherwise(0.001).alias("cost"), F.when(y % 70 == 3, -0.1).otherwise(0.5).alias("turnover"))


@query("report_checks", f"WITH {_DAILY}, z AS (SELECT * FROM rp UNION ALL SELECT * FROM rp WHERE y % 100 = 6), v AS (SELECT *, row_number() OVER (PARTITION BY dt) AS again FROM z) SELECT unnest(['duplicate_date', 'nonfinite', 'negative_turnover', 'cost', 'ruin']) AS rule, unnest([count(*) FILTER (again > 1), count(*) FILTER (ret IS NULL), count(*) FILTER (turnover < 0), count(*) FILTER (cost < 0 OR (turnover > 0 AND cost <= 0)), count(*) FILTER (ret - cost <= -1)]) AS n FROM v")
def report_checks(spark, d):
    x = _daily_report(spark, d)
    return validate.report_violations(x.unionByName(x.where("y % 100 = 6")))


@query("protected_periods", "SELECT 'protected_period' AS rule, count(*) FILTER (o_orderdate::DATE >= DATE '2000-01-01') AS n FROM orders")
def protected_periods(spark, d):
    return validate.period_violations(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("dt")), "dt", "2000-01-01")


@query("factor_checks", "WITH f AS (SELECT l_suppkey AS code, date_trunc('year', l_shipdate)::DATE AS d, avg(l_tax) AS x FROM lineitem GROUP BY 1, 2), g AS (SELECT code, d, CASE WHEN code % 13 = 1 THEN NULL WHEN code % 17 = 2 THEN -x ELSE 1 + x END AS x FROM f), h AS (SELECT * FROM g UNION ALL SELECT * FROM g WHERE code % 11 = 3), i AS (SELECT *, row_number() OVER (PARTITION BY code, d) AS again FROM h) SELECT unnest(['duplicate_date', 'invalid_factor', 'unknown_code']) AS rule, unnest([count(*) FILTER (again > 1), count(*) FILTER (x IS NULL OR x <= 0), count(*) FILTER (code % 7 = 5)]) AS n FROM i")
def factor_checks(spark, d):
    li, c = table(spark, d, "lineitem"), F.col("code")
    f = li.groupBy(F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "year").alias("effective_date")).agg(F.avg("l_tax").alias("x"))
    f = f.select("code", "effective_date", F.when(c % 13 == 1, float("nan")).when(c % 17 == 2, -F.col("x")).otherwise(1 + F.col("x")).alias("factor"))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code")).where("code % 7 <> 5")
    return validate.factor_violations(f.unionByName(f.where(c % 11 == 3)), known)


@query("published_by", "SELECT o_orderkey AS k, o_orderdate::DATE > DATE '1998-12-31' AS late FROM orders")
def published_by(spark, d):
    on_time, late = events.published_by(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("pub")), "pub", "1998-12-31")
    return on_time.select("k", F.lit(False).alias("late")).unionByName(late.select("k", F.lit(True).alias("late")))


@query("cash_surplus", "WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 50) / 100 AS m, (o_orderkey % 7) / 5 AS p FROM orders), x AS (SELECT k, m, p, p * m + CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.00001 WHEN 2 THEN 0.00005 ELSE -0.00001 END AS s FROM o) SELECT k, CASE WHEN abs(p * m - s) <= 2e-5 + 2e-5 * abs(s) THEN round(s - m, 9) + 0.0 END AS surplus FROM x")
def cash_surplus(spark, d):
    """Ratios that agree, agree within the tolerance, and do not."""
    k = F.col("o_orderkey")
    m, p = (k % 50) / 100, (k % 7) / 5
    s = p * m + F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 1e-5).when(k % 4 == 2, 5e-5).otherwise(-1e-5)
    return table(spark, d, "orders").select(k.alias("k"), r(fundamentals.cash_surplus(s, p, m), 9).alias("surplus"))


@query("signed_guidance", "SELECT o_orderkey AS k, round(sign(v) * ln(1 + abs(v) / 100), 9) + 0.0 AS x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 400 - 200)::DOUBLE END AS v FROM orders)")
def signed_guidance(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), r(fundamentals.signed_log(F.when(k % 9 != 0, (k % 400 - 200).cast("double"))), 9).alias("x"))


# Statements of both kinds: profits from shipments, equity from quantities; every fourth code is a bank.
_ROE_SQL = f"""{_STATEMENTS}, inc AS (SELECT code, period, published AS notice, CASE WHEN (code + month(period)) % 5 = 0 THEN NULL ELSE published + ((code % 3) * 40)::INT END AS updated, profit AS parent, profit * 0.9 AS net, CASE WHEN code % 9 = 0 THEN 0 ELSE profit * 4 END AS income, profit * 5 AS total, CASE code % 4 WHEN 0 THEN '银行' ELSE '通用' END AS kind FROM pub),
bal AS (SELECT code, period, published + 5 AS notice, published + 5 AS updated, profit * 10 + 1000 AS equity FROM pub WHERE (code + year(period)) % 6 <> 0),
j AS (SELECT coalesce(i.code, b.code) AS code, coalesce(i.period, b.period) AS period, i.notice AS ni, i.updated AS ui, b.notice AS nb, b.updated AS ub, i.parent, i.net, i.income, i.total, i.kind, b.equity FROM inc i FULL JOIN bal b ON i.code = b.code AND i.period = b.period),
k AS (SELECT j.*, o.notice AS no, o.updated AS uo, o.equity AS opening FROM j LEFT JOIN bal o ON o.code = j.code AND o.period = make_date(year(j.period) - 1, 12, 31)),
fe AS (SELECT code, period, 'roe' AS field, least(ni, nb) AS first, ni IS NOT NULL AND nb IS NOT NULL AND no IS NOT NULL AS complete, ui IS NOT NULL AND ub IS NOT NULL AND uo IS NOT NULL AS known, greatest(ni, nb, no) AS noticed, greatest(ni, nb, no, ui, ub, uo) AS changed, parent / nullif((equity + opening) / 2, 0) AS value FROM k
UNION ALL SELECT code, period, 'margin', ni, ni IS NOT NULL, ui IS NOT NULL, ni, greatest(ni, ui), net / nullif(CASE WHEN kind = '银行' THEN total ELSE income END, 0) FROM k),
fx AS (SELECT code, period, field, first, complete, CASE WHEN complete THEN CASE WHEN known THEN changed ELSE noticed END ELSE first END AS avail, CASE WHEN known THEN value END AS value FROM fe WHERE first IS NOT NULL)"""


@query("roe_events", f"WITH {_ROE_SQL} SELECT code, period, field, first AS published, CASE WHEN complete AND avail = first THEN round(value, 9) + 0.0 END AS value, complete FROM fx UNION ALL SELECT code, period, field, avail, round(value, 9) + 0.0, complete FROM fx WHERE complete AND avail > first")
def roe_events(spark, d):
    s = _statements(spark, d)
    code, profit, pub = F.col("code"), F.col("profit"), F.col("published")
    updated = F.when((code + F.month("period")) % 5 != 0, F.date_add(pub, ((code % 3) * 40).cast("int")))
    income = s.select("code", "period", pub.alias("notice"), updated.alias("updated"), profit.alias("parent_profit"), (profit * 0.9).alias("profit"), F.when(code % 9 == 0, 0.0).otherwise(profit * 4).alias("income"), (profit * 5).alias("total_income"), F.when(code % 4 == 0, "银行").otherwise("通用").alias("kind"))
    balance = s.where((code + F.year("period")) % 6 != 0).select("code", "period", F.date_add(pub, 5).alias("notice"), F.date_add(pub, 5).alias("updated"), (profit * 10 + 1000).alias("equity"))
    return statements.reconstructed(income, balance).select("code", "period", "field", "published", r("value", 9), "complete")


@query("joint_gate", f"WITH {_LONG}, sr AS (SELECT factor, dt, rank_ic AS x FROM daily), {bootstrap_sql('sr', 6, 200, 11)}, y AS (SELECT factor, year(dt) AS year, avg(rank_ic) AS m FROM daily GROUP BY 1, 2), g AS (SELECT factor, count(*) FILTER (m > 0 AND year IN (1996, 1997, 1998, 1999, 2000)) AS full_years FROM y GROUP BY 1), k AS (SELECT bs.*, full_years, row_number() OVER (ORDER BY p) AS k FROM bs JOIN g USING (factor)), q AS (SELECT *, least(1.0, min(p * 3 / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k), w AS (SELECT *, unnest([0, 1, 2]) AS shift FROM q), v AS (SELECT factor, shift, CASE WHEN mean + shift * 0.1 >= 0.05 AND q - shift * 0.4 <= 0.3 AND (mean + shift * 0.1) * 12 >= 0.5 AND low + shift * 0.1 > 0 AND full_years + shift >= 3 THEN 'GO' ELSE 'NO_GO' END AS decision FROM w) SELECT factor, shift, decision FROM v")
def joint_gate(spark, d):
    """Three factors as they are and made better twice: some pass."""
    daily = evaluate.daily_ic(_long(spark, d), by=("factor", "dt"), least=LEAST)
    b = evaluate.bh_adjust(statistics.bootstrap(daily, "rank_ic", ["factor"], block=6, samples=200, seed=11), "p")
    years = daily.groupBy("factor", F.year("dt").alias("year")).agg(F.avg("rank_ic").alias("m")).groupBy(F.col("factor").alias("_f")).agg(F.count_if(F.col("year").between(1996, 2000) & (F.col("m") > 0)).alias("years"))
    x = b.join(years, F.col("factor") == F.col("_f")).withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    s = F.col("shift")
    x = x.select("factor", "shift", (F.col("mean") + s * 0.1).alias("rank_ic_mean"), (F.col("q") - s * 0.4).alias("q"), (F.col("mean") + s * 0.1).alias("net_mean"), (F.col("low") + s * 0.1).alias("net_low"), (F.col("years") + s).alias("positive_full_years"))
    return decide.joint_gate(x, 0.05, 0.3, 0.5, 3, 12).select("factor", "shift", "decision")


_VARIANTS = "WITH x AS (SELECT l_suppkey % 20 AS family, l_suppkey AS name, avg(l_discount::DECIMAL(18,4)) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _variants(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("family"), F.col("l_suppkey").alias("name")).agg(F.avg("l_discount").alias("v"), F.count("*").alias("n"))


@query("first_of_family", f"{_VARIANTS} SELECT family, min(name) AS name FROM x WHERE v > 0.05 AND name % 3 <> 0 GROUP BY family")
def first_of_family(spark, d):
    return decide.first_of_family(_variants(spark, d), "family", "name", "name", (F.round("v", 9) > 0.05) & (F.col("name") % 3 != 0))


@query("winner", "SELECT n_nationkey AS name, n_regionkey AS value FROM nation ORDER BY n_regionkey DESC, n_nationkey LIMIT 1")
def winner(spark, d):
    """Many nations tie for the largest region key."""
    return decide.winner(table(spark, d, "nation").select(F.col("n_nationkey").alias("name"), F.col("n_regionkey").alias("value")), "value", "name")


@query("survivors", f"{_VARIANTS} SELECT name FROM x WHERE v > 0.05")
def survivors(spark, d):
    x = _variants(spark, d).withColumn("passed", F.round("v", 9) > 0.05)
    claimed = x.select("name", F.when(F.col("passed"), "FORWARD").otherwise("REJECT").alias("status"))
    return decide.survivors(claimed, x.select("name", "passed"), "name")


@query("common_support", f"WITH {_LONG} SELECT dt, inst FROM f WHERE mom IS NOT NULL AND rev IS NOT NULL AND vol IS NOT NULL AND inst % 7 <> 2")
def common_support(spark, d):
    x = _features(spark, d).withColumn("rev", F.when(F.col("inst") % 7 == 2, float("inf")).otherwise(F.col("rev")))
    return decide.common_support(x, list(_FACTORS)).select("dt", "inst")


@query("factor_subsets", "WITH " + _LONG + " " + " UNION ALL ".join(f"SELECT '{'+'.join(s)}' AS names, count(*) FILTER ({' AND '.join(f'{n} IS NOT NULL' for n in s)}) AS rows FROM f" for s in statistics.subsets(list(_FACTORS))))
def factor_subsets(spark, d):
    return statistics.support(_features(spark, d), list(_FACTORS))


@query("blended_scores", f"WITH {_LONG}, b AS (SELECT * FROM f WHERE mom IS NOT NULL AND vol IS NOT NULL) SELECT dt, inst, round(0.75 * (mom - avg(mom) OVER w) / nullif(stddev_pop(mom) OVER w, 0) + 0.25 * (vol - avg(vol) OVER w) / nullif(stddev_pop(vol) OVER w, 0), 6) + 0.0 AS blend FROM b WINDOW w AS (PARTITION BY dt)")
def blended_scores(spark, d):
    return statistics.blended(_features(spark, d), "mom", "vol").select("dt", "inst", r("blend"))


_CHAINS = """WITH o AS (SELECT o_custkey % 40 AS code, year(o_orderdate)::INT AS year, o_orderkey AS k, o_orderdate::DATE AS dt FROM orders),
x AS (SELECT *, CASE WHEN k % 3 = 0 THEN [dt - 1, dt - 1, dt] ELSE [] END AS refs FROM o)"""


@query("chain_summary", f"{_CHAINS} SELECT code, year, count(*) AS documents, count(*) FILTER (k % 3 = 0) AS revisions, array_to_string(list(k ORDER BY dt, k), ',') AS ids, array_to_string(list_sort(list_filter(list_distinct(flatten(list(refs))), lambda r: NOT list_contains(list(dt), r))), ',') AS missing_references FROM x GROUP BY code, year")
def chain_summary(spark, d):
    """Revisions refer to their own date and the day before, which some of a code's other documents have."""
    k, dt = F.col("o_orderkey"), F.to_date("o_orderdate")
    x = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("code"), F.year("o_orderdate").alias("year"), k.alias("k"), dt.alias("dt"), (k % 3 == 0).alias("revised"), F.when(k % 3 == 0, F.array(F.date_sub(dt, 1), F.date_sub(dt, 1), dt)).otherwise(F.array().cast("array<date>")).alias("refs"))
    out = ledger.chain_summary(x, ["code", "year"], "k", "dt", "revised", "refs")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("code", "year", "documents", "revisions", text("ids"), text("missing_references"))


_GUIDANCE = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 9000 - 3000 AS a, o_orderkey % 170 - 60 AS g, o_orderkey % 6 AS form FROM orders)"""


@query("guidance_fields", f"{_GUIDANCE} SELECT k, CASE WHEN form NOT IN (3, 4) THEN ((a + 0.25) * 10000)::DOUBLE END AS profit_lower, CASE WHEN form NOT IN (3, 4) THEN ((a + 50.5) * 10000)::DOUBLE END AS profit_upper, CASE WHEN form NOT IN (3, 4) THEN g::DOUBLE END AS growth_lower, CASE WHEN form NOT IN (3, 4) THEN (g + 10)::DOUBLE END AS growth_upper FROM o")
def guidance_fields(spark, d):
    """Template lines with breaks and full-width marks, of another year, and twice with different values."""
    k = F.col("o_orderkey")
    a, g, form = k % 9000 - 3000, k % 170 - 60, k % 6
    number = lambda x: x.cast("decimal(12,2)").cast("string")
    line = lambda year, low: F.concat(F.lit(f"{year}年1-3月归属于上市公司股东的净利润区间（万元）"), F.when(form == 1, " ").otherwise(""), number(low + F.lit(0.25)), F.lit("至"), F.when(form == 1, "\n").otherwise(""), number(low + F.lit(50.5)), F.lit("\n"))
    growth = F.concat(F.lit("2015年1-3月归属于上市公司股东的净利润变动幅度"), g.cast("string"), F.lit("%至"), (g + 10).cast("string"), F.when(form == 2, "％").otherwise("%"))
    text = F.when(form == 3, F.concat(line(2014, a), growth)).when(form == 4, F.concat(line(2015, a), line(2015, a + 1), growth)).otherwise(F.concat(line(2015, a), growth, F.lit("\n2016 年")))
    return table(spark, d, "orders").select(k.alias("k"), ledger.first_quarter_guidance(text, 2015).alias("v")).select("k", "v.*")


@query("referred_dates", "WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS dt FROM orders) SELECT k, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN dt::VARCHAR ELSE (dt - 40)::VARCHAR || ',' || dt::VARCHAR END AS dates FROM o")
def referred_dates(spark, d):
    """Dates in the section on an earlier forecast, twice each; dates before it and after it do not count."""
    k, dt = F.col("o_orderkey"), F.to_date("o_orderdate")
    say = lambda x: F.concat(F.when(F.year(x) < 2000, F.concat(F.lit("20"), F.date_format(x, "yy"))).otherwise(F.date_format(x, "yyyy")), F.lit(" 年"), F.month(x).cast("string"), F.lit("月"), F.dayofmonth(x).cast("string"), F.lit("日"))
    body = F.when(k % 3 == 1, F.concat(say(dt), F.lit("，"), say(dt))).otherwise(F.concat(say(dt), F.lit("与"), say(F.date_sub(dt, 40))))
    text = F.when(k % 3 == 0, F.concat(F.lit("公告日 "), say(dt))).otherwise(F.concat(F.lit("2001年1月1日 前次业绩 预告情况："), body, F.lit("。修正后的预计：2002年2月2日")))
    shift = lambda s: F.regexp_replace(s, "^20(9\\d)", "19$1")
    return table(spark, d, "orders").select(k.alias("k"), F.array_join(F.array_sort(F.transform(ledger.referred_dates(text), shift)), ",").alias("dates"))


@query(
    "vendor_scope",
    "WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '1997-06-30' ELSE year(o_orderdate)::VARCHAR || '-03-31' END AS period, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE o_orderdate::DATE::VARCHAR END AS notice, o_orderkey % 5 <> 0 AS member FROM orders), x AS (SELECT *, period IN ('1996-03-31', '1997-03-31', '1998-03-31') AS known, try_cast(notice AS DATE) IS NOT NULL AS dated FROM o) "
    "SELECT k, concat_ws(',', CASE WHEN NOT known THEN 'NON_TARGET_REPORT_PERIOD' END, CASE WHEN NOT dated THEN 'INVALID_PUBLICATION_DATE' END, CASE WHEN dated AND known AND NOT notice BETWEEN period[1:4] || '-01-01' AND period[1:4] || '-04-30' THEN 'OUTSIDE_TARGET_NOTICE_WINDOW' END, CASE WHEN NOT member THEN 'NOT_IN_TARGET_YEAR_MEMBER_UNION' END) AS reasons FROM x",
)
def vendor_scope(spark, d):
    k = F.col("o_orderkey")
    period = F.when(k % 4 == 0, "1997-06-30").otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("-03-31")))
    notice = F.when(k % 7 == 0, "unknown").otherwise(F.to_date("o_orderdate").cast("string"))
    reasons = ledger.vendor_scope(period, notice, ["1996-03-31", "1997-03-31", "1998-03-31"], k % 5 != 0)
    return table(spark, d, "orders").select(k.alias("k"), F.array_join(reasons, ",").alias("reasons"))


@query(
    "evidence_error_codes",
    "WITH o AS (SELECT o_orderkey AS k, o_orderkey % 400 + 1 AS a FROM orders), e AS (SELECT k, list_sort(list_distinct(list_filter([CASE WHEN k % 11 = 0 THEN 'IDENTITY_MISMATCH' END, CASE WHEN k % 13 = 0 THEN 'NUMERIC_WITHOUT_VERIFIED_Q1_PERIOD' END, CASE WHEN k % 17 = 0 AND k % 5 <> 0 AND k % 7 <> 0 THEN 'UNSUPPORTED_NUMBER:profit.lower' END, CASE WHEN k % 7 = 0 THEN 'MISSING_PAGE:9' END, CASE WHEN k % 7 <> 0 AND k % 5 = 0 THEN 'QUOTE_NOT_IN_PAGE:parent_profit_range' END, "
    "CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'MISSING_SUPPORT:profit.lower' END, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'MISSING_SUPPORT:profit.upper' END, CASE WHEN k % 17 = 0 AND a + 1000 > a + 20 THEN 'UNORDERED_RANGE:profit' END, CASE WHEN k % 19 = 0 THEN 'INVALID_EXTRACTION_STATUS' END, CASE WHEN k % 23 = 0 THEN 'VALUE_KIND_CONFLICT:yoy' END, CASE WHEN k % 29 = 0 THEN 'PRIOR_REFERENCE_EVIDENCE_MISSING' END], lambda c: c IS NOT NULL))) AS c FROM o) SELECT k, array_to_string(c, ',') AS codes FROM e",
)
def evidence_error_codes(spark, d):
    """Transcribed ranges with one fault or several planted by the remainder of the key."""
    k, no = F.col("o_orderkey"), F.lit(None)
    a = k % 400 + 1
    bound = "struct<kind:string,lower:double,upper:double,point:double>"
    quote = F.concat(F.lit("净利润 "), a.cast("string"), F.lit(" 万元 至 "), (a + 20).cast("string"), F.lit(" 万元"))
    lower = (a + F.when(k % 17 == 0, 1000).otherwise(0)) * 10000.0
    record = F.struct(
        F.when(k % 11 == 0, "other").otherwise(k.cast("string")).alias("announcement_id"), F.lit("source_claim").alias("claim_type"), F.when(k % 13 == 0, "OTHER").otherwise("Q1_FORECAST").alias("document_class"), F.when(k % 19 == 0, "FINAL").otherwise("DRAFT_EXTRACTED").alias("extraction_status"),
        F.lit("万元").alias("money_unit"), F.lit("2015-03-31").alias("period"), no.cast("string").alias("signature_date"), F.when(k % 29 == 0, "earlier").alias("prior_reference"),
        F.struct(F.lit("RANGE").alias("kind"), lower.alias("lower"), ((a + 20) * 10000.0).alias("upper"), no.cast("double").alias("point")).cast(bound).alias("profit"), F.struct(F.when(k % 23 == 0, "POINT").otherwise("MISSING").alias("kind"), no.cast("double").alias("lower"), no.cast("double").alias("upper"), no.cast("double").alias("point")).cast(bound).alias("yoy"),
        F.array(F.struct(F.lit("parent_profit_range").alias("field"), F.when(k % 7 == 0, 9).when(k % 5 == 0, 2).otherwise(1).alias("page"), quote.alias("quote"))).alias("evidence"),
    )
    text = F.concat(F.lit("=== PAGE 1 === 预计 "), F.regexp_replace(quote, " ", ""), F.lit("=== PAGE 2 === none"))
    # A small table is one task; the keys are dealt out before the work.
    keys = table(spark, d, "orders").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism)
    x = keys.select(k.alias("k"), record.alias("record"), F.struct(k.cast("string").alias("announcement_id"), F.lit("2015-03-31").alias("period")).alias("doc"), text.alias("text"))
    return x.select("k", F.array_join(ledger.evidence_errors(), ",").alias("codes"))


@query("cluster_representatives")
def cluster_representatives(spark, d):
    """Of five factors, two pairs nearly the same. No SQL: complete linkage; the tests compare it with a plain search."""
    names = {"mom": "close / Ref(close, 3) - 1", "mom_again": "Log(close / Ref(close, 3))", "rev": "-(close / Ref(close, 5) - 1)", "vol": "Std(returns, 6)", "vol_again": "Std(returns, 6) * 2 + 1"}
    f = dsl.evaluate(panel.market(spark, d), names)
    rho = [tuple(x) for x in statistics.pairwise_rank_correlation(f, list(names), LEAST).select("a", "b", "rho", "days").collect()]
    share = f.agg(*(F.avg(finite(F.col(n)).isNotNull().cast("double")).alias(n) for n in names)).first().asDict()
    return spark.createDataFrame(statistics.clusters(rho, share, 20, 0.8), "feature string, cluster int, representative string")


# Index bars have no status, and some bars are of stocks under special treatment.
@query("index_and_special_bars", f"WITH {MARKET} SELECT CASE WHEN inst = 7 THEN 'SH000300' ELSE 'SH' || inst END AS instrument, dt, CASE WHEN inst = 7 THEN false ELSE t % 5 = 0 END OR coalesce(volume, 0) <= 0 AS is_suspended, inst <> 7 AND inst % 10 = 3 AS is_st FROM market WHERE close IS NOT NULL")
def index_and_special_bars(spark, d):
    m = panel.market(spark, d).where("close is not null")
    text, i = (lambda c: F.col(c).cast("string").alias(c)), F.col("inst")
    raw = m.select(F.when(i == 7, "sh.000300").otherwise(F.concat(F.lit("sh."), i.cast("string"))).alias("code"), F.col("dt").cast("string").alias("date"), *map(text, ("open", "high", "low", "close", "volume", "amount")), F.lit("1").alias("turn"), F.lit("0").alias("pctChg"), F.when(i != 7, F.when(F.col("t") % 5 == 0, "0").otherwise("1")).alias("tradestatus"), F.when(i != 7, F.when(i % 10 == 3, "1").otherwise("0")).alias("isST"))
    return canonical.canonical(raw).select("instrument", "dt", "is_suspended", "is_st")


@query("coverage_waterfall", f"WITH {SCORED} SELECT year(dt)::INT AS year, count(*) AS cells, count(*) FILTER (is_member) AS member, count(*) FILTER (is_member AND close > 0) AS traded, count(*) FILTER (is_member AND close > 0 AND score IS NOT NULL) AS scored, count(*) FILTER (is_member AND close > 0 AND score IS NOT NULL AND label IS NOT NULL) AS labelled FROM scored GROUP BY 1")
def coverage_waterfall(spark, d):
    masks = {"member": F.col("is_member"), "traded": F.col("close") > 0, "scored": F.col("score").isNotNull(), "labelled": F.col("label").isNotNull()}
    return evaluate.waterfall(scored(spark, d), masks, F.year("dt").alias("year"))


@query("member_unions", f"WITH {MARKET}, y AS (SELECT DISTINCT inst, year(dt)::INT AS year FROM market WHERE is_member) SELECT a.year, count(*) AS members, count(b.inst) AS stayed, count(*) - count(b.inst) AS left_next_year FROM y a LEFT JOIN y b ON a.inst = b.inst AND b.year = a.year + 1 GROUP BY a.year")
def member_unions(spark, d):
    """Everyone who was a member at any time of a year, and how many of them were at any time of the next."""
    return panel.yearly_unions(panel.market(spark, d))


@query("membership_changes", f"WITH {MARKET}, x AS (SELECT dt, inst, t, is_member, coalesce(lag(is_member) OVER (PARTITION BY inst ORDER BY t), false) AS was FROM market) SELECT dt, count(*) FILTER (is_member AND NOT was) AS entered, count(*) FILTER (was AND NOT is_member) AS left FROM x GROUP BY dt")
def membership_changes(spark, d):
    return panel.changes(panel.market(spark, d))


@query("ever_members", f"WITH {MARKET} SELECT inst FROM market GROUP BY inst HAVING bool_or(is_member AND close > 150)")
def ever_members(spark, d):
    return panel.ever(panel.market(spark, d), F.col("is_member") & (F.col("close") > 150))


@query("first_ids", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 3")
def first_ids(spark, d):
    return statements.first_by(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", 3)


@query("expression_identities", "SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS same_text, o_orderkey % 3 <> 2 AS same_meaning FROM orders WHERE o_orderkey % 50 = 0")
def expression_identities(spark, d):
    """Spaces change nothing, the order of a sum changes only the text, another window both; a hash of each, looked up by rows of data."""
    texts = {0: "Mean(close,5)+Log( volume )", 1: "Log(volume) + Mean(close, 5)", 2: "Mean(close, 6) + Log(volume)"}
    known = spark.createDataFrame([(k, dsl.identity(t), dsl.signature(t)) for k, t in texts.items()], "form int, identity string, signature string")
    whole = "Mean(close, 5) + Log(volume)"
    x = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3).cast("int").alias("form"))
    return x.join(known, "form").select("k", (F.col("identity") == dsl.identity(whole)).alias("same_text"), (F.col("signature") == dsl.signature(whole)).alias("same_meaning"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT o_orderkey, o_orderstatus, round(o_totalprice::FLOAT::DOUBLE, 4) AS price, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS note FROM orders")
def csv_round_trip(spark, d):
    """Written as CSV, read as text (an empty field stays empty) and by a typed schema (a float is the same float), and joined."""
    at = _folder(spark, "csv")
    out = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("float").alias("price"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("note"))
    files.write_csv(out, at)
    text = string_csv(spark, at, out.columns).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", "note")
    typed = files.typed_csv(spark, at, "k long, s string, price float, note string").select(F.col("k").alias("_k"), "price")
    return text.join(typed, F.col("o_orderkey") == F.col("_k")).select("o_orderkey", "o_orderstatus", F.round(F.col("price").cast("double"), 4).alias("price"), "note")


#: Records of a saved page.
PAGE = 10_000


@query("json_page_rows", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 7")
def json_page_rows(spark, d):
    """Events as saved response pages of at most PAGE records, some of them without a result, read and exploded; the records' fields come back from names and values."""
    at = _folder(spark, "pages")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    data = F.collect_list(F.struct(F.array(F.lit("user_id"), F.lit("event_type")).alias("fields"), F.array(F.col("user_id").cast("string"), F.col("event_type")).alias("values"), "event_id"))
    pages = e.groupBy((F.col("event_id") % 10).alias("page"), F.floor(F.col("event_id") / (10 * PAGE)).alias("part")).agg(data.alias("data")).select(F.when(F.col("page") != 7, F.struct(F.struct("data").alias("result"))).alias("body"))
    # A document to a file, written where it is: dealing them out by ranges would send the driver a sample, whole pages.
    pages.select(F.to_json(F.struct("body")).alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    rows = files.json_pages(spark, at, "fields: array<string>, values: array<string>, event_id: bigint", ["event_id"])
    m = files.records("fields", "values")
    return rows.select("event_id", m["user_id"].cast("long").alias("user_id"), m["event_type"].alias("event_type"))


@query("instrument_file", f"WITH {MARKET}, k AS (SELECT inst, dt, t - row_number() OVER (PARTITION BY inst ORDER BY t) AS island FROM market WHERE is_member) SELECT inst::VARCHAR AS inst, min(dt)::VARCHAR AS first, max(dt)::VARCHAR AS last FROM k GROUP BY inst, island")
def instrument_file(spark, d):
    at = _folder(spark, "instruments")
    files.write_instruments(panel.intervals(panel.market(spark, d)), at)
    return spark.read.schema("inst string, first string, last string").option("sep", "\t").csv(at)


@query("sealed_archive", "SELECT n_name AS title, n_nationkey % 3 = 0 AS archived FROM nation WHERE n_nationkey % 2 = 0 ORDER BY n_nationkey LIMIT 8")
def sealed_archive(spark, d):
    """An archive of text files, one in three of the index: titles and dates choose, missing files stay without content, and sums match what was written."""
    at = _folder(spark, "archive")
    n = table(spark, d, "nation")
    index = n.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Forecast "), "n_name")).otherwise(F.col("n_name")).alias("title"), F.date_add(F.lit("2015-01-01").cast("date"), F.col("n_nationkey").cast("int")).alias("date"), F.sha2(F.concat("n_name", F.lit("\n")), 256).alias("expected"))
    n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    # Spark names the files; the index takes their names by content.
    written = files.sealed(spark, at, "*.txt").withColumn("file", F.element_at(F.split("file", "/"), -1))
    index = index.join(written, F.col("expected") == F.col("sha256"), "left").select(F.coalesce("file", "name").alias("file"), "title", "date", "expected")
    found = files.documents(spark, at, index, "^Forecast", "2015-01-01", "2015-12-31", 8)
    return found.select(F.regexp_replace("title", "^Forecast ", "").alias("title"), F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)).alias("archived"))

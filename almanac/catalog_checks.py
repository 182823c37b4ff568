"""Queries for as-of and interval joins by slices, order statistics, regressions, resampling, audits and files, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.catalog import LEAST, MARKET, SCORED, query, r, scored
from almanac.catalog_more import _LONG, _RAW, _canonical, _features, _long, bootstrap_sql
from almanac.functions import dsl, fundamentals
from almanac.functions.cross import past
from almanac.operators import asof, audit, evaluate, order, statistics
from almanac.plans import panel
from almanac.sources import bars as binary
from almanac.sources.shared import shared_dir
from almanac.sources.tables import table

# One key has a third of all signals and events.
_HOT = "CASE WHEN {k} % 3 = 0 THEN 0 ELSE {c} END"
_HOT_SQL = f"""sig AS (SELECT l_orderkey AS k, l_linenumber AS n, {_HOT.format(k='l_orderkey', c='l_suppkey')} AS code, l_shipdate::DATE AS dt, count(*) AS m FROM lineitem GROUP BY ALL),
ev AS (SELECT {_HOT.format(k='o_orderkey', c='1 + o_custkey % 100')} AS code, o_orderdate::DATE AS at, max(o_totalprice) AS price FROM orders GROUP BY ALL)"""


def _hot(spark, d) -> tuple[DataFrame, DataFrame]:
    code = lambda k, c: F.when(F.col(k) % 3 == 0, 0).otherwise(c).cast("long").alias("code")
    signals = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), code("l_orderkey", F.col("l_suppkey")), F.to_date("l_shipdate").alias("dt")).agg(F.count("*").alias("m"))
    events = table(spark, d, "orders").groupBy(code("o_orderkey", 1 + F.col("o_custkey") % 100), F.to_date("o_orderdate").alias("at")).agg(F.max("o_totalprice").alias("price"))
    return signals, events


@query("asof_hot_strict", f"WITH {_HOT_SQL} SELECT s.k, s.n, s.code, s.dt, s.m, CASE WHEN s.dt - e.at <= 20 THEN e.at END AS at, CASE WHEN s.dt - e.at <= 20 THEN e.price END AS price FROM sig s ASOF LEFT JOIN ev e ON s.code = e.code AND s.dt > e.at")
def asof_hot_strict(spark, d):
    """Slices of ten days."""
    signals, events = _hot(spark, d)
    return asof.asof(signals, events.withColumnRenamed("at", "day"), "code", "dt", "day", ["price"], max_age=20, width=10)


@query("asof_hot_inclusive", f"WITH {_HOT_SQL} SELECT s.k, s.n, s.code, s.dt, s.m, e.at, e.price FROM sig s ASOF LEFT JOIN ev e ON s.code = e.code AND s.dt >= e.at")
def asof_hot_inclusive(spark, d):
    signals, events = _hot(spark, d)
    return asof.asof(signals, events.withColumnRenamed("at", "day"), "code", "dt", "day", ["price"], strict=False, width=30)


# Many intervals to a key: a shipment is under way for as many days as its quantity.
_SPANS_SQL = "sp AS (SELECT l_suppkey AS inst, l_orderkey AS k, l_shipdate::DATE AS start_dt, l_shipdate::DATE + l_quantity::INT AS end_dt, l_linenumber AS n FROM lineitem WHERE l_orderkey % 4 = {part})"


def _spans(spark, d, part: int) -> DataFrame:
    day = F.to_date("l_shipdate")
    return table(spark, d, "lineitem").where(F.col("l_orderkey") % 4 == part).select(F.col("l_suppkey").alias("inst"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), day.alias("start_dt"), F.date_add(day, F.col("l_quantity").cast("int")).alias("end_dt"))


@query("interval_containing", f"WITH {_SPANS_SQL.format(part=1)}, o AS (SELECT o_orderkey AS ok, 1 + o_custkey % 100 AS inst, o_orderdate::DATE AS dt FROM orders) SELECT o.ok, o.inst, o.dt, count(*) AS n, min(sp.k) AS least, sum(sp.end_dt - o.dt)::BIGINT AS days FROM o JOIN sp ON o.inst = sp.inst AND o.dt BETWEEN sp.start_dt AND sp.end_dt GROUP BY ALL")
def interval_containing(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ok"), (1 + F.col("o_custkey") % 100).alias("inst"), F.to_date("o_orderdate").alias("dt"))
    pairs = asof.containing(o, _spans(spark, d, 1).select("inst", "k", "start_dt", "end_dt"), "inst", "dt", 16)
    return pairs.groupBy("ok", "inst", "dt").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.sum(F.datediff("end_dt", "dt")).alias("days"))


@query("interval_semi_join", f"WITH {_SPANS_SQL.format(part=1)} SELECT o_orderkey AS ok, 1 + o_custkey % 100 AS inst, o_orderdate::DATE AS dt FROM orders o WHERE EXISTS (SELECT 1 FROM sp WHERE sp.inst = 1 + o.o_custkey % 100 AND o.o_orderdate::DATE BETWEEN sp.start_dt AND sp.end_dt)")
def interval_semi_join(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ok"), (1 + F.col("o_custkey") % 100).alias("inst"), F.to_date("o_orderdate").alias("dt"))
    return asof.within(o, _spans(spark, d, 1), "inst", "dt", 16)


@query("interval_overlaps", f"WITH {_SPANS_SQL.format(part=1)}, sq AS (SELECT l_suppkey AS inst, l_orderkey AS k, l_linenumber AS n, l_shipdate::DATE AS start_dt, l_shipdate::DATE + l_quantity::INT AS end_dt FROM lineitem WHERE l_orderkey % 4 = 2) SELECT a.inst, a.n, b.n AS other_n, count(*) AS pairs, sum(least(a.end_dt, b.end_dt) - greatest(a.start_dt, b.start_dt) + 1)::BIGINT AS shared_days FROM sp a JOIN sq b ON a.inst = b.inst AND a.start_dt <= b.end_dt AND b.start_dt <= a.end_dt GROUP BY ALL")
def interval_overlaps(spark, d):
    pairs = asof.overlapping_pairs(_spans(spark, d, 1), _spans(spark, d, 2), "inst", 16)
    shared = F.datediff(F.least("end_dt", "other_end_dt"), F.greatest("start_dt", "other_start_dt")) + 1
    return pairs.groupBy("inst", "n", "other_n").agg(F.count("*").alias("pairs"), F.sum(shared).alias("shared_days"))


@query("intervals_in_window", f"WITH {_SPANS_SQL.format(part=3)} SELECT inst, k, n, start_dt, end_dt FROM sp WHERE start_dt <= DATE '1997-06-30' AND end_dt >= DATE '1997-06-01'")
def intervals_in_window(spark, d):
    return asof.overlapping(_spans(spark, d, 3), "1997-06-01", "1997-06-30").select("inst", "k", "n", "start_dt", "end_dt")


@query("exact_quantiles", "WITH x AS (SELECT l_returnflag AS flag, CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN 1.5 WHEN l_orderkey % 11 = 0 THEN -l_extendedprice ELSE l_extendedprice / 1000 END AS v FROM lineitem) SELECT flag, count(v) AS n, " + ", ".join(f"round(quantile_cont(v, {p}), 9) + 0.0 AS q{i}" for i, p in enumerate((0, 0.01, 0.25, 0.5, 0.99, 1))) + " FROM x GROUP BY flag")
def exact_quantiles(spark, d):
    """Three groups over all rows, with heavy ties and both signs."""
    k, price = F.col("l_orderkey"), F.col("l_extendedprice")
    v = F.when(k % 5 == 0, None).when(k % 7 == 0, 1.5).when(k % 11 == 0, -price).otherwise(price / 1000)
    out = order.quantiles(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), v.alias("v")), ["flag"], "v", [0, 0.01, 0.25, 0.5, 0.99, 1])
    return out.select("flag", "n", *(r(F.col("q")[i], 9).alias(f"q{i}") for i in range(6)))


@query("winsor_bounds", f"WITH {MARKET}, m AS (SELECT dt, close / lag(close, 3) OVER (PARTITION BY inst ORDER BY t) - 1 AS mom FROM market) SELECT dt, count(mom) AS n, round(quantile_cont(mom, 0.01), 6) + 0.0 AS lo, round(quantile_cont(mom, 0.99), 6) + 0.0 AS hi FROM m WHERE mom IS NOT NULL GROUP BY dt")
def winsor_bounds(spark, d):
    m = dsl.evaluate(panel.market(spark, d), {"mom": "close / Ref(close, 3) - 1"})
    return order.quantiles(m, ["dt"], "mom", [0.01, 0.99]).select("dt", "n", r(F.col("q")[0]).alias("lo"), r(F.col("q")[1]).alias("hi"))


@query("publication_ages", "WITH x AS (SELECT o_orderdate::DATE - (SELECT min(o_orderdate::DATE) FROM orders) AS age, o_orderpriority AS p FROM orders) SELECT p, count(*) AS n, quantile_cont(age::DOUBLE, 0.5) AS median, round(quantile_cont(age::DOUBLE, 0.95), 6) AS p95, max(age)::DOUBLE AS most FROM x GROUP BY p")
def publication_ages(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("p"))
    ages = o.withColumn("age", F.datediff("day", o.agg(F.min("day")).scalar()))
    out = order.quantiles(ages, ["p"], "age", [0.5, 0.95, 1.0])
    return out.select("p", "n", F.col("q")[0].alias("median"), F.round(F.col("q")[1], 6).alias("p95"), F.col("q")[2].alias("most"))


@query("evenly_spaced", "WITH x AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders), k AS (SELECT unnest(range(38)) AS sample) SELECT sample::BIGINT AS sample, o_orderkey, o_totalprice FROM k JOIN x ON p = round_even(sample * (n - 1) / 37.0, 0)")
def evenly_spaced(spark, d):
    return order.evenly_spaced(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 38).select("sample", "o_orderkey", "o_totalprice")


@query("global_positions", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS position FROM events")
def global_positions(spark, d):
    return order.positions(table(spark, d, "events").select("event_id", "value"), ["value", "event_id"]).select("event_id", "position")


_AUDIT_CUTS = (12, 40)


@query(
    "causality_audit",
    f"WITH {MARKET}, c AS (SELECT unnest([{', '.join(map(str, _AUDIT_CUTS))}])::INT AS cut), f AS (SELECT dt, t, inst, lead(close) OVER i AS peek, avg(close) OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS centred FROM market WINDOW i AS (PARTITION BY inst ORDER BY t)), "
    "p AS (SELECT c.cut, m.dt, m.t, m.inst, lead(m.close) OVER w AS peek, avg(m.close) OVER (PARTITION BY c.cut, m.inst ORDER BY m.t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS centred FROM market m JOIN c ON m.t <= c.cut WINDOW w AS (PARTITION BY c.cut, m.inst ORDER BY m.t)), "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", cut, p.dt, p.inst FROM p JOIN f ON f.inst = p.inst AND f.t = p.t WHERE f.{c} IS DISTINCT FROM p.{c} AND NOT coalesce(abs(f.{c} - p.{c}) <= 1e-9 * greatest(1, abs(f.{c}), abs(p.{c})), false)" for c in ("peek", "centred")).replace("SELECT 'peek'", "u AS (SELECT 'peek'", 1)
    + ') SELECT "column", cut, max(dt) AS dt, count(*) AS n FROM u GROUP BY ALL',
)
def causality_audit(spark, d):
    """Three columns that look back, two that look ahead: only these are found, at the cut's own date."""

    def plan(p: DataFrame) -> DataFrame:
        p = dsl.evaluate(p, {"mom": "close / Ref(close, 3) - 1", "rank": "Rank(volume)", "vol": "Std(returns, 6)"})
        near = past().rowsBetween(-1, 1)
        return p.withColumn("peek", F.lead("close").over(past())).withColumn("centred", F.avg("close").over(near))

    found = audit.causality(panel.market(spark, d), plan, ["mom", "rank", "vol", "peek", "centred"], list(_AUDIT_CUTS), 1e-9)
    return found.groupBy("column", "cut").agg(F.max("dt").alias("dt"), F.count("*").alias("n"))


def _planted(bars: DataFrame) -> DataFrame:
    """Bars as a faulty store would have them: some closes changed, some bars lost, some dated a year late."""
    n = F.substring("instrument", 3, 9).cast("long") + F.year("dt") * 12 + F.month("dt")
    return bars.where(n % 97 != 5).withColumn("close", F.when(n % 89 == 7, F.col("close") * 1.01).otherwise(F.col("close"))).withColumn("volume", F.when(n % 83 == 11, None).otherwise(F.col("volume"))).withColumn("dt", F.when(n % 101 == 3, F.add_months("dt", 1200)).otherwise(F.col("dt")))


@query(
    "replay_audit",
    f"WITH {_RAW}, x AS (SELECT 'SH' || inst AS instrument, dt, close, volume, inst + year(dt) * 12 + month(dt) AS n FROM canon) SELECT instrument, CASE WHEN k = 'unexpected' THEN (dt + INTERVAL 1200 MONTH)::DATE ELSE dt END AS dt, k AS difference, changed FROM (SELECT instrument, dt, unnest(CASE WHEN n % 97 = 5 THEN ['missing'] WHEN n % 101 = 3 THEN ['missing', 'unexpected'] WHEN (n % 89 = 7 AND close IS NOT NULL) OR (n % 83 = 11 AND volume IS NOT NULL) THEN ['changed'] ELSE [] END) AS k, "
    "concat_ws(',', CASE WHEN n % 97 <> 5 AND n % 101 <> 3 AND n % 89 = 7 THEN 'close' END, CASE WHEN n % 97 <> 5 AND n % 101 <> 3 AND n % 83 = 11 THEN 'volume' END) AS changed FROM x)",
)
def replay_audit(spark, d):
    """Raw bars are made canonical again and held against a faulty copy; every planted fault is found, and nothing else."""
    good = _canonical(spark, d)
    columns = [c for c in good.columns if c not in ("instrument", "dt")]
    out = audit.differences(good, _planted(good), ["instrument", "dt"], columns, 256)
    return out.select("instrument", "dt", "difference", F.array_join("changed", ",").alias("changed"))


@query("replay_of_equal_bars", "SELECT NULL::VARCHAR AS instrument, NULL::DATE AS dt, NULL::VARCHAR AS difference WHERE false")
def replay_of_equal_bars(spark, d):
    """The same bars, dealt out in another order: nothing differs."""
    good = _canonical(spark, d)
    return audit.differences(good, good.repartition(5, "close"), ["instrument", "dt"], [c for c in good.columns if c not in ("instrument", "dt")]).select("instrument", "dt", "difference")


# Least squares from sums of products: a score on one basis column, size and industries.
_RES_SQL = f"""{MARKET}, f AS (SELECT dt, inst, close / lag(close, 3) OVER i - 1 AS mom, -(close / lag(close, 5) OVER i - 1) AS rev, CASE WHEN amount > 0 THEN ln(amount) END AS size FROM market WINDOW i AS (PARTITION BY inst ORDER BY t)),
a AS (SELECT f.*, s_nationkey % 4 AS g FROM f JOIN supplier ON s_suppkey = inst WHERE mom IS NOT NULL AND rev IS NOT NULL AND size IS NOT NULL),
b AS (SELECT *, count(*) OVER (PARTITION BY dt, g) AS k FROM a), c AS (SELECT *, mom - avg(mom) OVER w AS y, rev - avg(rev) OVER w AS x, size - avg(size) OVER w AS z FROM b WHERE k >= 5 WINDOW w AS (PARTITION BY dt, g)),
e AS (SELECT dt, count(*) AS n, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, 2 + count(DISTINCT g) AS cols FROM c GROUP BY dt HAVING count(*) >= greatest(30, 2 * (2 + count(DISTINCT g))) AND stddev_samp(size) > 1e-12),
h AS (SELECT c.*, e.n, cols, y - (xy * zz - zy * xz) / (xx * zz - xz * xz) * x - (zy * xx - xy * xz) / (xx * zz - xz * xz) * z AS r FROM c JOIN e USING (dt))"""


def _residual_input(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("inst"), (F.col("s_nationkey") % 4).cast("string").alias("industry"))
    return _features(spark, d).join(s, "inst").withColumn("size", fundamentals.positive_log(F.col("amount")))


@query("conditional_residual", f"WITH {_RES_SQL} SELECT dt, inst, round(mom, 6) + 0.0 AS matched, round(r / stddev_pop(r) OVER (PARTITION BY dt), 6) + 0.0 AS residual FROM h")
def conditional_residual(spark, d):
    out = statistics.conditional_residual(_residual_input(spark, d), "mom", ["rev"], "size", "industry", least=30)
    return out.select("dt", "inst", r("matched"), r("residual"))


@query("conditional_checks", f"WITH {_RES_SQL} SELECT dt, count(*) AS n, any_value(cols)::INT AS columns, round(1 - var_pop(r) / var_pop(mom), 6) + 0.0 AS explained, true AS orthogonal FROM h GROUP BY dt")
def conditional_checks(spark, d):
    out = statistics.conditional_checks(_residual_input(spark, d), "mom", ["rev"], "size", "industry", least=30)
    return out.select("dt", "n", "columns", r("explained"), (F.col("orthogonality_error") < 1e-9).alias("orthogonal"))


@query("neutralize_checks", f"WITH {SCORED}, b AS (SELECT s.dt, n.n_regionkey AS g, s.amount FROM scored s JOIN supplier u ON u.s_suppkey = s.inst JOIN nation n ON n.n_nationkey = u.s_nationkey WHERE s.score IS NOT NULL AND s.amount > 0), c AS (SELECT *, count(*) OVER (PARTITION BY dt, g) AS k FROM b) SELECT dt, count(*) AS n, true AS orthogonal FROM c WHERE k >= 5 GROUP BY dt HAVING count(*) >= 30 AND stddev_samp(ln(amount)) > 0 AND count(*) > count(DISTINCT g) + 6")
def neutralize_checks(spark, d):
    home = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("inst"), F.col("n_regionkey").alias("g"))
    x = evaluate.neutralize(scored(spark, d).join(home, "inst").withColumn("size", F.when(F.col("amount") > 0, F.ln("amount"))), "score", "size", "g")
    return statistics.orthogonality(x, "neutral", ["size"], "g").select("dt", "n", (F.col("orthogonality_error") < 1e-9).alias("orthogonal"))


@query("block_bootstrap", f"WITH {_LONG}, sr AS (SELECT factor, dt, rank_ic AS x FROM daily), {bootstrap_sql('sr', 6, 500, 42)} SELECT factor, n, round(mean, 6) + 0.0 AS mean, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(p, 9) AS p FROM bs")
def block_bootstrap(spark, d):
    daily = evaluate.daily_ic(_long(spark, d), by=("factor", "dt"), least=LEAST)
    out = statistics.bootstrap(daily, "rank_ic", ["factor"], block=6, samples=500)
    return out.select("factor", "n", r("mean"), r("low"), r("high"), F.round("p", 9).alias("p"))


@query(
    "binary_bars",
    f"WITH {_RAW}, b AS (SELECT c.inst, market.t, c.close, c.factor, c.is_suspended, c.open, c.amount, c.volume FROM canon c JOIN market ON market.inst = c.inst AND market.dt = c.dt), "
    "sc AS (SELECT inst, min(t) AS a, max(t) AS z, arg_min(close * factor, t) FILTER (NOT is_suspended) AS scale FROM b GROUP BY inst), g AS (SELECT inst, scale, unnest(range(a, z + 1)) AS t FROM sc), "
    "x AS (SELECT g.inst, g.t, factor / scale AS f, NOT coalesce(is_suspended, true) AS act, open, close, amount, volume FROM g LEFT JOIN b USING (inst, t)) "
    "SELECT 'SH' || inst AS instrument, 'close' AS field, t::INT AS t, CASE WHEN act THEN close * f END::FLOAT AS value FROM x UNION ALL SELECT 'SH' || inst, 'vwap', t::INT, CASE WHEN act THEN amount / nullif(volume, 0) * f END::FLOAT FROM x UNION ALL SELECT 'SH' || inst, 'blocked', t::INT, CASE WHEN act THEN 0 ELSE 1 END::FLOAT FROM x",
)
def binary_bars(spark, d):
    """Canonical bars through the binary sink and back."""
    days = panel.market(spark, d).select(F.concat(F.lit("SH"), F.col("inst").cast("string")).alias("instrument"), "dt", "t")
    bars = _canonical(spark, d).join(days, ["instrument", "dt"])
    at = f"{shared_dir(spark).removeprefix('file:')}/bars-{uuid.uuid4().hex}"
    binary.write_bars(binary.export_fields(bars), at, ["close", "vwap", "blocked"])
    return binary.read_bars(spark, at)

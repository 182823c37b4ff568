"""As-of and interval joins, order statistics, audits, binary bars, ledgers and the stream on small fixtures against brute force."""

import bisect
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.functions import fundamentals
from almanac.functions.cross import quotient
from almanac.operators import asof, audit, decide, evaluate, ledger, order
from almanac.plans import canonical
from almanac.sources import bars

DAY0 = dt.date(2020, 1, 1)
day = lambda n: DAY0 + dt.timedelta(n)


@pytest.mark.parametrize(("strict", "age", "width"), [(True, None, 5), (False, None, 7), (True, 12, 3), (False, 30, 400)])
def test_asof_of_a_hot_key(spark, strict, age, width):
    r = random.Random(width)
    events = [("hot" if i % 2 else f"k{i % 7}", day(r.randrange(-50, 200)), r.choice([None, i])) for i in range(300)] + [(None, day(3), 1), ("hot", None, 2)]
    signals = [(i, "hot" if i % 3 else f"k{i % 9}", day(r.randrange(-80, 400)), i, i) for i in range(300)] + [(900, None, day(5), 0, 0), (901, "hot", None, 0, 0)]
    got = asof.asof(spark.createDataFrame(signals, "id int, k string, d date, _c int, at0 int"), spark.createDataFrame(events, "k string, e date, v int"), "k", "d", "e", ["v"], strict, age, width).collect()
    assert sorted(x.id for x in got) == sorted(s[0] for s in signals)
    for x in got:
        known = [(e, -1 if v is None else v) for k, e, v in events if k is not None and k == x.k and e is not None and x.d is not None and (e < x.d if strict else e <= x.d)]
        best = max(known, default=None)
        want = (None, None) if best is None or (age is not None and (x.d - best[0]).days > age) else (best[0], None if best[1] == -1 else best[1])
        assert (x["at"], x["v"]) == want


def test_current_periods_by_slices_and_their_refusal(spark):
    r = random.Random(2)
    rows = sorted({(f"k{r.randrange(3)}", day(p := r.randrange(900)), day(p - r.randrange(1, 500)), i) for i in range(200)})
    got = {x.i for x in asof.current_periods(spark.createDataFrame(rows, "k string, p date, s date, i int"), "k", "p", "s", "i", width=20).collect()}
    want = set()
    for k in {x[0] for x in rows}:
        newest = dt.date.min
        for p in sorted({x[1] for x in rows if x[0] == k}):
            _, s, i = max((x[1], x[2], x[3]) for x in rows if x[0] == k and x[1] == p)
            if s >= newest:
                newest, want = s, want | {i}
    assert got == want
    twice = spark.createDataFrame([("a", day(5), day(1), 1), ("a", day(5), day(1), 2), ("b", day(1), day(5), 3)], "k string, p date, s date, i int")
    assert sorted(x.reason for x in asof.repeated_periods(twice, "k", "p", "s").collect()) == ["duplicate_period", "period_after_publication"]
    with pytest.raises(Exception, match="ambiguous or impossible fiscal period"):
        asof.current_periods(twice, "k", "p", "s").collect()


def test_interval_joins(spark):
    r = random.Random(3)
    spans = lambda n: [(r.choice("ab"), i, day(s := r.randrange(200)), day(s + r.randrange(-2, 60))) for i in range(n)]
    left, right = spans(80), spans(70) + [("a", 99, None, day(3)), ("a", 98, day(3), None)]
    a, b = (spark.createDataFrame(x, "k string, i int, start_dt date, end_dt date") for x in (left, right))
    points = [("abc"[i % 3], i, day(r.randrange(260))) for i in range(120)]
    p = spark.createDataFrame(points, "k string, p int, at date")
    sound = [x for x in right if x[2] and x[3] and x[2] <= x[3]]
    for width in (1, 7, 1000):
        got = sorted((x.p, x.i) for x in asof.containing(p, b, "k", "at", width).collect())
        assert got == sorted((j, i) for k, j, at in points for h, i, s, e in sound if k == h and s <= at <= e)
        assert sorted(x.p for x in asof.within(p, b, "k", "at", width).collect()) == sorted({j for j, _ in got})
        pairs = sorted((x.i, x.other_i) for x in asof.overlapping_pairs(a, b, "k", width).collect())
        assert pairs == sorted((i, j) for k, i, s, e in left for h, j, t, f in sound if k == h and s <= e and s <= f and t <= e)


def test_quantiles_of_odd_values(spark):
    r = np.random.default_rng(6)
    groups = {
        "wide": np.concatenate([10.0 ** r.uniform(-300, 300, 200), -(10.0 ** r.uniform(-300, 300, 200))]), "near": 100 + r.normal(size=300) * 1e-9, "ties": np.repeat([1.5, 2.5, -0.0, 0.0], 50),
        "one": np.array([3.0]), "tiny": np.array([5e-324, -5e-324, 0.0]), "heavy": np.concatenate([np.full(500, 7.0), r.normal(size=100)]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(g, x) for g in groups for x in (None, float("nan"), float("inf"))] + [(None, 1.0), (None, 2.0), ("none", None)]
    probabilities = [0.0, 0.01, 0.3, 0.5, 0.999, 1.0]
    got = {x.g: x for x in order.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", probabilities).collect()}
    assert set(got) == {*groups, None} and got[None].q == pytest.approx(np.quantile([1, 2], probabilities))
    for g, vs in groups.items():
        assert got[g].n == len(vs) and got[g].q == pytest.approx(np.quantile(vs, probabilities).tolist(), rel=1e-12, abs=0 if g != "tiny" else 1e-320)
    with pytest.raises(ValueError):
        order.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [1.5])


def test_positions_and_even_samples(spark):
    r = random.Random(8)
    values = [(r.randrange(5), i, "x") for i in range(500)]
    df = spark.createDataFrame(values, "v int, id int, position string").repartition(9).drop("position")
    assert [(x.v, x.id) for x in sorted(order.positions(df, ["v", "id"]).collect(), key=lambda x: x.position)] == sorted((v, i) for v, i, _ in values)
    line = sorted((v, i) for v, i, _ in values)
    for k in (1, 7, 500, 900):
        want = [line[round(i * 499 / max(1, k - 1))] for i in range(k)]
        assert [(x.v, x.id) for x in order.evenly_spaced(df, ["v", "id"], k).orderBy("sample").collect()] == want
    assert order.evenly_spaced(df.limit(0), ["v", "id"], 3).collect() == [] and order.positions(df.limit(0), ["v"]).collect() == []


def test_differences(spark):
    rows = [(i, i % 3, float(i), None if i % 5 == 0 else "s") for i in range(200)]
    a = spark.createDataFrame(rows, "k int, j int, x double, s string")
    assert audit.differing_buckets(a, a.repartition(3), ["k"], ["j", "x", "s"]) == []
    b = [x for x in rows if x[0] != 7] + [(1000, 1, 1.0, "n"), rows[9]]
    b[20] = (b[20][0], b[20][1], -1.0, "t")
    got = audit.differences(a, spark.createDataFrame(b, "k int, j int, x double, s string"), ["k"], ["j", "x", "s"], 16).collect()
    assert sorted((x.k, x.difference, x.changed) for x in got) == [(7, "missing", []), (9, "repeated", []), (21, "changed", ["x", "s"]), (1000, "unexpected", [])]
    swapped = spark.createDataFrame([(1, None, 2.0, "a"), (2, 2, 2.0, None)], a.schema)
    other = spark.createDataFrame([(1, 2, 2.0, "a"), (2, None, 2.0, None)], a.schema)
    assert audit.differences(swapped, other, ["k"], ["j", "x", "s"]).count() == 2
    assert audit.differences(a.limit(0), a.limit(0), ["k"], ["x"]).count() == 0 and audit.differences(a, a.limit(0), ["k"], ["x"]).count() == 200


def test_causality(spark):
    from pyspark.sql import Window as W

    rows = [(f"i{i}", day(t), t, float((i * 7 + t * 3) % 11)) for i in range(5) for t in range(1, 21)]
    panel = spark.createDataFrame(rows, "inst string, dt date, t int, x double")
    line, date = W.partitionBy("inst").orderBy("t"), W.partitionBy("dt")
    plan = lambda p: p.withColumn("back", F.lag("x").over(line)).withColumn("rank", F.rank().over(date.orderBy("x"))).withColumn("whole", F.avg("x").over(W.partitionBy("inst")))
    got = audit.causality(panel, plan, ["back", "rank", "whole"], [5, 20]).collect()
    assert {(x.column, x.cut) for x in got} == {("whole", 5)} and {x.t for x in got} <= {1, 2, 3, 4, 5}


def test_binary_bars(spark, tmp_path):
    rows = [("SH1", t, float(t) if t != 12 else None, 2.0) for t in range(10, 15)] + [("SZ2", 3, 1.25, None)]
    df = spark.createDataFrame(rows, "instrument string, t int, close double, open double")
    at = str(tmp_path / "bars")
    bars.write_bars(df, at, ["close", "open"])
    got = {(x.instrument, x.field, x.t): x.value for x in bars.read_bars(spark, at).collect()}
    assert got == {(i, f, t): v for i, t, c, o in rows for f, v in (("close", c), ("open", o))}
    assert np.fromfile(f"{at}/features/sh1/close.day.bin", "<f4")[:2].tolist() == [10.0, 10.0]
    with pytest.raises(Exception, match="has files already"):
        bars.write_bars(df, at, ["close", "open"])
    with pytest.raises(Exception, match="gap"):
        bars.write_bars(df.where("t <> 13"), str(tmp_path / "gap"), ["close"])
    bars.write_bars(df.withColumn("close", F.lit(9.0)), at, ["close"], overwrite=True)
    assert {x.value for x in bars.read_bars(spark, at).where("field = 'close'").collect()} == {9.0}
    assert not [p for p in tmp_path.rglob(".*") if p.name.endswith(".bin") or "-" in p.name and not p.name.endswith(".crc")]


def test_serials_follow_the_text_of_values(spark):
    rows = [(1, 9.0, "a", "OK"), (1, 10.0, "b", "OK"), (1, 1e7, "c", "OK"), (1, None, "d", "OK"), (1, -0.5, "e", "OK"), (1, 123456789.25, "f", "OK"), (2, 5.0, "y", "OK"), (2, 5.0, "x", "QUARANTINED_Z")]
    got = ledger.merge_typed(spark.createDataFrame(rows, "k int, v double, id string, data_status string"), ["k"], ["v"], "id").collect()
    mine = [x.ids[0] for x in sorted(got, key=lambda x: x.serial) if x.k == 1]
    assert mine == [i for _, i in sorted((str((v,)), i) for k, v, i, _ in rows if k == 1)]
    assert {x.data_status for x in got if x.k == 1} == {"QUARANTINED_SAME_DATE_VALUES"} and [(x.ids, x.data_status) for x in got if x.k == 2] == [(["x", "y"], "QUARANTINED_Z")]


def test_a_null_divisor_gives_null(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (6.0, 3.0)], "a double, b double")
    assert [x[0] for x in df.select(quotient(F.col("a"), F.col("b"))).collect()] == [None, float("inf"), float("-inf"), None, None, 2.0]


def test_refusals_act(spark):
    names = spark.createDataFrame([("a", "FORWARD", True), ("b", "FORWARD", False)], "name string, status string, passed boolean")
    with pytest.raises(Exception, match="differs from its metrics"):
        decide.survivors(names, names.select("name", "passed"), "name").collect()
    with pytest.raises(Exception, match="unrecognized industry label"):
        spark.createDataFrame([("nonsense",)], "x string").select(fundamentals.industry_key(F.col("x"))).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        canonical.numeric(spark.createDataFrame([("abc",)], "close string")).select("close").collect()
    with pytest.raises(ValueError):
        evaluate.forward_labels(names, 0)


def test_family_padding(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04)], "n string, p double")
    assert {x.n: x.q for x in evaluate.bh_adjust(df, "p", family=10).collect()} == pytest.approx({"a": 0.1, "b": 0.2})
    with_ones = df.union(spark.createDataFrame([(f"x{i}", 1.0) for i in range(8)], "n string, p double"))
    assert {x.n: x.q for x in evaluate.bh_adjust(with_ones, "p").collect() if x.n in "ab"} == pytest.approx({"a": 0.1, "b": 0.2})


def test_ledger_accounts_for_every_row(spark):
    """Conservation on the standard tables: each document, recorded document and vendor row is in its table once."""
    from almanac.catalog_ledger import _ledger

    book = _ledger(spark, "/root/testdata/sf0.001")
    documents = book.dispositions.count()
    assert documents == book.dispositions.select("document").distinct().count() > 0
    recorded = book.dispositions.where("status like 'REVIEWED%' or status = 'QUARANTINED_PRIMARY_FACTS'").select("document")
    in_events = book.events.select(F.explode("ids").alias("document"))
    assert sorted(x[0] for x in recorded.collect()) == sorted(x[0] for x in in_events.collect())
    assert book.vendor.count() == book.vendor.select("row").distinct().count()
    assert book.events.where("available <= notice_date").count() == 0


def test_stream_in_any_arrival_order(spark, tmp_path):
    """Late periods, a null value, two events of one day, expiry by either age; three batches, shuffled within the allowed lateness."""
    from almanac.streaming import fiscal

    r = random.Random(9)
    rows = [(k, day(p := r.randrange(1200)), day(p - r.choice([30, 100, 300, 600])), i, None if i % 6 == 0 else float(i)) for i in range(60) for k in [r.randrange(3)]]
    rows += [(rows[4][0], rows[4][1], rows[4][2], 99, 99.0)]
    batch = [(p - DAY0).days + r.randrange(90) for _, p, *_ in rows]
    df = spark.createDataFrame([(*x, min(2, b // 430)) for x, b in zip(rows, batch, strict=True)] + [(-1, day(9000), day(9000), 0, None, 3)], "k int, p date, s date, o int, v double, b int")
    fiscal.batches(df, F.col("b"), str(tmp_path / "in"), 4)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = fiscal.validity(stream, "k", "p", "s", "o", "v", "100 days")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    for k in range(3):
        mine, line, newest = [x for x in rows if x[0] == k], [], dt.date.min
        for p in sorted({x[1] for x in mine}):
            s, _, v = max((x[2], x[3], x[4]) for x in mine if x[1] == p)
            if s >= newest:
                newest = s
                line.append((p, s, v))
        starts = [x[0] for x in line]
        for d in range(0, 1900, 3):
            at = bisect.bisect_left(starts, day(d)) - 1
            e = line[at] if at >= 0 else None
            want = e if e and (day(d) - e[0]).days <= 400 and (day(d) - e[1]).days <= 550 else None
            found = [x for x in got if x.key == k and x.start_dt <= day(d) <= x.end_dt]
            assert [(x.pub, x.stat, x.value) for x in found] == ([] if want is None else [want])


def test_stream_reads_its_state_once_for_many_keys():
    """A call handles a group of keys with one reading, one writing and one timer, however many keys and days it has."""
    import pandas as pd

    from almanac.streaming import fiscal

    calls, held = [], {}

    class State:
        get = lambda self: calls.append("get") or held.get(0)
        update = lambda self, value: calls.append("update") or held.update({0: value})

    class Handle:
        getMapState = getValueState = lambda self, *a: State()
        registerTimer = lambda self, ms: calls.append(ms // fiscal.DAY_MS)

    class Watermark:
        getCurrentWatermarkInMs = lambda self: 51 * fiscal.DAY_MS

    p = fiscal.Precedence()
    p.init(Handle())
    rows = pd.DataFrame([(k, 10 + 30 * n, 10 * n, n, float(n)) for k in range(50) for n in range(3)], columns=["key", "day", "stat", "ord", "value"])
    assert list(p.handleInputRows((0,), iter([rows, rows]), None)) == []
    assert calls == ["get", 11, "update"]
    calls.clear()
    (out,) = p.handleExpiredTimer((0,), Watermark(), None)
    # Of each key the first value ended at the second's day; the third day waits.
    assert out.values.tolist() == [[k, 10, 0, 0.0, 11, 40] for k in range(50)]
    assert calls == ["get", 71, "update"]


def test_sliced_intervals_are_not_sent_through_the_driver(spark, tmp_path):
    """A few long intervals are many slices, whatever their size seems to be before they are cut."""
    spark.createDataFrame([(k, day(0), day(1999)) for k in range(3)], "k int, start_dt date, end_dt date").write.parquet(str(tmp_path / "spans"))
    spans = spark.read.parquet(str(tmp_path / "spans"))
    at = spark.createDataFrame([(k, day(p)) for k in range(4) for p in (0, 700, 1999, 2000)], "k int, at date")
    got = asof.within(at, spans, "k", "at")
    pairs = asof.containing(at, spans, "k", "at")
    for df in (got, pairs, asof.overlapping_pairs(spans, spans, "k")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(k, day(p)) for k in range(3) for p in (0, 700, 1999)] and pairs.count() == 9

"""Hand values of single operators, and no look-ahead."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.functions import dsl
from almanac.operators import asof, evaluate, events
from almanac.plans import panel
from almanac.sources import files

DAY = dt.date(2020, 1, 1)


def days(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


def frame(spark, values, field="close"):
    return spark.createDataFrame([(d, i + 1, 1, v) for i, (d, v) in enumerate(zip(days(len(values)), values, strict=True))], f"dt date, t int, inst long, {field} double")


def values(df, name):
    return [r[0] for r in df.orderBy("dt").select(name).collect()]


def test_ref_counts_calendar_positions(spark):
    out = dsl.evaluate(frame(spark, [1.0, 2.0, 4.0, 8.0, 16.0]), {"x": "close / Ref(close, 2) - 1"})
    assert values(out, "x") == [None, None, 3.0, 3.0, 3.0]


def test_windows_want_every_value_and_zero_divides_to_null(spark):
    out = dsl.evaluate(frame(spark, [1.0, None, 3.0, 0.0, 5.0]), {"m": "Mean(close, 3)", "d": "5 / close"})
    assert values(out, "m") == [None, None, None, None, pytest.approx(8 / 3)]
    assert values(out, "d") == [5.0, None, pytest.approx(5 / 3), None, 1.0]


@pytest.mark.parametrize("expression", ["Mean(close, 3)", "Std(close, 2)", "TsRank(close, 3)", "Delta(close, 1) / Max(close, 4)", "Rank(close)"])
def test_the_future_does_not_change_the_past(spark, expression):
    a, b = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0], [3.0, 1.0, 4.0, 1.0, -7.0, 0.5]
    x, y = (values(dsl.evaluate(frame(spark, v), {"x": expression}), "x")[:4] for v in (a, b))
    assert x == y


@pytest.mark.parametrize("text", ["Ref(close, -1)", "close.real", "Ref(close, t)", "open[0]", "Mean(close, 0)", "1 + 2", "Ref(Ref(Ref(close, 252), 252), 252)", "close if 1 else 2", "nothing"])
def test_refused_expressions(text):
    with pytest.raises(dsl.ExpressionError):
        dsl.parse(text)


def test_lookback_and_signature():
    assert dsl.lookback(dsl.parse("Mean(Ref(returns, 3), 5)")) == 8
    assert dsl.signature("close + open") == dsl.signature("open + close")
    assert dsl.signature("-close") == dsl.signature("close", -1)
    assert dsl.signature("close - open") != dsl.signature("open - close")


def test_rank_among_members(spark):
    df = spark.createDataFrame([(DAY, 1, i, v, m) for i, (v, m) in enumerate([(1.0, True), (2.0, True), (100.0, False)])], "dt date, t int, inst long, close double, m boolean")
    assert [r.x for r in dsl.evaluate(df, {"x": "Rank(close)"}, "m").orderBy("inst").collect()] == [0.5, 1.0, None]


def test_daily_ic_by_hand(spark):
    rows = [(days(3)[0], i, float(i), -float(i)) for i in range(4)] + [(days(3)[1], i, float(i), 2.0 * i if i else None) for i in range(4)] + [(days(3)[2], i, 1.0, float(i)) for i in range(4)]
    out = evaluate.daily_ic(spark.createDataFrame(rows, "dt date, inst long, score double, label double"), least=3).orderBy("dt").collect()
    assert [(r.n, r.ic, r.rank_ic) for r in out] == [(4, pytest.approx(-1), pytest.approx(-1)), (3, pytest.approx(1), pytest.approx(1)), (4, None, None)]


def test_preprocess_masks_then_scales(spark):
    df = spark.createDataFrame([(DAY, 1, 1.0, True), (DAY, 2, 2.0, True), (DAY, 3, 1000.0, False)], "dt date, inst long, x double, m boolean")
    assert [r.score for r in evaluate.preprocess(df, "x", "m").orderBy("inst").collect()] == [pytest.approx(-1), pytest.approx(1), None]


def test_labels_stop_at_the_end(spark):
    p = frame(spark, [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]).withColumn("is_member", F.lit(True)).withColumn("exec_ok", F.lit(True))
    assert values(evaluate.forward_labels(p, 2, "2020-01-04"), "label") == [3.0, None, None, None, None, None, None]


def test_strict_asof_and_newest_null(spark):
    sig = spark.createDataFrame([("a", d) for d in days(8)], "code string, dt date")
    ev = spark.createDataFrame([("a", days(8)[1], 1.0), ("a", days(8)[3], None)], "code string, pub date, x double")
    out = asof.asof(sig, ev, "code", "dt", "pub", ["x"], max_age=3)
    assert values(out, "x") == [None, None, 1.0, 1.0, None, None, None, None]
    assert values(asof.asof(sig, ev, "code", "dt", "pub", ["x"], strict=False), "x")[:3] == [None, 1.0, 1.0]


def test_older_periods_published_late_are_ignored(spark):
    ev = spark.createDataFrame([("a", days(3)[0], days(3)[0], 1), ("a", days(3)[1], DAY - dt.timedelta(90), 2)], "code string, pub date, stat date, k long")
    assert [r.k for r in asof.current_periods(ev, "code", "pub", "stat", "k").collect()] == [1]


def test_bh(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")
    assert sorted(r.q for r in evaluate.bh_adjust(df, "p").collect()) == [pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04)]


def test_leaving_and_coming_back_gives_two_intervals(spark):
    df = spark.createDataFrame([(d, i + 1, 1, m) for i, (d, m) in enumerate(zip(days(5), [True, True, False, True, True], strict=True))], "dt date, t int, inst long, is_member boolean")
    assert panel.intervals(df).count() == 2


def test_limit_is_inclusive_both_ways(spark):
    df = spark.createDataFrame([(0.095, 1.0), (-0.095, 1.0), (0.0949, 1.0), (None, 1.0), (0.0, None)], "returns double, close double")
    assert [r.exec_ok for r in panel.eligible(df).collect()] == [False, False, True, True, False]


def test_quarantine_and_conflicts(spark):
    ev = spark.createDataFrame([("a", days(2)[1], DAY, "1.5"), ("a", DAY, days(2)[1], "2"), ("b", days(2)[1], DAY, "bad"), ("c", DAY, DAY, ""), (None, DAY, DAY, "inf")], "code string, pub date, stat date, v string")
    got = {(r.code, r.v): r.reason for r in events.quarantine(ev, "code", "pub", "stat", "v", "num").collect()}
    assert got == {("a", "1.5"): None, ("a", "2"): "invalid_date", ("b", "bad"): "malformed_number", ("c", ""): None, (None, "inf"): "malformed_number"}
    same = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("b", 1, 12), ("b", 2, 13)], "k string, v int, id long")
    assert sorted((r.k, r.v, r.ids, r.status) for r in events.merge_same_day(same, ["k"], "v", "id").collect()) == [("a", 1, [10, 11], "VALID"), ("b", 1, [12], "CONFLICT"), ("b", 2, [13], "CONFLICT")]


def test_expression_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('exprs,score\n"Mean($close, 5)",1\nclose,2\n')
    (tmp_path / "b.json").write_text('{"exprs": ["close", "open"]}')
    (tmp_path / "c.csv").write_text("other\nclose\n")
    (tmp_path / "d.json").write_text('{"exprs": []}')
    assert [r[0] for r in files.expressions(spark, str(tmp_path / "a.csv")).collect()] == ["Mean($close, 5)", "close"]
    assert [r[0] for r in files.expressions(spark, str(tmp_path / "b.json")).collect()] == ["close", "open"]
    for name in ("c.csv", "d.json"):
        with pytest.raises(ValueError):
            files.expressions(spark, str(tmp_path / name))


def test_infinities_end_as_null_and_are_carried_before(spark):
    rows = [("a", None, t, c, o) for t, (c, o) in enumerate([(2.0, 0.0), (3.0, 1.5), (0.0, 0.0), (4.0, None)], 1)]
    df = spark.createDataFrame(rows, "inst string, dt date, t int, close double, open double")
    got = dsl.evaluate(df, {"q": "close / open", "back": "1 / (close / open)", "mean": "Mean(close / open, 2)"}).orderBy("t").collect()
    assert [r.q for r in got] == [None, 2.0, None, None] and [r.back for r in got] == [0.0, 0.5, None, None] and [r.mean for r in got] == [None] * 4

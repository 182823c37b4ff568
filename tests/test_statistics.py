"""What SQL cannot say: components, residuals, resampling, evidence, files and refusals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanac.functions import dsl
from almanac.operators import evaluate, ledger, statements, statistics, validate
from almanac.sources import files


def panel(spark, dates=12, instruments=120):
    g = np.random.default_rng(7)
    n = dates * instruments
    a = g.normal(size=n)
    t = pd.DataFrame({"dt": np.repeat(np.arange(dates), instruments), "inst": np.tile(np.arange(instruments), dates), "a": a, "b": a + 0.3 * g.normal(size=n), "c": g.normal(size=n), "size": g.normal(size=n)})
    t["industry"] = (t.inst % 4).astype(str)
    return spark.createDataFrame(t), t


def test_components_equal_numpy(spark):
    df, t = panel(spark)
    names = ["a", "b", "c"]
    basis = statistics.fit_basis(df, names, target=0.99, least=100)
    values, vectors = np.linalg.eigh(np.cov(t[names].to_numpy().T))
    assert np.allclose(basis.shares, values[::-1] / values.sum())
    got = basis.project(df).orderBy("dt", "inst").toPandas()
    want = (t[names].to_numpy() - t[names].to_numpy().mean(0)) @ vectors[:, ::-1]
    for k in range(basis.loadings.shape[1]):
        assert abs(abs(np.corrcoef(got[f"PC{k + 1:02}"], want[:, k])[0, 1]) - 1) < 1e-9
    with pytest.raises(ValueError):
        statistics.fit_basis(df.limit(50), names)


def test_residual_is_orthogonal(spark):
    df, t = panel(spark)
    got = statistics.conditional_residual(df, "b", ["a"], "size", "industry", least=30).toPandas().merge(t, on=["dt", "inst"])
    assert len(got) == len(t)
    for _, day in got.groupby("dt"):
        for x in ("a", "size"):
            assert abs(day.residual @ (day[x] - day[x].mean())) < 1e-6
        assert day.groupby("industry").residual.mean().abs().max() < 1e-9 and abs(day.residual.std(ddof=0) - 1) < 1e-9


def series(spark, values, name="a"):
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], "g string, dt int, x double")


def test_bootstrap_with_numpys_draws(spark):
    """With starts that numpy drew, the same figures as resampling in numpy; holes keep their places."""
    values = [0.1 + 0.01 * (i % 7) - (0.3 if i % 11 == 0 else 0) for i in range(103)]
    values[5] = values[60] = None
    n, block, samples = len(values), 20, 300
    drawn = np.random.default_rng(42).integers(0, n, (samples, -(-n // block)))
    starts = spark.createDataFrame([(n, s, p + 1, int(at)) for s, row in enumerate(drawn) for p, at in enumerate(row)], "n long, sample int, piece int, start long")
    x = np.array([np.nan if v is None else v for v in values])
    means = np.array([np.nanmean(np.concatenate([x[(at + np.arange(block)) % n] for at in row])[:n]) for row in drawn])
    got = statistics.bootstrap(series(spark, values), "x", ["g"], block=block, starts=starts).first()
    mean = np.nanmean(x)
    assert got.mean == pytest.approx(mean) and (got.low, got.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    assert got.p == pytest.approx((1 + (means - mean >= mean).sum()) / (samples + 1))


def test_bootstrap_of_short_groups(spark):
    df = series(spark, [0.5] * 50).union(series(spark, [1.0] * 30, "short")).union(series(spark, [None] * 60, "empty"))
    got = {r.g: r for r in statistics.bootstrap(df, "x", ["g"], samples=50).collect()}
    assert (got["a"].mean, got["a"].low, got["a"].high, got["a"].p) == (0.5, 0.5, 0.5, 1 / 51)
    assert [(got[g].mean, got[g].low, got[g].p) for g in ("short", "empty")] == [(None, None, 1.0)] * 2


def test_residuals_equal_least_squares(spark):
    """Against numpy with all columns, on two dates; a basis column that does not vary, a small industry, holes."""
    r = np.random.default_rng(4)
    rows = []
    for day in (1, 2):
        for i in range(90):
            a, b, size = r.normal(), r.normal() * 1e3, r.normal() + 20
            y = 2 * a - 0.001 * b + size + r.normal() * 0.1
            rows.append((day, i, f"g{i % 4}" if i > 2 else "tiny", y, a, b, 7.0, size))
    rows[10] = (*rows[10][:4], None, *rows[10][5:])
    rows[11] = (*rows[11][:3], float("nan"), *rows[11][4:])
    df = spark.createDataFrame(rows, "dt int, inst int, industry string, y double, a double, b double, flat double, size double")
    got = {(x.dt, x.inst): x.residual for x in statistics.conditional_residual(df, "y", ["a", "b", "flat"], "size", "industry").collect()}
    for day in (1, 2):
        mine = [x for x in rows if x[0] == day and x[2] != "tiny" and x[4] is not None and x[3] == x[3]]
        x = np.column_stack([[x[k] for x in mine] for k in (4, 5, 7)] + [[float(x[2] == f"g{g}") for x in mine] for g in range(4)])
        y = np.array([x[3] for x in mine])
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert [got[day, m[1]] for m in mine] == pytest.approx((e / e.std()).tolist(), abs=1e-9)
    checks = statistics.conditional_checks(df, "y", ["a", "b", "flat"], "size", "industry").collect()
    assert len(got) == sum(c.n for c in checks) and all(c.columns == 7 and c.orthogonality_error < 1e-9 and c.explained > 0.9 for c in checks)
    assert statistics.conditional_residual(df, "y", ["a"], "flat", "industry").count() == 0


def test_one_nan_spoils_one_row_only(spark):
    r = np.random.default_rng(5)
    rows = [(1, i, float("nan") if i == 3 else r.normal(), r.normal(), i % 4) for i in range(60)]
    got = evaluate.neutralize(spark.createDataFrame(rows, "dt int, inst int, y double, z double, g int"), "y", "z", "g").collect()
    assert len(got) == 59 and all(x.neutral == x.neutral and x.neutral is not None for x in got)
    assert statistics.orthogonality(spark.createDataFrame(got), "neutral", ["z"], "g").first().orthogonality_error < 1e-9


def test_clusters():
    rho = [("a", "a", 1.0, 200), ("b", "b", 1.0, 200), ("c", "c", 1.0, 200), ("a", "b", -0.95, 200), ("a", "c", 0.2, 200), ("b", "c", 0.1, 200)]
    assert statistics.clusters(rho, {"a": 1, "b": 1, "c": 1}) == [("a", 1, "a"), ("b", 1, "a"), ("c", 2, "c")]
    assert statistics.clusters(rho, {"a": 1, "b": 0.5, "c": 1}) == [("a", 1, "a"), ("c", 2, "c")]


RECORD = "record struct<announcement_id string, claim_type string, document_class string, extraction_status string, money_unit string, period string, signature_date string, prior_reference string, profit struct<kind string, lower double, upper double, point double>, yoy struct<kind string, lower double, upper double, point double>, evidence array<struct<field string, page int, quote string>>>, doc struct<announcement_id string, period string>, text string"


def evidence(spark, quote, lower=100_000.0, page=1, unit="万元", ident="A"):
    record = (ident, "source_claim", "Q1_FORECAST", "DRAFT_EXTRACTED", unit, "2020-03-31", None, None, ("RANGE", lower, 200_000.0, None), ("MISSING", None, None, None), [("parent_profit_range", page, quote)])
    row = (record, ("A", "2020-03-31"), "=== PAGE 1 ===净利润 10 万元 至 20 万元=== PAGE 2 ===none")
    return spark.createDataFrame([row], RECORD).select(ledger.evidence_errors()).first()[0]


def test_evidence(spark):
    quote = "净利润 10 万元 至 20 万元"
    assert evidence(spark, quote) == []
    assert evidence(spark, quote, lower=110_000.0) == ["UNSUPPORTED_NUMBER:profit.lower"]
    assert "QUOTE_NOT_IN_PAGE:parent_profit_range" in evidence(spark, quote, page=2)
    assert "MISSING_PAGE:3" not in evidence(spark, quote) and "MISSING_PAGE:3" in evidence(spark, quote, page=3)
    assert "IDENTITY_MISMATCH" in evidence(spark, quote, ident="B")
    assert "UNORDERED_RANGE:profit" in evidence(spark, quote, lower=300_000.0)


def test_evidence_is_worked_out_once(spark):
    """The text is cut into pages once, not again for each code; of a repeated page the last counts, and quotes of a field are judged together."""
    assert str(ledger.evidence_errors()._jc).count("=== PAGE ") == 1
    quotes = [("parent_profit_range", 1, "净利润 10 万元"), ("parent_profit_range", 2, "至 20 万元"), ("yoy_range", 2, "同比 下降 5 %"), ("yoy_range", 1, ""), ("prior_reference", None, "x")]
    record = ("A", "source_claim", "Q1_FORECAST", "NEEDS_REVIEW", "万元", "2020-03-31", "2020-01-01", "earlier", ("RANGE", 100_000.0, 200_000.0, None), ("APPROX_POINT", None, None, 5.0), quotes)
    rows = [(record, ("A", "2020-03-31"), text) for text in ("=== PAGE 1 ===x=== PAGE 2 ===至20万元 同比下降5%=== PAGE 1 ===净利润10万元", "no pages", None)]
    held, none, null = (r[0] for r in spark.createDataFrame(rows, RECORD).select(ledger.evidence_errors()).collect())
    both = ["EMPTY_QUOTE:yoy_range", "MISSING_PAGE:None", "PRIOR_REFERENCE_EVIDENCE_MISSING", "SIGNATURE_DATE_EVIDENCE_MISSING"]
    assert held == sorted([*both, "APPROX_POINT_QUALIFIER_MISSING:yoy", "DECLINE_SIGN_CONFLICT"])
    assert none == null == sorted([*both, "APPROX_POINT_QUALIFIER_MISSING:yoy", "MISSING_PAGE:1", "MISSING_PAGE:2", "MISSING_SUPPORT:profit.lower", "MISSING_SUPPORT:profit.upper", "MISSING_SUPPORT:yoy.point"])


def test_statements_wait_for_their_dependencies(spark):
    rows = [("x", "2020-04-10", "2019-04-10", 1.0), ("y", "2020-04-10", "2020-05-01", 2.0), ("z", "2020-04-10", None, 3.0), ("w", None, "2019-04-10", 4.0)]
    df = spark.createDataFrame(rows, "k string, now string, before string, v double")
    got = statements.dependency_events(df, F.col("v"), [F.col("now")], [F.col("now"), F.col("before")], ["k"]).collect()
    assert sorted((r.k, r.published, r.value) for r in got if r.value is not None) == [("x", "2020-04-10", 1.0), ("y", "2020-05-01", 2.0)]
    assert sorted((r.k, r.published) for r in got if r.value is None) == [("y", "2020-04-10"), ("z", "2020-04-10")]


def test_refusals(spark):
    good = spark.createDataFrame([("2020-01-01", 0.1, 0.0, 0.01, 0.5)], "dt string, ret double, bench double, cost double, turnover double")
    validate.refuse(validate.report_violations(good))
    with pytest.raises(validate.ValidationError, match="duplicate_date: 1"):
        validate.refuse(validate.report_violations(good.union(good)))
    with pytest.raises(Exception, match="a key is repeated"):
        validate.one_to_one(good.union(good), good, ["dt"]).collect()
    assert validate.differing(good, good).count() == 0 and validate.differing(good.union(good), good).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{"body": {"result": {"data": [{"k": 1, "v": "x"}, {"k": 2, "v": "y"}]}}}')
    (tmp_path / "p" / "b.json").write_text('{"body": {}}')
    pages = files.json_pages(spark, str(tmp_path / "p"), "k: int, v: string", ["k"])
    assert sorted(map(tuple, pages.collect())) == [(1, "x"), (2, "y")]
    manifest = spark.createDataFrame(files.sealed(spark, str(tmp_path / "p"), "*.json").collect(), "file string, sha256 string")
    assert files.seal_violations(spark, str(tmp_path / "p"), manifest, "*.json").count() == 0
    (tmp_path / "p" / "b.json").write_text("{}")
    assert [tuple(r) for r in files.seal_violations(spark, str(tmp_path / "p"), manifest, "*.json").collect()] == [("b.json", "changed")]
    assert files.strict_json({"x": float("nan")}) == '{\n  "x": null\n}'
    files.write_json({"x": [1, float("inf")]}, str(tmp_path / "out.json"))
    with pytest.raises(TypeError):
        files.write_json({"x": object()}, str(tmp_path / "out.json"))
    assert (tmp_path / "out.json").read_text() == '{\n  "x": [\n    1,\n    null\n  ]\n}\n' and sorted(p.name for p in tmp_path.iterdir()) == ["out.json", "p"]


@pytest.mark.parametrize(
    ("dialect", "text", "want"),
    [
        ("alphaforge", "ts_mean($close, 5)", "Mean(close, 5)"), ("alphasage", "TsMean(Div($close, $open), 5)", "Mean(Div(close, open), 5)"), ("alphaforge", "Inv((-0.01*vwap))", "Div(1, Mul(-(0.01), vwap))"),
        ("alphaforge", "(2.0-((vwap--10.0)-30.0))", "Sub(2.0, Sub(Sub(vwap, -(10.0)), 30.0))"), ("alphasage", "Abs($low) + Ref($high, 0)", "Add(Abs(low), Ref(high, 0))"),
    ],
)
def test_translation(dialect, text, want):
    assert files.translate(dialect, text) == want
    assert dsl.render(dsl.parse(want)) == want


@pytest.mark.parametrize(
    ("dialect", "text"),
    [
        ("alphasage", "Rank($close)"), ("alphasage", "TsRank($close,20)"), ("alphaforge", "CSRank($close)"), ("alphaforge", "Ref($close,-1)"), ("alphasage", "$unknown"), ("alphasage", "Div(1,Log($close))"), ("alphaforge", "ts_delta(close,0)"), ("alphasage", "Abs(-1)"),
        ("alphasage", '__import__("os").system("echo bad")'), ("alphasage", "ts_mean($close, 5)"), ("alphaforge", "ts_mean(3, 5) + close"), ("alphaforge", "turnover"), ("alphaforge", "Inv(close, open)"), ("other", "close"), ("alphaforge", ""), ("alphaforge", "close**2"), ("alphaforge", "Pow(close, 2)"),
    ],
)
def test_translation_refuses(dialect, text):
    with pytest.raises(ValueError):
        files.translate(dialect, text)

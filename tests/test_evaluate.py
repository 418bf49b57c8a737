import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerocal.functions import error_stats, fit_metrics, line_fit, mape, student_p
from aerocal.operators.evaluate import (
    correlation,
    curve_points,
    error_analysis,
    model_metrics,
    pearson_test,
    stage_errors,
    trend_lines,
    trend_points,
)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    temp, rh = rng.normal(20, 4, 400), rng.normal(60, 9, 400)
    ref = rng.uniform(5, 90, 400)
    m = ref * 0.8 + 0.3 * temp - 0.02 * (rh - 50) ** 2 + rng.normal(0, 2, 400)
    rows = [tuple(map(float, r)) for r in zip(ref, m, temp, rh)]
    return spark.createDataFrame(rows, "ref double, m double, temp double, rh double"), (ref, m, temp, rh)


def test_fit_metrics(spark, noisy):
    df, (ref, m, *_) = noisy
    extra = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0), (50.0, None, 1.0, 1.0)], df.schema))
    row = extra.agg(*fit_metrics(F.col("ref"), F.col("m"))).first()
    e = ref - m
    assert row.r2 == pytest.approx(1 - (e**2).sum() / ((ref - ref.mean()) ** 2).sum())
    assert row.rmse == pytest.approx(math.sqrt((e**2).mean()))
    assert row.mae == pytest.approx(np.abs(e).mean())
    assert row.n == 400


def test_constant_reference_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    assert df.agg(*fit_metrics(F.col("y"), F.col("p"))).first().r2 is None


def test_mape_with_zero_reference(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 9.0)], "ref double, p double")
    loose = df.agg(*error_stats(F.col("ref"), F.col("p"))).first()
    assert (loose.mae, loose.mape, loose.rmse) == pytest.approx((1.0, 10.0, 1.0))
    assert df.agg(mape(F.col("ref"), F.col("p"), strict=True)).first()[0] is None
    assert df.where("ref > 0").agg(mape(F.col("ref"), F.col("p"), strict=True)).first()[0] == pytest.approx(10.0)


def test_line_fit_fixture(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 5.0), (None, 4.0)], "x double, y double")
    row = df.agg(*line_fit(F.col("y"), F.col("x"))).first()
    assert (row.slope, row.intercept, row.r2, row.n) == pytest.approx((1.5, 1 / 3, 0.96429, 3), abs=1e-5)


def _student_tail(t, dof, steps=400_000):
    """Two-sided tail by integration over x = tan(u)."""
    u = np.linspace(math.atan(abs(t)), math.pi / 2, steps)[:-1]
    x = np.tan(u)
    log_c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)
    density = np.exp(log_c - (dof + 1) / 2 * np.log1p(x * x / dof)) * (1 + x * x)
    return 2 * np.trapezoid(density, u)


def test_pearson_p_value(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=25)
    y = 0.4 * x + rng.normal(size=25)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = pearson_test(df, "x", "y").first()
    r = np.corrcoef(x, y)[0, 1]
    t = r * math.sqrt(23 / (1 - r * r))
    assert (got.r, got.t) == pytest.approx((r, t))
    assert got.p == pytest.approx(_student_tail(t, 23), rel=1e-3)
    assert correlation(df, "x", "y").first().r == pytest.approx(r)


def test_student_p_against_closed_forms(spark):
    """One and two degrees of freedom have closed forms; very many are the normal distribution."""
    ts = [0.0, 1e-9, 1e-3, 0.3, 1.0, -2.5, 30.0, 1e4]
    rows = [(t, v) for t in ts for v in (1, 2, 10**12)] + [(1.0, 0), (None, 5)]
    df = spark.createDataFrame(rows, "t double, v long")
    got = {(r.t, r.v): r.p for r in df.select("t", "v", student_p(F.col("t"), F.col("v")).alias("p")).collect()}
    for t in ts:
        a = abs(t)
        assert got[t, 1] == pytest.approx(2 / math.pi * math.atan2(1, a), rel=1e-11)
        assert got[t, 2] == pytest.approx(2 / (math.sqrt(2 + a * a) * (math.sqrt(2 + a * a) + a)), rel=1e-11)
        assert got[t, 10**12] == pytest.approx(math.erfc(a / math.sqrt(2)), rel=1e-6, abs=1e-300)
    assert got[1.0, 0] is None and got[None, 5] is None


def test_pearson_p_per_group(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(x), float(x * w + rng.normal())) for k, w in (("a", 0.0), ("b", 1.0), (None, 0.3)) for x in rng.normal(size=40)]
    rows += [("two", 1.0, 2.0), ("two", 2.0, 5.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", 3.0, 6.0), ("flat", 1.0, 1.0)]
    rows += [("a", None, 1.0), ("flat", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r for r in pearson_test(df, "x", "y", ["k"]).collect()}
    for k in ("a", "b", None):
        assert got[k].n == 40
        assert got[k].p == pytest.approx(_student_tail(got[k].t, 38), rel=1e-3)
    assert got["two"].p is None and got["flat"].p is None
    assert got["line"].p == pytest.approx(0.0, abs=1e-6)


def test_error_analysis_matches_polyfit(noisy):
    df, (ref, m, temp, rh) = noisy
    rows = {(r.covariate, r.error_kind): r for r in error_analysis(df, "ref", "m", {"temp": "temp", "rh": "rh"}).collect()}
    errors = {"abs": ref - m, "pct": 100 * (ref - m) / ref}
    assert len(rows) == 4
    for (covariate, kind), row in rows.items():
        x = {"temp": temp, "rh": rh}[covariate]
        assert (row.slope, row.intercept) == pytest.approx(np.polyfit(x, errors[kind], 1))
        assert (row.q2, row.q1, row.q0) == pytest.approx(np.polyfit(x, errors[kind], 2), rel=1e-6)
        assert row.mean_abs_error == pytest.approx(np.abs(errors["abs"]).mean())
        assert row.mean_pct_error == pytest.approx(np.abs(errors["pct"]).mean())


def test_error_analysis_skips_zero_references(spark):
    rows = [(0.0, 3.0, 1.0), (10.0, 9.0, 2.0), (20.0, 21.0, 3.0), (30.0, 27.0, 5.0)]
    df = spark.createDataFrame(rows, "ref double, m double, t double")
    got = {r.error_kind: r for r in error_analysis(df, "ref", "m", {"t": "t"}).collect()}
    pct = np.array([10.0, -5.0, 10.0])
    assert (got["pct"].slope, got["pct"].intercept) == pytest.approx(np.polyfit([2, 3, 5], pct, 1))
    assert (got["pct"].q2, got["pct"].q1, got["pct"].q0) == pytest.approx(np.polyfit([2, 3, 5], pct, 2))


def test_metrics_and_stages_in_one_pass(noisy):
    df, (ref, m, *_) = noisy
    both = model_metrics(df.withColumn("s", F.lit("x")), "ref", {"m": "m", "t": "temp"}, by=["s"])
    assert {r.model for r in both.collect()} == {"m", "t"}
    assert both._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 1
    errors = {r.stage: r.mae for r in stage_errors(df, "ref", {"raw": "m", "same": "ref"}).collect()}
    assert errors == pytest.approx({"raw": np.abs(ref - m).mean(), "same": 0.0})


def test_trend(noisy):
    df, (ref, m, *_) = noisy
    lines = trend_lines(df, "ref", {"m": "m"})
    line = lines.first()
    assert (line.slope, line.intercept) == pytest.approx(np.polyfit(ref, m, 1))
    assert (line.lo, line.hi) == pytest.approx((min(ref.min(), m.min()), max(ref.max(), m.max())))
    points = trend_points(lines).orderBy("point").collect()
    assert [p.x for p in points] == pytest.approx(np.linspace(line.lo, line.hi, 200))
    assert points[7].y == pytest.approx(line.slope * points[7].x + line.intercept)


def test_curve_over_sorted_x(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (None,)], "x double")
    q = spark.createDataFrame([(2.0, 1.0, -1.0)], "q2 double, q1 double, q0 double")
    assert [tuple(r) for r in curve_points(df, "x", q).collect()] == [(1.0, 2.0), (3.0, 20.0)]

"""Baselines, metrics, correlation, trends and error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerocal.catalog.frames import BASELINE_SQL, SPEC, WIDE_SQL, daily, table, wide
from aerocal.catalog.registry import label, ls, query, r, rs
from aerocal.config import SplitSpec
from aerocal.functions import (
    error_stats,
    line_fit,
    mape,
    pair_range,
    percent_error,
    signed_error,
)
from aerocal.operators.calibrate import (
    apply_compensated_baseline,
    collect_params,
    fit_compensated_baseline,
    recombine,
    residual,
)
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
from aerocal.operators.models import labelled_splits
from aerocal.session import materialise


def fitted_baseline(spark, sf):
    """Labelled rows, written once, and the baseline fitted on their train months."""
    rows = materialise(labelled_splits(daily(spark, sf), SPEC, SplitSpec()), "labelled")
    return rows, collect_params(fit_compensated_baseline(rows.where("split = 'train'"), SPEC))


def baseline_rows(spark, sf):
    """Labelled rows with baseline, and ``raw``: the signal with gaps filled."""
    rows, params = fitted_baseline(spark, sf)
    rows = apply_compensated_baseline(rows, SPEC, params, "y_baseline", everywhere=True)
    return rows.withColumn("raw", F.coalesce(F.col("O3_lcs_ppb"), F.lit(params["O3_lcs_ppb"])))


@query(
    f"""WITH {BASELINE_SQL}
SELECT {rs("mo3")} AS O3_lcs_ppb, {rs("mt")} AS Temp_lcs, {rs("mh")} AS RH_lcs,
       {rs("alpha")} AS alpha, {rs("beta")} AS beta FROM med, line"""
)
def baseline_parameters(spark, sf):
    rows = labelled_splits(daily(spark, sf), SPEC, SplitSpec()).where("split = 'train'")
    out = fit_compensated_baseline(rows, SPEC)
    return out.select(*[r(c).alias(c) for c in (*SPEC.features, "alpha", "beta")])


@query(
    f"""WITH {BASELINE_SQL}
SELECT sensor_id, {ls("ts")} AS ts, split, {rs("y", 10)} AS y, {rs("yb", 4)} AS y_baseline FROM based"""
)
def baseline_affine(spark, sf):
    return baseline_rows(spark, sf).select(
        "sensor_id",
        label("ts").alias("ts"),
        "split",
        r("O3_ref", 10).alias("y"),
        r("y_baseline", 4).alias("y_baseline"),
    )


def _metrics_sql(model: str, pred: str, source: str = "based") -> str:
    return f"""SELECT split, '{model}' AS model,
  {rs(f"1 - sum(pow(y - {pred}, 2)) / (var_pop(y) * count(y))")} AS r2,
  {rs(f"sqrt(avg(pow(y - {pred}, 2)))")} AS rmse, {rs(f"avg(abs(y - {pred}))")} AS mae, count(*) AS n
FROM {source} GROUP BY 1"""


@query(
    f"""WITH {BASELINE_SQL}
{_metrics_sql("baseline", "yb")} UNION ALL {_metrics_sql("raw", "fo3")}"""
)
def metrics_by_split(spark, sf):
    rows = baseline_rows(spark, sf)
    out = model_metrics(rows, "O3_ref", {"baseline": "y_baseline", "raw": "raw"}, by=["split"])
    return out.select("split", "model", r("r2").alias("r2"), r("rmse").alias("rmse"), r("mae").alias("mae"), "n")


@query(
    f"""WITH {BASELINE_SQL}
SELECT sensor_id, {ls("ts")} AS ts, {rs("y - yb", 4)} AS residual, {rs("abs(y - yb)", 4)} AS abs_residual,
       {rs("sqrt(pow(y - yb, 2))", 4)} AS root_sq, {rs("y", 10)} AS recombined FROM based"""
)
def residual_recombine(spark, sf):
    rows = residual(baseline_rows(spark, sf), "O3_ref")
    e = F.col("residual")
    return rows.select(
        "sensor_id",
        label("ts").alias("ts"),
        r(e, 4).alias("residual"),
        r(F.abs(e), 4).alias("abs_residual"),
        r(F.sqrt(F.pow(e, 2)), 4).alias("root_sq"),
        r(recombine("y_baseline", "residual"), 10).alias("recombined"),
    )


@query(
    f"""WITH {WIDE_SQL}, s AS (
  SELECT 'raw' AS stage, view AS ref, click AS p FROM wide UNION ALL
  SELECT 'halved', view, click / 2 FROM wide UNION ALL
  SELECT 'shifted', view, click + 5 FROM wide)
SELECT stage, {rs("avg(abs(ref - p))")} AS mae, {rs("100 * avg(abs(ref - p) / nullif(ref, 0))")} AS mape,
  {rs("sqrt(avg(pow(ref - p, 2)))")} AS rmse FROM s GROUP BY 1"""
)
def error_metrics(spark, sf):
    rows = wide(spark, sf).select(
        "view", "click", (F.col("click") / 2).alias("halved"), (F.col("click") + 5).alias("shifted")
    )
    out = stage_errors(rows, "view", {"raw": "click", "halved": "halved", "shifted": "shifted"})
    return out.select("stage", *[r(c).alias(c) for c in ("mae", "mape", "rmse")])


@query(
    f"""SELECT l_returnflag, {rs("avg(abs(l_tax - l_discount))")} AS mae,
  {rs("100 * avg(abs(l_tax - l_discount) / nullif(l_tax, 0))")} AS mape,
  {rs("sqrt(avg(pow(l_tax - l_discount, 2)))")} AS rmse,
  CASE WHEN count(CASE WHEN l_tax = 0 THEN 1 END) = 0
       THEN {rs("100 * avg(abs(l_tax - l_discount) / nullif(l_tax, 0))")} END AS strict_mape
FROM lineitem GROUP BY 1"""
)
def error_metrics_with_zeros(spark, sf):
    """A reference that holds zeros: skipped, or null when strict."""
    ref, m = F.col("l_tax"), F.col("l_discount")
    out = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        *error_stats(ref, m), mape(ref, m, strict=True).alias("strict_mape")
    )
    return out.select("l_returnflag", *[r(c).alias(c) for c in ("mae", "mape", "rmse", "strict_mape")])


@query(
    f"""WITH {WIDE_SQL}
SELECT {ls("ts")} AS ts, {rs("view - click")} AS error, {rs("100 * (view - click) / nullif(view, 0)")} AS pct
FROM wide"""
)
def percent_errors(spark, sf):
    ref, m = F.col("view"), F.col("click")
    return wide(spark, sf).select(
        label("ts").alias("ts"), r(signed_error(ref, m)).alias("error"), r(percent_error(ref, m)).alias("pct")
    )


@query(
    f"""WITH {WIDE_SQL}
SELECT {rs("avg(abs(view - click))")} AS mean_abs_error,
       {rs("avg(abs(100 * (view - click) / nullif(view, 0)))")} AS mean_pct_error,
       {rs("least(min(view), min(click))")} AS lo, {rs("greatest(max(view), max(click))")} AS hi FROM wide"""
)
def mean_errors(spark, sf):
    ref, m = F.col("view"), F.col("click")
    lo, hi = pair_range(ref, m)
    return wide(spark, sf).agg(
        r(F.avg(F.abs(signed_error(ref, m)))).alias("mean_abs_error"),
        r(F.avg(F.abs(percent_error(ref, m)))).alias("mean_pct_error"),
        r(lo).alias("lo"),
        r(hi).alias("hi"),
    )


@query(f"SELECT {rs('corr(l_quantity, l_extendedprice)', 8)} AS r, count(*) AS n FROM lineitem")
def correlation_pair(spark, sf):
    out = correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(r("r", 8).alias("r"), "n")


@query(
    f"""SELECT l_returnflag, {rs("regr_slope(l_extendedprice, l_quantity)", 4)} AS slope,
  {rs("regr_intercept(l_extendedprice, l_quantity)", 4)} AS intercept,
  {rs("corr(l_quantity, l_extendedprice)", 8)} AS r, {rs("regr_r2(l_extendedprice, l_quantity)", 8)} AS r2,
  regr_count(l_extendedprice, l_quantity)::BIGINT AS n
FROM lineitem GROUP BY 1"""
)
def linregress(spark, sf):
    fit = line_fit(F.col("l_extendedprice"), F.col("l_quantity"))
    out = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*fit)
    return out.select(
        "l_returnflag",
        r("slope", 4).alias("slope"),
        r("intercept", 4).alias("intercept"),
        r("r", 8).alias("r"),
        r("r2", 8).alias("r2"),
        "n",
    )


def _p_sql(source: str, keys: str = "", steps: int = 4000) -> str:
    """p by Simpson's rule over the density of Student's t, up to 40 deviations, where nothing is left."""
    key = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""
fits AS (
  SELECT {key}regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r, CAST(regr_count(y, x) AS BIGINT) AS n
  FROM {source} {"GROUP BY " + keys if keys else ""}
),
tested AS (SELECT *, n - 2 AS v, r * sqrt((n - 2) / (1 - r * r)) AS t FROM fits),
steps AS (SELECT unnest(generate_series(0, {steps})) AS i),
areas AS (
  SELECT {key}sum(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * pow(1 + pow(i * least(abs(t), 40e0) / {steps}, 2) / v, -(v + 1) / 2e0)) * any_value(least(abs(t), 40e0)) / {steps * 3}
    * any_value(exp(lgamma((v + 1) / 2e0) - lgamma(v / 2e0)) / sqrt(v * pi())) AS area
  FROM tested, steps {"GROUP BY " + keys if keys else ""}
)
SELECT {key}{rs("slope")} AS slope, {rs("intercept")} AS intercept, {rs("r")} AS r, n, {rs("t", 4)} AS t,
  {rs("greatest(1 - 2 * area, 0)")} AS p
FROM tested JOIN areas {using}"""


def _rounded_test(fit):
    names = [c for c in fit.columns if c not in ("slope", "intercept", "r", "n", "t", "p")]
    kept = [r(c).alias(c) for c in ("slope", "intercept", "r")]
    return fit.select(*names, *kept, "n", r("t", 4).alias("t"), r("p").alias("p"))


@query(f"WITH pairs AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), {_p_sql('pairs')}")
def pearson_p(spark, sf):
    return _rounded_test(pearson_test(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query(
    f"WITH pairs AS (SELECT l_suppkey, l_discount AS x, l_extendedprice AS y FROM lineitem), {_p_sql('pairs', 'l_suppkey')}"
)
def pearson_p_by_sensor(spark, sf):
    """Every supplier's own test, in one aggregate."""
    return _rounded_test(pearson_test(table(spark, sf, "lineitem"), "l_discount", "l_extendedprice", ["l_suppkey"]))


def _error_fit_sql(covariate: str, column: str, kind: str, error: str) -> str:
    both = f"{column} IS NOT NULL AND {error} IS NOT NULL"
    return f"""
SELECT '{covariate}' AS covariate, '{kind}' AS error_kind, regr_slope(e, x) AS slope, regr_intercept(e, x) AS intercept,
  max(c) AS c, count(*)::DOUBLE AS n, sum(x - c) AS s1, sum(pow(x - c, 2)) AS s2, sum(pow(x - c, 3)) AS s3,
  sum(pow(x - c, 4)) AS s4, sum(e) AS t0, sum(e * (x - c)) AS t1, sum(e * pow(x - c, 2)) AS t2
FROM (SELECT {column} AS x, {error} AS e, (SELECT avg({column}) FROM err) AS c FROM err WHERE {both})"""


@query(
    f"""WITH err AS (
  SELECT l_quantity AS q, l_discount * 1000 AS h, l_extendedprice / 1000e0 * (1 - l_tax) - l_extendedprice / 1000e0 AS abs_e,
    100 * (l_extendedprice / 1000e0 * (1 - l_tax) - l_extendedprice / 1000e0) / nullif(l_extendedprice / 1000e0 * (1 - l_tax), 0) AS pct_e
  FROM lineitem
),
sums AS ({" UNION ALL ".join(_error_fit_sql(n, c, k, e) for n, c in (("temp", "q"), ("rh", "h")) for k, e in (("abs", "abs_e"), ("pct", "pct_e")))}),
solved AS (
  SELECT *, s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS d,
    t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0) AS d2,
    s4 * (t1 * n - s1 * t0) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2) AS d1,
    s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2) AS d0
  FROM sums
)
SELECT covariate, error_kind, {rs("slope", 8)} AS slope, {rs("intercept", 8)} AS intercept,
  {rs("d2 / d", 8)} AS q2, {rs("d1 / d - 2 * d2 / d * c", 8)} AS q1, {rs("d0 / d - d1 / d * c + d2 / d * c * c", 8)} AS q0,
  (SELECT {rs("avg(abs(abs_e))")} FROM err) AS mean_abs_error, (SELECT {rs("avg(abs(pct_e))")} FROM err) AS mean_pct_error
FROM solved"""
)
def polyfit2_error(spark, sf):
    """Error of a taxed price against two covariates: eight fits in one aggregate."""
    price = F.col("l_extendedprice") / 1000
    rows = table(spark, sf, "lineitem").select(
        (price * (1 - F.col("l_tax"))).alias("ref"),
        price.alias("measured"),
        F.col("l_quantity").alias("temp"),
        (F.col("l_discount") * 1000).alias("rh"),
    )
    out = error_analysis(rows, "ref", "measured", {"temp": "temp", "rh": "rh"})
    return out.select(
        "covariate",
        "error_kind",
        *[r(c, 8).alias(c) for c in ("slope", "intercept", "q2", "q1", "q0")],
        r("mean_abs_error").alias("mean_abs_error"),
        r("mean_pct_error").alias("mean_pct_error"),
    )


_JULY = f"""WITH {BASELINE_SQL},
july AS (SELECT y, yb, fo3 FROM based WHERE month(ts) = 7),
lines AS (
  SELECT 'baseline' AS model, regr_slope(yb, y) AS slope, regr_intercept(yb, y) AS intercept FROM july
  UNION ALL SELECT 'raw', regr_slope(fo3, y), regr_intercept(fo3, y) FROM july
),
ends AS (SELECT least(min(y), min(yb), min(fo3)) AS lo, greatest(max(y), max(yb), max(fo3)) AS hi FROM july)"""


def _july(spark, sf):
    return baseline_rows(spark, sf).where(F.month("ts") == 7)


@query(
    f"""{_JULY}
SELECT model, {rs("slope")} AS slope, {rs("intercept")} AS intercept, {rs("lo")} AS lo, {rs("hi")} AS hi
FROM lines, ends"""
)
def trend_line_fit(spark, sf):
    out = trend_lines(_july(spark, sf), "O3_ref", {"baseline": "y_baseline", "raw": "raw"})
    return out.select("model", *[r(c).alias(c) for c in ("slope", "intercept", "lo", "hi")])


@query(
    f"""{_JULY},
points AS (SELECT unnest(generate_series(0, 199)) AS point)
SELECT model, point, {rs("lo + point * (hi - lo) / 199")} AS x,
  {rs("slope * (lo + point * (hi - lo) / 199) + intercept")} AS y
FROM lines, ends, points"""
)
def trend_grid(spark, sf):
    lines = trend_lines(_july(spark, sf), "O3_ref", {"baseline": "y_baseline", "raw": "raw"})
    out = trend_points(lines, 200)
    return out.select(
        "model", F.col("point").cast("long").alias("point"), r("x").alias("x"), r("y").alias("y")
    )


@query(
    f"""WITH f AS (
  SELECT regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem
)
SELECT l_quantity AS x, {rs("m * l_quantity + b", 4)} AS y FROM lineitem, f ORDER BY 1"""
)
def sorted_curve(spark, sf):
    """A fitted line evaluated over the sorted x of the table."""
    rows = table(spark, sf, "lineitem")
    fit = rows.agg(*line_fit(F.col("l_extendedprice"), F.col("l_quantity"))).select(
        F.lit(0.0).alias("q2"), F.col("slope").alias("q1"), F.col("intercept").alias("q0")
    )
    return curve_points(rows, "l_quantity", fit).select("x", r("y", 4).alias("y"))

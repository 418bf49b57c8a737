"""Error metrics, correlation, trends and error analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.functions import (
    error_stats,
    fit_metrics,
    line_fit,
    pair_range,
    percent_error,
    power_sums,
    quadratic_from_sums,
    signed_error,
    student_p,
)

METRICS = ("r2", "rmse", "mae", "n")


def model_metrics(
    df: DataFrame, label: str, predictions: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """R2, RMSE and MAE per group and model: (*by, model, r2, rmse, mae, n).

    All models are measured in one pass; rows are not multiplied per model.
    """
    stats = [
        F.struct(F.lit(name).alias("model"), *fit_metrics(F.col(label), F.col(c)))
        for name, c in predictions.items()
    ]
    packed = df.groupBy(*by).agg(F.array(*stats).alias("_m"))
    return packed.select(*by, F.inline("_m"))


def stage_errors(
    df: DataFrame, reference: str, stages: Mapping[str, str], strict: bool = False
) -> DataFrame:
    """MAE, MAPE and RMSE of each processing stage against the reference."""
    stats = [
        F.struct(F.lit(name).alias("stage"), *error_stats(F.col(reference), F.col(c), strict))
        for name, c in stages.items()
    ]
    return df.agg(F.array(*stats).alias("_m")).select(F.inline("_m"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of rows where both values exist."""
    return df.agg(F.corr(a, b).alias("r"), F.regr_count(b, a).alias("n"))


def pearson_test(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, r, n, t and two-sided p of the straight-line fit of y on x, per group.

    The p-value of r and of the slope are the same test. One aggregate over the rows; t and p are null
    with fewer than three pairs or without spread, and p is 0 on a perfect line.
    """
    fit = df.groupBy(*keys).agg(*line_fit(F.col(y).cast("double"), F.col(x).cast("double")))
    dof, rest = F.col("n") - 2, 1 - F.col("r") * F.col("r")
    fit = fit.withColumn("t", F.when((dof > 0) & (rest > 0), F.col("r") * F.sqrt(dof / rest)))
    p = F.when((dof > 0) & (rest <= 0), 0.0).otherwise(student_p(F.col("t"), dof))
    return fit.select(*keys, "slope", "intercept", "r", "n", "t", p.alias("p"))


def trend_lines(df: DataFrame, reference: str, models: Mapping[str, str]) -> DataFrame:
    """Straight line of each model on the reference: (model, slope, intercept, lo, hi).

    ``lo`` and ``hi`` span the reference and all models, as a shared axis would.
    """
    lo, hi = pair_range(F.col(reference), *[F.col(c) for c in models.values()])
    fits = [
        F.struct(
            F.lit(name).alias("model"),
            F.regr_slope(c, reference).alias("slope"),
            F.regr_intercept(c, reference).alias("intercept"),
        )
        for name, c in models.items()
    ]
    packed = df.agg(lo.alias("lo"), hi.alias("hi"), F.array(*fits).alias("_f"))
    return packed.select(F.inline("_f"), "lo", "hi")


def trend_points(lines: DataFrame, points: int = 200) -> DataFrame:
    """Each line at evenly spaced x from lo to hi: (model, point, x, y)."""
    x = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    return (
        lines.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x)
        .select("model", "point", "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("y"))
    )


def error_columns(df: DataFrame, reference: str, measured: str) -> DataFrame:
    ref, m = F.col(reference), F.col(measured)
    return df.withColumns({"error_abs": signed_error(ref, m), "error_pct": percent_error(ref, m)})


def error_analysis(
    df: DataFrame, reference: str, measured: str, covariates: Mapping[str, str]
) -> DataFrame:
    """Error against each covariate, straight and quadratic.

    One row per (covariate, error kind): line ``slope, intercept``, quadratic
    ``q2, q1, q0``, and the mean absolute error and percent error of the whole
    table. Two passes: the covariate means, then every sum of every fit at once.
    """
    rows = error_columns(df, reference, measured)
    means = rows.agg(*[F.avg(c).alias(name) for name, c in covariates.items()])
    rows = rows.withColumn("_center", means.select(F.struct(*means.columns)).scalar())
    fits = []
    for name, c in covariates.items():
        for kind in ("abs", "pct"):
            e, x = F.col(f"error_{kind}"), F.col(c)
            fits.append(
                F.struct(
                    F.lit(name).alias("covariate"),
                    F.lit(kind).alias("error_kind"),
                    F.regr_slope(e, x).alias("slope"),
                    F.regr_intercept(e, x).alias("intercept"),
                    power_sums(e, x - F.col("_center")[name]).alias("sums"),
                    F.max(F.col("_center")[name]).alias("center"),
                )
            )
    packed = rows.agg(
        F.array(*fits).alias("_f"),
        F.avg(F.abs("error_abs")).alias("mean_abs_error"),
        F.avg(F.abs("error_pct")).alias("mean_pct_error"),
    )
    flat = packed.select(F.inline("_f"), "mean_abs_error", "mean_pct_error")
    return flat.withColumn("q", quadratic_from_sums(F.col("sums"), F.col("center"))).select(
        "covariate", "error_kind", "slope", "intercept", "q.q2", "q.q1", "q.q0",
        "mean_abs_error", "mean_pct_error",
    )


def curve_points(df: DataFrame, x: str, coefficients: DataFrame) -> DataFrame:
    """Fitted curves at the x values of the table, in order of x.

    ``coefficients`` is one row with ``q2, q1, q0`` (a line has q2 = 0).
    """
    xx, q = F.col(x), F.col("_q")
    return (
        df.where(xx.isNotNull())
        .withColumn("_q", coefficients.select(F.struct("q2", "q1", "q0")).scalar())
        .select(xx.alias("x"), ((q["q2"] * xx + q["q1"]) * xx + q["q0"]).alias("y"))
        .orderBy("x")
    )

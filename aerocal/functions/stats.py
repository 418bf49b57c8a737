"""Aggregate expressions. Each is one declarative aggregate, combined map-side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "coverage",
    "error_stats",
    "fit_metrics",
    "line_fit",
    "mape",
    "pair_range",
    "power_sums",
    "quadratic_from_sums",
    "student_p",
]


def coverage(c: Column) -> Column:
    """Percent of rows with a value."""
    return 100.0 * F.count(c) / F.count(F.lit(1))


def fit_metrics(y: Column, pred: Column, prefix: str = "") -> list[Column]:
    """R2, RMSE and MAE over rows where both values exist; constant y -> null R2."""
    both = y.isNotNull() & pred.isNotNull()
    yy = F.when(both, y)
    e = y - pred
    ss_tot = F.var_pop(yy) * F.count(yy)
    return [
        (1.0 - F.sum(e * e) / F.nullif(ss_tot, F.lit(0.0))).alias(f"{prefix}r2"),
        F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"),
        F.avg(F.abs(e)).alias(f"{prefix}mae"),
        F.count(e).alias(f"{prefix}n"),
    ]


def mape(ref: Column, pred: Column, strict: bool = False) -> Column:
    """Mean absolute percent error. Zero references are skipped, or, when
    ``strict``, any zero reference makes the result null."""
    value = 100.0 * F.avg(F.abs(ref - pred) / F.nullif(ref, F.lit(0.0)))
    if not strict:
        return value
    return F.when(F.count_if((ref == 0) & pred.isNotNull()) == 0, value)


def error_stats(ref: Column, pred: Column, strict: bool = False) -> list[Column]:
    """MAE, MAPE and RMSE."""
    e = ref - pred
    return [
        F.avg(F.abs(e)).alias("mae"),
        mape(ref, pred, strict).alias("mape"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    ]


def line_fit(y: Column, x: Column) -> list[Column]:
    """Least-squares line: slope, intercept, correlation, R2 and pair count."""
    return [
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(x, y).alias("r"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    ]


def pair_range(*columns: Column) -> tuple[Column, Column]:
    """Smallest and largest value over several columns."""
    lows = [F.min(c) for c in columns]
    highs = [F.max(c) for c in columns]
    return (lows[0], highs[0]) if len(columns) == 1 else (F.least(*lows), F.greatest(*highs))


def power_sums(y: Column, x: Column) -> Column:
    """Struct of the sums a quadratic fit needs, over rows with both values.

    Pass ``x`` already centred near its mean: fourth powers of uncentred values
    lose the digits the fit depends on.
    """
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    return F.struct(
        F.count(xx).cast("double").alias("n"),
        F.sum(xx).alias("s1"),
        F.sum(xx * xx).alias("s2"),
        F.sum(xx * xx * xx).alias("s3"),
        F.sum(xx * xx * xx * xx).alias("s4"),
        F.sum(yy).alias("t0"),
        F.sum(xx * yy).alias("t1"),
        F.sum(xx * xx * yy).alias("t2"),
    )


def quadratic_from_sums(s: Column, center: Column) -> Column:
    """Coefficients of q2*x^2 + q1*x + q0 from power sums of (x - center).

    Solves the 3x3 normal equations by determinants; a singular system gives
    null coefficients.
    """
    n, s1, s2, s3, s4 = (s[k] for k in ("n", "s1", "s2", "s3", "s4"))
    t0, t1, t2 = s["t0"], s["t1"], s["t2"]

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = F.nullif(det(s4, s3, s2, s3, s2, s1, s2, s1, n), F.lit(0.0))
    a = det(t2, s3, s2, t1, s2, s1, t0, s1, n) / whole
    b = det(s4, t2, s2, s3, t1, s1, s2, t0, n) / whole
    c = det(s4, s3, t2, s3, s2, t1, s2, s1, t0) / whole
    return F.struct(
        a.alias("q2"),
        (b - 2.0 * a * center).alias("q1"),
        (c - b * center + a * center * center).alias("q0"),
    )


def _quadrature(step: float = 1 / 16, low: float = -4.5, high: float = 4.2) -> list[tuple[float, float]]:
    """Nodes and weights of a double-exponential rule for integrals of exp(-w) f(w) over w > 0."""
    rule = []
    for k in range(round(low / step), round(high / step) + 1):
        u = k * step
        w = math.exp(u - math.exp(-u))
        rule.append((w, step * w * (1 + math.exp(-u)) * math.exp(-w)))
    return rule


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t: the regularised incomplete beta function I_x(a, 1/2).

    With a = dof / 2 and x = dof / (dof + t^2) it equals x^a / (a B(a, 1/2)) times the integral of
    exp(-w) (1 - x exp(-w / a))^(-1/2) over w > 0, taken by a fixed rule, so a group costs the same at any
    number of rows. Null where there are no degrees of freedom.
    """
    a = dof.cast("double") / 2
    log_x = -F.log1p(t * t / (2 * a))
    nodes, weights = (F.expr(f"array({', '.join(f'{v!r}D' for v in part)})") for part in zip(*_quadrature()))
    terms = F.zip_with(weights, nodes, lambda c, w: c / F.sqrt(-F.expm1(log_x - w / a)))
    integral = F.aggregate(terms, F.lit(0.0), lambda total, v: total + v)
    # ln(gamma(a + 1/2) / gamma(a)): raised to z = a + 16, where a few terms are exact
    z = a + 16
    ratio = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * z**3) - 1 / (640 * z**5) + 17 / (14336 * z**7)
    for i in range(16):
        ratio = ratio + F.log1p(-0.5 / (a + i + 0.5))
    log_beta = 0.5 * math.log(math.pi) - ratio
    p = F.exp(a * log_x - log_beta) / a * integral
    return F.when(dof > 0, F.when(t.isNotNull(), F.least(p, F.lit(1.0))))

"""Imputation, compensation and calibration with fitted parameters.

Fits return a one-row DataFrame. Applying one reads it as a scalar subquery: Spark
runs the fit once, puts its row into the expression as a constant, and no join is
planned. A fitted row collected to a mapping can be passed instead, which fixes the
parameters when many jobs use them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerocal.config import Compensation, TargetSpec
from aerocal.functions import affine, any_present, compensate_ozone, masked, two_point_scale
from aerocal.operators.orderstat import exact_medians
from aerocal.operators.timeaxis import null_safe_join

Params = DataFrame | Mapping[str, float]


def collect_params(params: DataFrame) -> dict[str, float]:
    """The single row of a fit as a mapping."""
    return params.first().asDict()


def _bind(df: DataFrame, params: Params):
    """The table with its parameters in reach, and how to name one.

    The fitted row enters as a single struct column, so its subquery appears once in
    the plan however often the parameters are used.
    """
    if isinstance(params, DataFrame):
        row = params.select(F.struct(*params.columns)).scalar()
        return df.withColumn("_params", row), lambda name: F.col("_params")[name]
    return df, lambda name: F.lit(params[name]).cast("double")


def impute(df: DataFrame, columns: Sequence[str], medians: Params) -> DataFrame:
    """Fill nulls with fitted medians."""
    bound, at = _bind(df, medians)
    filled = bound.withColumns({c: F.coalesce(F.col(c), at(c)) for c in columns})
    return filled.select(*df.columns)


def two_point_calibrate(
    df: DataFrame, raw: str, reference: str, out: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Map the range of ``raw`` onto the range of ``reference``, over all rows or per key."""
    ends = [
        F.min(raw).alias("_raw_low"),
        F.max(raw).alias("_raw_high"),
        F.min(reference).alias("_ref_low"),
        F.max(reference).alias("_ref_high"),
    ]
    if keys:
        wide = null_safe_join(df, df.groupBy(*keys).agg(*ends), list(keys))
        at = F.col
    else:
        wide, at = _bind(df, df.agg(*ends))
    value = two_point_scale(
        F.col(raw), at("_raw_low"), at("_raw_high"), at("_ref_low"), at("_ref_high")
    )
    return wide.withColumn(out, value).select(*df.columns, out)


def _compensated(features: Sequence[str], at, k: Compensation) -> Column:
    signal, temp, rh = [F.coalesce(F.col(c), at(c)) for c in features]
    return compensate_ozone(signal, temp, rh, k)


def fit_compensated_baseline(
    train: DataFrame,
    spec: TargetSpec,
    k: Compensation = Compensation(),
) -> DataFrame:
    """Medians of the raw features, then label = alpha + beta * compensated signal.

    ``train`` holds training rows with a label. One row: the medians under the
    feature names, ``alpha`` and ``beta``.
    """
    medians = exact_medians(train, spec.features)
    bound, at = _bind(train, medians)
    pairs = bound.select(
        F.col(spec.label).alias("_y"), _compensated(spec.features, at, k).alias("_x"), "_params"
    )
    # The medians are constant over the rows, so any aggregate of them carries them on.
    return pairs.agg(
        *[F.max(at(c)).alias(c) for c in spec.features],
        F.regr_intercept("_y", "_x").alias("alpha"),
        F.regr_slope("_y", "_x").alias("beta"),
    )


def apply_compensated_baseline(
    df: DataFrame,
    spec: TargetSpec,
    params: Params,
    out: str = "y_baseline",
    k: Compensation = Compensation(),
    everywhere: bool = False,
) -> DataFrame:
    """Baseline where any raw feature is present; gaps take the fitted medians.

    ``everywhere`` also scores rows without any feature, from the medians alone, as
    a model that imputes does with the rows it is trained and tested on.
    """
    bound, at = _bind(df, params)
    value = affine(_compensated(spec.features, at, k), at("alpha"), at("beta"))
    value = value if everywhere else masked(any_present(spec.features), value)
    return bound.withColumn(out, value).select(*[c for c in df.columns if c != out], out)


def residual(df: DataFrame, label: str, baseline: str = "y_baseline", out: str = "residual") -> DataFrame:
    return df.withColumn(out, F.col(label) - F.col(baseline))


def recombine(baseline: str, residual_hat: str) -> Column:
    return F.col(baseline) + F.col(residual_hat)

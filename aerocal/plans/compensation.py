"""Compensation study: one sensor against one reference station."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.functions import compensate_ozone, within_time
from aerocal.operators.align import align_by_position, compare_sources
from aerocal.operators.calibrate import two_point_calibrate
from aerocal.operators.evaluate import correlation, error_analysis, pearson_test, stage_errors
from aerocal.operators.timeaxis import interpolate

# The study period, both ends inclusive.
PERIOD = ("2023-03-07 15:01:00", "2023-04-04 14:47:00")


@dataclass(frozen=True)
class CompensationStudy:
    aligned: DataFrame  # ts, o3_ref, o3, temp, rh, compensated, calibrated
    initial: DataFrame  # r, n of the raw signal
    errors: DataFrame  # stage, mae, mape, rmse
    analysis: DataFrame  # eight error fits
    sources: DataFrame  # ts, variable, source, value


def compensation_study(
    reference: DataFrame,
    met: DataFrame,
    sensor: DataFrame,
    period: tuple[str, str] = PERIOD,
    align: str = "time",
) -> CompensationStudy:
    """Inputs are hourly grids, as the readers return them.

    Gaps are interpolated by position, the sensor is cut to the period, and the two
    series meet by time, or row by row with ``align='position'``.
    """
    ref = interpolate(reference, ["o3"], ["station_id"])
    weather = interpolate(met, ["rh", "temp"], ["station_id"])
    cut = sensor.where(within_time(F.col("ts"), *period))
    cut = interpolate(cut, ["o3", "temp", "rh"], ["sensor_id"])

    target = ref.select("ts", F.col("o3").alias("o3_ref"))
    signals = cut.select("ts", "o3", "temp", "rh")
    if align == "position":
        pairs = align_by_position(target, signals)
    else:
        pairs = target.join(signals, "ts")
    pairs = pairs.withColumn("compensated", compensate_ozone(F.col("o3"), F.col("temp"), F.col("rh")))
    pairs = two_point_calibrate(pairs, "compensated", "o3_ref", "calibrated")

    stages = {"raw": "o3", "compensated": "compensated", "calibrated": "calibrated"}
    return CompensationStudy(
        aligned=pairs,
        initial=correlation(pairs, "o3_ref", "o3"),
        errors=stage_errors(pairs, "o3_ref", stages),
        analysis=error_analysis(pairs, "o3_ref", "o3", {"temp": "temp", "rh": "rh"}),
        sources=compare_sources(
            {"reference": ref, "met": weather, "sensor": cut},
            {
                "temperature": {"met": "temp", "sensor": "temp"},
                "humidity": {"met": "rh", "sensor": "rh"},
                "ozone": {"reference": "o3", "sensor": "o3"},
            },
        ),
    )


def stage_tests(study: CompensationStudy) -> dict[str, DataFrame]:
    """Line, r, t and p of each stage on the reference; one job per stage."""
    return {
        stage: pearson_test(study.aligned, "o3_ref", column)
        for stage, column in (("raw", "o3"), ("compensated", "compensated"), ("calibrated", "calibrated"))
    }

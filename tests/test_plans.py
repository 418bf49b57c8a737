import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerocal.config import ForestParams, target_spec
from aerocal.plans.compensation import compensation_study, stage_tests
from aerocal.plans.fusion import fuse_sensor, hourly_sensor, score_full_period, train_first_models
from aerocal.session import materialise, shared_folder
from tests.conftest import column

T0 = dt.datetime(2025, 3, 1)
REPORT = "sensor_id string, ts timestamp_ntz, O3_lcs_ppb double, Carbon_Monoxide double, Temp_lcs double, RH_lcs double"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_hourly_sensor(spark):
    rows = [
        ("s", at(10), 4.0, 1000.0, 20.0, 50.0),
        ("s", at(10), 2.0, 1000.0, 20.0, 50.0),  # same time: the smaller row stays
        ("s", at(20), 6.0, 3000.0, 99.0, 50.0),  # temperature outlier, interpolated to 22
        ("s", at(30), 7.0, None, 24.0, None),
        ("s", at(150), 9.0, 500.0, -50.0, 40.0),  # outlier at the end takes the last value
        ("s", None, 100.0, 1.0, 1.0, 1.0),
    ]
    out = hourly_sensor(spark.createDataFrame(rows, REPORT))
    assert column(out, "O3_lcs_ppb") == [5.0, None, 9.0]
    assert column(out, "Temp_lcs") == [22.0, None, 24.0]
    assert column(out, "CO_lcs_ppm") == [2.0, None, 0.5]


def test_report_without_carbon_monoxide(spark):
    df = spark.createDataFrame([("s", at(0), 1.0, None, 20.0, 1.0)], REPORT).drop("Carbon_Monoxide")
    assert hourly_sensor(df).first()["CO_lcs_ppm"] is None


def test_fusion_with_several_stations(spark):
    report = spark.createDataFrame([(s, at(5), 1.0, None, 20.0, 1.0) for s in ("s1", "s2")], REPORT)
    rows = [("A", at(0), 10.0), ("A", at(0), 99.0), ("B", at(0), 20.0)]
    ref = spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, O3_ref double")
    where = spark.createDataFrame([("s1", "A"), ("s2", "B")], "sensor_id string, station_id string")
    got = {r.sensor_id: r.O3_ref for r in fuse_sensor(report, ref, where).collect()}
    assert got == {"s1": 10.0, "s2": 20.0}
    assert fuse_sensor(report, ref.where("station_id = 'A'")).where("O3_ref = 10").count() == 2


def test_first_models(spark):
    rng = np.random.default_rng(4)
    rows = []
    for day in range(153):
        for hour in range(0, 24, 3):
            x, t, h = rng.uniform(5, 90), rng.normal(20, 4), rng.normal(55, 10)
            y = 0.7 * x + 0.4 * t - 0.1 * h + 12 * math.sin(x / 8) + rng.normal(0, 1)
            rows.append(("s", T0 + dt.timedelta(days=day, hours=hour), x, t, h if hour else None, y))
    schema = "sensor_id string, ts timestamp_ntz, O3_lcs_ppb double, Temp_lcs double, RH_lcs double, O3_ref double"
    fused = spark.createDataFrame(rows, schema)
    spec = target_spec("O3")
    got = train_first_models(fused, spec, forest=ForestParams(trees=20, max_depth=10, max_bins=64))
    assert got.best == "forest" and got.best_model is got.forest
    assert train_first_models(fused, spec, forest=ForestParams(trees=3, max_depth=3), pin="linear").best == "linear"
    assert got.metrics.count() == 4
    scored = score_full_period(fused, spec, got.linear, got.forest)
    assert scored.where("O3_ml_cal IS NULL").count() == fused.where("RH_lcs IS NULL").count()
    with pytest.raises(ValueError, match="missing"):
        train_first_models(fused.drop("RH_lcs"), spec)


@pytest.fixture()
def study_inputs(spark):
    rng = np.random.default_rng(8)
    start = dt.datetime(2023, 3, 7, 16)
    hours = [start + dt.timedelta(hours=i) for i in range(200)]
    temp, rh = rng.normal(20, 3, 200), rng.normal(50, 8, 200)
    ref = rng.uniform(5, 80, 200)
    raw = 1.451 * (ref - (0.1034 * temp**2 - 2.225 * temp + 0.01223 * rh**2 - 1.984 * rh + 79))

    def frame(columns, values, key):
        rows = [("k", t, *[None if i in (3, 77) else float(c[i]) for c in values]) for i, t in enumerate(hours)]
        return spark.createDataFrame(rows, f"{key} string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))

    return (
        frame(["co", "o3"], [ref, ref], "station_id"),
        frame(["rh", "temp"], [rh, temp], "station_id"),
        frame(["o3", "temp", "rh"], [raw, temp, rh], "sensor_id"),
    )


@pytest.mark.parametrize("align", ["time", "position"])
def test_compensation_study(study_inputs, align):
    study = compensation_study(*study_inputs, align=align)
    assert study.aligned.count() == 200
    errors = {r.stage: r for r in study.errors.collect()}
    assert errors["compensated"].mae < 2 < errors["raw"].mae
    ends = study.aligned.agg(F.min("o3_ref"), F.min("calibrated"), F.max("o3_ref"), F.max("calibrated")).first()
    assert ends[0] == pytest.approx(ends[1]) and ends[2] == pytest.approx(ends[3])
    assert study.analysis.count() == 4
    tests = stage_tests(study)
    assert tests["compensated"].first()["r"] > 0.98 > abs(study.initial.first()["r"])
    sources = study.sources.groupBy("variable", "source").agg(F.count("*").alias("n"), F.count("value").alias("v")).collect()
    assert len(sources) == 6 and {(r.n, r.v) for r in sources} == {(200, 200)}


def test_shared_folder_comes_from_the_session(spark):
    folder = shared_folder(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder == configured
    df = spark.range(5)
    assert materialise(df).orderBy("id").collect() == df.collect()

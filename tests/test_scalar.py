import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerocal import functions as fn
from aerocal.config import SplitSpec, target_spec


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "day, hour, year, expected",
    [
        ("31/07/25", "24", 2025, dt.datetime(2025, 8, 1)),
        ("01/03/25", "1", 2025, dt.datetime(2025, 3, 1, 1)),
        ("01/03/24", "5", 2025, dt.datetime(2025, 3, 1, 5)),
        ("31/12/23", "24", None, dt.datetime(2024, 1, 1)),
        ("01/03/75", "2", None, dt.datetime(1975, 3, 1, 2)),
        ("01/03/25", "x", 2025, None),
        ("29/02/24", "3", 2025, None),
        ("Fecha", "Hora", 2025, None),
    ],
)
def test_compose_timestamp(spark, day, hour, year, expected):
    assert one(spark, fn.compose_timestamp(F.col("d"), F.col("h"), year), d=day, h=hour) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("nr", None), ("NR", None), ("Na", None), ("NA", None), ("", None), ("1.27", 1.27),
     (" -3 ", -3.0), ("1e2", 100.0), ("1.5d", None), ("Infinity", None), ("NaN", None), ("a1", None)],
)
def test_clean_number(spark, text, expected):
    assert one(spark, fn.clean_number(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("05/03/25 14:30", dt.datetime(2025, 3, 5, 14, 30)),
        ("5/3/25 4:05", dt.datetime(2025, 3, 5, 4, 5)),
        ("05/03/2025 14:30", None),
        ("31/02/25 10:00", None),
        ("junk", None),
    ],
)
def test_parse_strict(spark, text, expected):
    assert one(spark, fn.parse_day_first(F.col("t"), strict=True), t=text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2023-03-07 15:01:00", dt.datetime(2023, 3, 7, 15, 1)),
        ("03/07/2023 15:01", dt.datetime(2023, 3, 7, 15, 1)),
        ("13/03/2023 15:01", dt.datetime(2023, 3, 13, 15, 1)),
    ],
)
def test_parse_mixed(spark, text, expected):
    assert one(spark, fn.parse_mixed(F.col("t")), t=text) == expected


def test_shift_and_slice(spark):
    shifted = fn.shift_hours(fn.parse_day_first(F.col("t")), 1)
    assert one(spark, shifted, t="07/03/2023 23:30:00") == dt.datetime(2023, 3, 8, 0, 30)
    inside = fn.within_time(F.col("t").try_cast("timestamp_ntz"), "2023-01-01 00:00:00", "2023-01-02 00:00:00")
    assert one(spark, inside, t="2023-01-02 00:00:00") is True
    assert one(spark, inside, t="2023-01-02 00:00:01") is False


@pytest.mark.parametrize("value, kept", [(-10.0, True), (40.0, True), (-10.1, False), (40.1, False)])
def test_outlier_bounds(spark, value, kept):
    assert one(spark, fn.mask_outside(F.col("v")), v=value) == (value if kept else None)


def test_compensation(spark):
    got = one(spark, fn.compensate_ozone(F.col("o"), F.col("t"), F.col("h")), o=14.51, t=20.0, h=50.0)
    assert got == pytest.approx(17.235)
    null = F.lit(None).cast("double")
    assert one(spark, fn.compensate_ozone(null, F.col("t"), F.col("t")), t=1.0) is None


def test_percent_error_zero_reference(spark):
    assert one(spark, fn.percent_error(F.col("r"), F.col("m")), r=0.0, m=1.0) is None
    assert one(spark, fn.percent_error(F.col("r"), F.col("m")), r=10.0, m=9.0) == pytest.approx(10.0)


def test_month_names_and_split(spark):
    assert one(spark, fn.month_number(F.col("m")), m=" Marzo ") == "03"
    assert one(spark, fn.month_number(F.col("m")), m="march") is None
    ts = F.col("t").try_cast("timestamp_ntz")
    for text, want in (("2025-06-30", "train"), ("2025-07-01", "test"), ("2025-08-01", None), ("2024-03-01", "train")):
        assert one(spark, fn.split_label(ts), t=text) == want
    assert one(spark, fn.split_label(ts, SplitSpec(year=2025)), t="2024-03-01") is None


def test_presence(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    assert df.where(fn.all_present(["a", "b"])).count() == 1
    assert df.where(fn.any_present(["a", "b"])).count() == 2
    assert [r.m for r in df.select(fn.masked(fn.all_present(["a", "b"]), F.lit(7)).alias("m")).collect()] == [None, None, 7]


def test_targets():
    assert target_spec("o3").baseline == "compensated"
    assert target_spec("CO").features[0] == "CO_lcs_ppm"
    with pytest.raises(ValueError):
        target_spec("NO2")

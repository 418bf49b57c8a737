"""Full-period exports on rows built here: one row per station and day, none summed up."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry_point

_DAY = dt.datetime(2001, 3, 1)


def _lineitem(spark, folder):
    """Two stations; the first misses days, the second has one reading a day, some without temperature."""
    rows = []
    for sensor, days in ((1, [d for d in range(150) if d % 7]), (2, range(150))):
        for d in days:
            price = 1000.0 * (20 + 9 * math.sin(d + sensor))
            quantity = 45.0 if d % 11 == 0 else 10.0 + d % 17
            rows.append((sensor, _DAY + dt.timedelta(days=d), price, quantity, (d * 3 % 10) / 100))
    schema = "l_suppkey bigint, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double, l_discount double"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")


def _check(spark, tmp_path, name):
    _lineitem(spark, tmp_path)
    got = [tuple(row) for row in entry_point.queries()[name](spark, str(tmp_path)).select("sensor_id", "ts", "O3_baseline_cal").collect()]
    assert len(got) == len(set(got)) == 149 + 150
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.execute(f"SELECT sensor_id, ts, O3_baseline_cal FROM ({entry_point.oracle_sql()[name]})").fetchall()
    assert [(x[0], x[1], x[2] is None) for x in sorted(got, key=lambda x: x[:2])] == [
        (x[0], x[1], x[2] is None) for x in sorted(want, key=lambda x: x[:2])
    ]
    values = {x[:2]: x[2] for x in want if x[2] is not None}
    assert {x[:2]: x[2] for x in got if x[2] is not None} == pytest.approx(values, abs=1e-4)
    gap = (1, (_DAY + dt.timedelta(days=7)).strftime("%Y-%m-%d %H:%M:%S"))
    assert gap not in values and gap in {x[:2] for x in got}


def test_full_period_linear_has_every_row(spark, tmp_path):
    _check(spark, tmp_path, "full_period_linear")


def test_full_period_baseline_has_every_row(spark, tmp_path):
    _check(spark, tmp_path, "full_period_baseline")

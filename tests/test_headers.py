"""Files of one glob with headers of their own."""

import pytest
from pyspark.sql import functions as F

from aerocal.sources import read_met_station, read_sensor_report


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_columns_are_found_by_each_files_header(spark, tmp_path):
    put(tmp_path, "s1.csv", "Timestamp,Ozone,Temperature\n01/02/24 03:04,5,20\n\nbad,6,21\n")
    put(tmp_path, "s2.csv", "\ufeffTemperature, Ozone ,Note,Timestamp\n30,\"1.5\",\"a,b\",02/02/24 03:04\n31,,c,03/02/24 03:04\n")
    put(tmp_path, "s3.csv", "4,5,6\n")  # no header: its rows are told by a null time
    sensor = F.regexp_extract("path", "([^/]+)[.]csv$", 1)
    got = read_sensor_report(spark, f"{tmp_path}/*.csv", sensor)
    assert got.columns == ["sensor_id", "ts", "O3_lcs_ppb", "Temp_lcs"]
    rows = {(r.sensor_id, r.ts and r.ts.day, r.O3_lcs_ppb, r.Temp_lcs) for r in got.collect()}
    assert rows == {
        ("s1", 1, 5.0, 20.0), ("s1", None, 6.0, 21.0), ("s2", 2, 1.5, 30.0), ("s2", 3, None, 31.0), ("s3", None, None, None)
    }


def test_no_header_anywhere_is_an_error(spark, tmp_path):
    put(tmp_path, "a.csv", "1,2,3\n")
    with pytest.raises(ValueError, match="Timestamp"):
        read_sensor_report(spark, f"{tmp_path}/*.csv", "s")


def test_absent_columns_are_null(spark, tmp_path):
    put(tmp_path, "m.csv", "RH_Avg,TIMESTAMP\n40,2024-01-01 00:10:00\n")
    (row,) = read_met_station(spark, f"{tmp_path}/*.csv", "M").collect()
    assert (row.station_id, row.rh, row.temp) == ("M", 40.0, None)

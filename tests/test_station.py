import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerocal.plans.station import audit, combine_months, normalise_station, write_station
from aerocal.sinks import range_label
from aerocal.sources import (
    file_report,
    missing_files,
    read_hourly_station,
    read_met_station,
    read_sensor_2023,
    read_sensor_report,
    read_station_files,
    read_station_table,
    station_readings,
)
from aerocal.sources.station import require_months, require_usable
from aerocal.sources.tables import unparsed_times
from tests.conftest import column


def export(folder, name, lines, header="Fecha,Hora,EST", title="CO ppm,,"):
    text = "\r\n".join([title, header, *lines]) + "\r\n"
    (folder / f"hourly means of {name}.csv").write_bytes(text.encode("latin-1"))


@pytest.fixture()
def exports(tmp_path):
    export(tmp_path, "co-marzo", ["31/03/25,22,0.5", "31/03/25,23,nr", "31/03/25,24,0.7"])
    export(tmp_path, "o3-marzo", ["31/03/25,22,10", "31/03/25,24,12"], title="O3 ppb medición,,")
    export(tmp_path, "co-abril", ["01/04/25,1,0.9", "01/04/25,x,1", "zz,2,1", "31/03/25,24,9.9"], title="CO pmm,,")
    return tmp_path


MONTHS = ["marzo", "abril"]


def test_exports_become_one_table(spark, exports):
    got = normalise_station(spark, f"{exports}/*.csv", "EST", 2025, MONTHS)
    rows = {r.ts: (r.CO_ref, r.O3_ref, r.RH_ref) for r in got.combined.collect()}
    assert rows == {
        dt.datetime(2025, 3, 31, 22): (0.5, 10.0, None),
        dt.datetime(2025, 3, 31, 23): (None, None, None),
        dt.datetime(2025, 4, 1, 0): (0.7, 12.0, None),  # the March file wins over the April one
        dt.datetime(2025, 4, 1, 1): (0.9, None, None),
    }
    assert got.monthly.count() == 5
    assert {(r.day_text, r.hour_text) for r in got.quarantine.collect()} == {("01/04/25", "x"), ("zz", "2")}
    assert {(r.variable, r.month_name) for r in got.missing.collect()} == {
        ("rh", "marzo"), ("tmp", "marzo"), ("o3", "abril"), ("rh", "abril"), ("tmp", "abril")}


def test_column_order_and_other_stations(spark, tmp_path):
    export(tmp_path, "o3-junio", ["01/06/25,7,5,1", "01/06/25,,6,2"], header="Fecha,OTRA, EST ,Hora", title="O3")
    got = normalise_station(spark, f"{tmp_path}/*.csv", "EST", 2025, ["junio"])
    assert column(got.combined, "O3_ref") == [5.0, 6.0]


def test_unusable_files_are_reported(spark, exports):
    export(exports, "rh-marzo", ["01/03/25,1,5"], header="Dia,Hora,EST")
    export(exports, "rh-abril", ["01/04/25,1,5"], header="fecha,Hora,EST")
    raw = read_station_files(spark, f"{exports}/*.csv")
    report = file_report(raw, "EST")
    status = {(r.variable, r.month_name): r.status for r in report.collect()}
    assert status["rh", "marzo"] == "no_header" and status["rh", "abril"] == "bad_columns"
    assert status["co", "marzo"] == "ok"
    with pytest.raises(ValueError, match="no_header|bad_columns"):
        require_usable(report)
    readings, _ = station_readings(raw, "EST", 2025, report)
    assert "rh" not in {r.variable for r in readings.select("variable").distinct().collect()}


def test_month_without_files_is_an_error(spark, exports):
    raw = read_station_files(spark, f"{exports}/*.csv")
    require_months(missing_files(raw, MONTHS))
    with pytest.raises(FileNotFoundError, match="mayo"):
        require_months(missing_files(raw, [*MONTHS, "mayo"]))
    with pytest.raises(FileNotFoundError):
        normalise_station(spark, f"{exports}/*.csv", "EST", 2025, [*MONTHS, "mayo"], strict=True)


def test_written_tables_read_back(spark, exports, tmp_path):
    got = normalise_station(spark, f"{exports}/*.csv", "EST", 2025, MONTHS)
    paths = write_station(got, str(tmp_path / "out"), 2025, MONTHS, fmt="parquet")
    assert paths["combined"].endswith("2025-03_04")
    back = read_station_table(spark, paths["combined"], "EST", fmt="parquet")
    assert sorted(back.collect()) == sorted(got.combined.collect())
    # Hour 24 of the last day stays in its file's month.
    march = spark.read.parquet(f"{paths['monthly']}/year=2025/month=03")
    assert march.agg(F.max("ts")).first()[0] == dt.datetime(2025, 4, 1)
    assert range_label(2025, ["julio", "marzo"]) == "2025-03_07"


def test_audit(spark, exports):
    table = normalise_station(spark, f"{exports}/*.csv", "EST", 2025, MONTHS).combined
    total, by_month = audit(table)
    assert {r.variable: r.coverage for r in total.collect()} == {"CO_ref": 75.0, "O3_ref": 50.0, "RH_ref": 0.0, "Temp_ref": 0.0}
    assert [tuple(r) for r in by_month.orderBy("month").collect()] == [
        ("2025-03", 50.0, 50.0, 0.0, 0.0), ("2025-04", 100.0, 50.0, 0.0, 0.0)]


def test_overlap_order_follows_the_month_list(spark, exports):
    monthly = normalise_station(spark, f"{exports}/*.csv", "EST", 2025, MONTHS).monthly
    other = combine_months(monthly, ["abril", "marzo"])
    assert other.where("ts = '2025-04-01 00:00:00'").first()["CO_ref"] == 9.9


def test_table_readers(spark, tmp_path):
    (tmp_path / "hourly.csv").write_text("Fecha,Hora,ccaco,ccao3,ccapm2\r\n2023-03-07,16,0.45,83.000,3\r\n2023-03-07,24,,,\r\n")
    hourly = read_hourly_station(spark, str(tmp_path / "hourly.csv"), "C")
    assert [(r.ts, r.co, r.o3) for r in hourly.collect()] == [
        (dt.datetime(2023, 3, 7, 16), 0.45, 83.0), (dt.datetime(2023, 3, 8), None, None)]

    (tmp_path / "met.csv").write_text("TIMESTAMP,Temp_Avg,RH_Avg\n2023-03-01 00:10:00,10,50\n03/01/2023 00:20,12,NaN\n2023-03-01 02:00:00,14,40\n")
    met = read_met_station(spark, str(tmp_path / "met.csv"), "M").orderBy("ts").collect()
    assert [(r.temp, r.rh) for r in met] == [(11.0, 50.0), (None, None), (14.0, 40.0)]

    (tmp_path / "sensor.csv").write_text("Timestamp,Ozone_Data,Temperature_Data,Relative_Humidity_Data\n07/03/2023 15:30:00,1,2,3\n07/03/2023 15:40:00,3,2,3\n")
    sensor = read_sensor_2023(spark, str(tmp_path / "sensor.csv"), "S").collect()
    assert [(r.ts, r.o3) for r in sensor] == [(dt.datetime(2023, 3, 7, 16), 2.0)]


def test_sensor_report_reader(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Timestamp,Ozone,Temperature,Relative_Humidity,PM2.5,PM10*\n01/03/25 00:10,5,20,50,1,2\nbad,5,20,50,1,2\n")
    report = read_sensor_report(spark, str(tmp_path / "r.csv"), "S")
    assert report.columns == ["sensor_id", "ts", "O3_lcs_ppb", "Temp_lcs", "RH_lcs", "PM2_5", "PM10"]
    assert report.where("ts IS NULL").count() == 1
    assert unparsed_times(report.withColumn("t", F.lit("bad")), "t", F.col("ts")) == 1

"""Readers for cleaned tables, sensor reports and saved models.

Schemas are explicit. Text that is not a number becomes null, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerocal.config import STATION_VARIABLES
from aerocal.functions import (
    clean_number,
    date_plus_hours,
    mask_outside,
    parse_day_first,
    parse_mixed,
    shift_hours,
)
from aerocal.operators.timeaxis import resample
from aerocal.session import materialise
from aerocal.sources.station import BROADCAST_FILES


def _ident(ident: str | Column) -> Column:
    """A name, or an expression over ``path`` and the cells, such as a part of the file's name."""
    return ident if isinstance(ident, Column) else F.lit(ident)


def _read_text_columns(
    spark: SparkSession, paths: str | Sequence[str], names: Sequence[str], known_only: bool = False
) -> DataFrame:
    """Named CSV cells as text, and ``path``; null where a file lacks the column.

    With ``known_only``, columns that no file has are left out. Every file is read by its own header, the line with a cell ``names[0]``, so files of one glob may
    differ in column order and number. One pass finds the headers, a row per file; they are joined back
    to the lines by path, as broadcast up to ``BROADCAST_FILES`` files. Lines of a file without a header
    have null cells, so they count as unparsed; if no file has one, that is an error.
    """
    lines = (
        spark.read.text(paths)
        .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
        .where(F.btrim("line") != "")
    )
    cells = F.transform(F.split("line", ","), lambda c: F.btrim(c, F.lit('" \ufeff')))
    is_head = F.col("line").contains(names[0]) & F.array_contains(cells, names[0])
    at = [F.max(F.nullif(F.array_position(cells, n), F.lit(0)).cast("int")).alias(f"at{i}") for i, n in enumerate(names)]
    heads = materialise(
        lines.where(is_head).groupBy("path").agg(F.max(F.size(cells)).alias("width"), *at), "headers"
    )
    seen = heads.agg(
        F.count(F.lit(1)).alias("files"), F.max("width").alias("width"), *[F.max(f"at{i}").alias(f"at{i}") for i in range(len(names))]
    ).first()
    if not seen.files and not lines.isEmpty():
        raise ValueError(f"no file has a header with {names[0]}")
    width = seen.width or 1
    kinds = ", ".join(f"c{i} string" for i in range(width))
    few = seen.files <= BROADCAST_FILES
    rows = lines.where(~is_head).join(F.broadcast(heads) if few else heads, "path", "left")
    found = rows.withColumn("cell", F.from_csv("line", kinds)).withColumn(
        "cell", F.array(*[F.col(f"cell.c{i}") for i in range(width)])
    )
    return found.select(
        "path",
        *[
            F.try_element_at("cell", F.col(f"at{i}")).alias(n)
            for i, n in enumerate(names)
            if not known_only or seen[f"at{i}"]
        ],
    )


def read_station_table(
    spark: SparkSession, paths: str | Sequence[str], station: str | Column, fmt: str = "csv"
) -> DataFrame:
    """Cleaned hourly station table: ``station_id, ts, <variable columns>``."""
    values = list(STATION_VARIABLES.values())
    if fmt == "parquet":
        df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
        if "station_id" not in df.columns:
            df = df.withColumn("station_id", _ident(station))
        have = [c for c in values if c in df.columns]
        return df.select("station_id", "ts", *have)
    text = _read_text_columns(spark, paths, ["Timestamp", *values])
    return text.select(
        _ident(station).alias("station_id"),
        F.col("Timestamp").try_cast("timestamp_ntz").alias("ts"),
        *[clean_number(F.col(c)).alias(c) for c in values],
    )


# Report columns and the names used from here on.
SENSOR_COLUMNS = {
    "Ozone": "O3_lcs_ppb",
    "Carbon_Monoxide": "Carbon_Monoxide",
    "Temperature": "Temp_lcs",
    "Relative_Humidity": "RH_lcs",
    "PM2.5": "PM2_5",
    "PM10*": "PM10",
}


def read_sensor_report(spark: SparkSession, paths: str | Sequence[str], sensor: str | Column) -> DataFrame:
    """Raw sensor reports: ``sensor_id, ts`` and renamed readings.

    ``sensor`` is one name, or an expression over ``path`` that tells the sensor of each file.

    Rows whose time does not parse keep a null ``ts``; resampling drops them.
    """
    # Columns no report has are left out, not invented.
    text = _read_text_columns(spark, paths, ["Timestamp", *SENSOR_COLUMNS], known_only=True)
    return text.select(
        _ident(sensor).alias("sensor_id"),
        parse_day_first(F.col("Timestamp"), strict=True).alias("ts"),
        *[clean_number(F.col(f"`{s}`")).alias(d) for s, d in SENSOR_COLUMNS.items() if s in text.columns],
    )


def mask_temperature(df: DataFrame, column: str = "Temp_lcs") -> DataFrame:
    return df.withColumn(column, mask_outside(F.col(column)))


def read_hourly_station(spark: SparkSession, paths: str | Sequence[str], station: str | Column) -> DataFrame:
    """Station table with an ISO date and an hour: ``station_id, ts, co, o3, pm2``."""
    text = _read_text_columns(spark, paths, ["Fecha", "Hora", "ccaco", "ccao3", "ccapm2"])
    return text.select(
        _ident(station).alias("station_id"),
        date_plus_hours(
            F.col("Fecha").try_cast("timestamp_ntz"), F.trim("Hora").try_cast("int")
        ).alias("ts"),
        clean_number(F.col("ccaco")).alias("co"),
        clean_number(F.col("ccao3")).alias("o3"),
        clean_number(F.col("ccapm2")).alias("pm2"),
    )


def read_met_station(spark: SparkSession, paths: str | Sequence[str], station: str | Column) -> DataFrame:
    """Meteorological station with mixed time formats, as an hourly grid of ``rh, temp``."""
    text = _read_text_columns(spark, paths, ["TIMESTAMP", "RH_Avg", "Temp_Avg"])
    rows = text.select(
        _ident(station).alias("station_id"),
        parse_mixed(F.col("TIMESTAMP")).alias("ts"),
        clean_number(F.col("RH_Avg")).alias("rh"),
        clean_number(F.col("Temp_Avg")).alias("temp"),
    )
    return resample(rows, ["station_id"])


def read_sensor_2023(
    spark: SparkSession, paths: str | Sequence[str], sensor: str | Column, offset_hours: int = 1
) -> DataFrame:
    """Day-first sensor file shifted by its clock offset, as an hourly grid of ``o3, temp, rh``."""
    text = _read_text_columns(
        spark, paths, ["Timestamp", "Ozone_Data", "Temperature_Data", "Relative_Humidity_Data"]
    )
    rows = text.select(
        _ident(sensor).alias("sensor_id"),
        shift_hours(parse_day_first(F.col("Timestamp")), offset_hours).alias("ts"),
        clean_number(F.col("Ozone_Data")).alias("o3"),
        clean_number(F.col("Temperature_Data")).alias("temp"),
        clean_number(F.col("Relative_Humidity_Data")).alias("rh"),
    )
    return resample(rows, ["sensor_id"])


def unparsed_times(text: DataFrame, column: str, parsed) -> int:
    """How many rows have a time text that did not parse."""
    return text.where(F.col(column).isNotNull() & parsed.isNull()).count()


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

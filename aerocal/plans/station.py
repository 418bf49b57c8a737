"""Raw station exports to wide hourly tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerocal.config import STATION_VARIABLES
from aerocal.functions import month_label
from aerocal.operators.align import pivot_variables
from aerocal.operators.quality import coverage_by, coverage_total
from aerocal.operators.timeaxis import dedupe_first
from aerocal.sinks import range_label, write_monthly, write_table
from aerocal.sources.station import (
    file_report,
    missing_files,
    month_order,
    read_station_files,
    require_months,
    require_usable,
    station_readings,
)


@dataclass(frozen=True)
class StationTables:
    monthly: DataFrame  # station_id, month (of the source file), ts, one column per variable
    combined: DataFrame  # station_id, ts, one column per variable; unique ts
    quarantine: DataFrame  # rows whose date or hour did not parse
    missing: DataFrame  # expected (variable, month_name) pairs without a file


def normalise_station(
    spark: SparkSession,
    paths: str | Sequence[str],
    station: str,
    year: int,
    months: Sequence[str],
    variables: Mapping[str, str] = STATION_VARIABLES,
    strict: bool = False,
) -> StationTables:
    """Read every file of the glob in one job and shape it to wide tables.

    Unusable files and empty months are left out, or raise when ``strict``.
    """
    raw = read_station_files(spark, paths)
    wanted = F.col("month_name").isin([m.lower() for m in months]) & F.col("variable").isin(list(variables))
    report = file_report(raw, station).where(wanted)
    missing = missing_files(raw, months, variables)
    if strict:
        require_usable(report)
        require_months(missing, variables)
    readings, quarantine = station_readings(raw, station, year, report)
    monthly = wide_by_month(readings, variables)
    return StationTables(monthly, combine_months(monthly, months), quarantine, missing)


def wide_by_month(readings: DataFrame, variables: Mapping[str, str] = STATION_VARIABLES) -> DataFrame:
    return pivot_variables(readings, ["station_id", "month", "ts"], "variable", "value", variables)


def combine_months(monthly: DataFrame, months: Sequence[str]) -> DataFrame:
    """One row per time; where two months' files overlap, the earlier-listed file wins."""
    rank = F.array_position(F.array(*[F.lit(m) for m in month_order(months)]), F.col("month"))
    return dedupe_first(monthly.withColumn("_order", rank), ["station_id", "ts"], ["_order"]).drop(
        "_order", "month"
    )


def write_station(tables: StationTables, folder: str, year: int, months: Sequence[str], fmt: str = "csv") -> dict:
    monthly = write_monthly(tables.monthly, f"{folder}/monthly", year, fmt)
    combined = write_table(tables.combined, f"{folder}/combined_{range_label(year, months)}", fmt)
    return {"monthly": monthly, "combined": combined}


def audit(table: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Coverage percent of the whole table and per calendar month, one decimal."""
    columns = [c for c in (columns or STATION_VARIABLES.values()) if c in table.columns]
    by_month = coverage_by(table, month_label(F.col("ts")).alias("month"), columns)
    return coverage_total(table, columns), by_month

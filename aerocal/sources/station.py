"""Raw station exports: one CSV per variable and month, read in one job.

A file starts with a title row, then the header row ``Fecha,Hora,<station>`` and
one row per hour. The file name ends in ``<variable>-<month name>.csv``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerocal.config import MONTH_NUMBERS, STATION_VARIABLES
from aerocal.functions import clean_number, clean_text, compose_timestamp, month_number

# Up to this many files the per-file table is broadcast to the rows: its size is
# known from the file listing. Beyond it the two are joined by file.
BROADCAST_FILES = 50_000


def read_station_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All lines of a glob with the path they come from: ``line, path``.

    Files may differ in column count and order, so each line is read as one text and
    split later; a schema of fixed width would make every shorter line malformed. What
    a path means is worked out per file, in :func:`list_files`, not per line.
    """
    raw = (
        spark.read.schema("line string")
        .option("encoding", "ISO-8859-1")
        .option("sep", "\u0001")
        .option("quote", "")
        .csv(paths)
    )
    return raw.select("line", _plain(F.col("_metadata.file_path")).alias("path"))


def _plain(path: Column) -> Column:
    """The listing writes ``file:///a`` where the file metadata writes ``file:/a``."""
    return F.replace(path, F.lit("file:///"), F.lit("file:/"))


def list_files(raw: DataFrame) -> DataFrame:
    """One row per path: ``path, file, variable, month_name``, from Spark's file listing.

    An export is one file, or a folder of part files with the file's name.
    """
    paths = raw.sparkSession.createDataFrame([(p,) for p in raw.inputFiles()], "path string")
    file = F.regexp_replace(F.url_decode("path"), r"/part-[^/]*$", "")
    ending = r"([^\s\-/=]+)-([^\s\-./]+)[.][^./]*$"
    return paths.select(_plain(F.col("path")).alias("path"), file.alias("file")).select(
        "path",
        "file",
        F.lower(F.regexp_extract("file", ending, 1)).alias("variable"),
        F.lower(F.regexp_extract("file", ending, 2)).alias("month_name"),
    )


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda c: F.btrim(c, F.lit('" ')))


def file_report(raw: DataFrame, station: str) -> DataFrame:
    """One row per file: where each needed column is, and whether the file is usable.

    A file is ``no_header`` without a row that starts with ``fecha`` in any case, and
    ``bad_columns`` when that row lacks ``Fecha``, ``Hora`` or the station.
    """
    first = F.btrim(F.split("line", ",", 2)[0], F.lit('" '))
    heads = raw.where(clean_text(first) == "fecha").select("path", _cells(F.col("line")).alias("cells"))
    names = {"day": "Fecha", "hour": "Hora", "value": station}
    found = heads.groupBy("path").agg(
        *[F.max(F.array_position("cells", n).cast("int")).alias(k) for k, n in names.items()]
    )
    files = (
        list_files(raw)
        .join(found, "path", "left")
        .groupBy("file", "variable", "month_name")
        .agg(*[F.max(k).alias(k) for k in names])
    )
    absent = (F.col("day") == 0) | (F.col("hour") == 0) | (F.col("value") == 0)
    return files.select(
        "file",
        "variable",
        "month_name",
        F.struct(*names).alias("at"),
        F.when(F.col("day").isNull(), "no_header").when(absent, "bad_columns").otherwise("ok").alias("status"),
    )


def require_usable(report: DataFrame) -> None:
    """Raise with the first few unusable files."""
    bad = report.where(F.col("status") != "ok").select("file", "status").take(5)
    if bad:
        raise ValueError("unusable station files: " + "; ".join(f"{r.file} ({r.status})" for r in bad))


def missing_files(
    raw: DataFrame,
    months: Sequence[str],
    variables: Mapping[str, str] = STATION_VARIABLES,
) -> DataFrame:
    """Expected (variable, month_name) pairs that have no file.

    A missing variable is skipped by the readers; a month with no file at all is the
    caller's error (:func:`require_months`).
    """
    spark = raw.sparkSession
    expected = spark.createDataFrame(
        [(v, m.lower()) for v in variables for m in months], "variable string, month_name string"
    )
    found = list_files(raw).select("variable", "month_name").distinct()
    return expected.join(found, ["variable", "month_name"], "left_anti")


def require_months(missing: DataFrame, variables: Mapping[str, str] = STATION_VARIABLES) -> None:
    """Raise when a month lacks every variable."""
    empty = (
        missing.groupBy("month_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == len(variables))
        .select("month_name")
        .collect()
    )
    if empty:
        raise FileNotFoundError(f"no station files for {sorted(r.month_name for r in empty)}")


def _cell(position: str) -> Column:
    text = F.try_element_at("cells", F.col(position))
    return F.nullif(text, F.lit(""))


def station_readings(
    raw: DataFrame, station: str, year: int | None, report: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Long readings and quarantined rows.

    Readings: ``station_id, variable, month, ts, value`` with ``month`` the two-digit
    number of the source file, not of ``ts``: hour 24 of a month's last day belongs to
    its file but to the next month. Title and header rows fall away. A data row whose
    date or hour does not parse goes to the quarantine with its text.
    """
    report = file_report(raw, station) if report is None else report
    usable = report.where(F.col("status") == "ok").select("file", "at")
    at = list_files(raw).join(usable, "file").select(
        "path", "file", "variable", month_number(F.col("month_name")).alias("month"), "at"
    )
    if len(raw.inputFiles()) <= BROADCAST_FILES:
        at = F.broadcast(at)
    rows = raw.join(at, "path").withColumn("cells", _cells(F.col("line"))).select(
        F.lit(station).alias("station_id"),
        "file",
        "variable",
        "month",
        _cell("at.day").alias("day_text"),
        _cell("at.hour").alias("hour_text"),
        _cell("at.value").alias("value_text"),
    )
    rows = rows.withColumn("ts", compose_timestamp(F.col("day_text"), F.col("hour_text"), year))
    readings = rows.where(F.col("ts").isNotNull()).select(
        "station_id", "variable", "month", "ts", clean_number(F.col("value_text")).alias("value")
    )
    # A title row fills only its first cell, and the header names its columns.
    is_data = F.col("hour_text").isNotNull() & (clean_text(F.col("day_text")) != "fecha")
    quarantine = rows.where(F.col("ts").isNull() & is_data).select(
        "station_id", "file", "variable", "day_text", "hour_text", "value_text"
    )
    return readings, quarantine


def month_order(months: Sequence[str]) -> list[str]:
    """Two-digit numbers of month names, in the order given."""
    return [MONTH_NUMBERS[m.lower()] for m in months]

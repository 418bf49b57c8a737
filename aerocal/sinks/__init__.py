"""Writers. All write from the executors; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerocal.config import MONTH_NUMBERS
from aerocal.session import scratch_path

_FORMAT = {"csv": {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    df.write.format(fmt).options(**_FORMAT.get(fmt, {})).mode(mode).save(path)
    return path


def write_monthly(
    df: DataFrame, path: str, year: int, fmt: str = "parquet", mode: str = "errorifexists"
) -> str:
    """Station table partitioned by year and source-file month (``month`` column).

    The year is that of the source file too: its last row, hour 24 of its last day, is the next year's
    first instant. ``year`` stands in for rows without a time.
    """
    of_file = F.year(F.col("ts") - F.expr("INTERVAL 1 HOUR")) if "ts" in df.columns else F.lit(None)
    out = df.withColumn("year", F.coalesce(of_file, F.lit(year)))
    out.write.format(fmt).options(**_FORMAT.get(fmt, {})).mode(mode).partitionBy(
        "year", "month"
    ).save(path)
    return path


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Write a table dealt and sorted by ``keys`` and read it back.

    Joins of tables with the same keys and number of buckets need no shuffle. Keys should hold the time beside
    the station, so that a station with most rows spreads over all buckets. Without ``path`` the files
    go to the shared folder.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def range_label(year: int, months: Sequence[str]) -> str:
    """'2025-03_07' from the first and last month name in calendar order."""
    numbers = sorted(MONTH_NUMBERS[m.lower()] for m in months)
    return f"{year}-{numbers[0]}_{numbers[-1]}"


def metric_line(split: Column, r2: Column, rmse: Column, mae: Column) -> Column:
    """'Train: R2=0.613 RMSE=21.56 MAE=15.66'."""
    return F.format_string(
        "%-5s: R2=%.3f RMSE=%.2f MAE=%.2f", F.initcap(split), r2, rmse, mae
    )


def summary_lines(metrics: DataFrame, target: str) -> DataFrame:
    """Report text, one row per line: (line_no, line).

    ``metrics`` has one row per model and split, so the report is as short as that.
    """
    body = metrics.select(
        "model",
        "split",
        metric_line(F.col("split"), F.col("r2"), F.col("rmse"), F.col("mae")).alias("line"),
    )
    blocks = body.groupBy("model").agg(
        F.sort_array(F.collect_list(F.struct((F.col("split") == "test").alias("late"), "line"))).alias("l")
    )
    texts = F.concat(F.array(F.col("model")), F.transform("l", lambda x: x["line"]))
    lines = blocks.select("model", F.posexplode(texts).alias("pos", "line"))
    head = metrics.sparkSession.range(1).select(
        F.lit("").alias("model"), F.lit(0).alias("pos"), F.lit(f"TARGET = {target}").alias("line")
    )
    return head.unionByName(lines).select("model", "pos", "line")


def write_summary(metrics: DataFrame, target: str, path: str, mode: str = "errorifexists") -> str:
    """The report as one text file: a few lines per model."""
    lines = summary_lines(metrics, target).orderBy("model", "pos").select("line")
    lines.coalesce(1).write.mode(mode).text(path)
    return path


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists") -> str:
    metrics.write.mode(mode).json(path)
    return path


def save_model(model: PipelineModel, path: str, overwrite: bool = True) -> str:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)
    return path

"""Hourly means and deduplication of live sensor rows.

Watermarks need TIMESTAMP, so zone-free times are cast in the session zone (UTC).
Cleaning, compensation and calibration are row-level expressions of
``aerocal.functions`` and apply to a stream unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.operators.timeaxis import numeric_columns


def with_watermark(stream: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    return (
        stream.where(F.col(ts).isNotNull())
        .withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
    )


def dedupe_stream(stream: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """First arrival per key and time; state is dropped behind the watermark."""
    return stream.dropDuplicatesWithinWatermark([*keys, ts])


def hourly_stream(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    values: Sequence[str] | None = None,
    every: str = "1 hour",
) -> DataFrame:
    """Mean per series and bin of a watermarked stream; bins close with the watermark."""
    keys = list(keys)
    values = list(values) if values is not None else numeric_columns(stream, keys + [ts])
    return (
        stream.groupBy(*keys, F.window(ts, every).alias("_w"))
        .agg(*[F.avg(c).alias(c) for c in values])
        .select(*keys, F.col("_w.start").alias(ts), *values)
    )

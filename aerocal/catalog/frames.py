"""Stand-in frames read from the driver's tables, and their SQL forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerocal.config import TargetSpec, target_spec
from aerocal.functions import mask_outside, ppb_to_ppm
from aerocal.operators.timeaxis import fill_time_gaps, resample
from aerocal.plans.residual import fill_with_rolling

#: Raw rows for each task that fills and sorts series, so that a task holds no more of a larger table.
ROWS_A_PART = 250_000

TYPES = ("click", "error", "purchase", "signup", "view")
SPEC: TargetSpec = target_spec("O3")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fresh_name(name: str) -> str:
    """A table name never used before, as runs may share a catalog."""
    return f"{name}_{uuid.uuid4().hex}"


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Raw readings: event_id, ts, sensor_id, variable, value, k."""
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("sensor_id"),
        F.col("event_type").alias("variable"),
        "value",
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
    )


READINGS_SQL = """
readings AS (
  SELECT event_id, ts, user_id AS sensor_id, event_type AS variable, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k
  FROM events
)"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means per variable, only hours with readings: variable, ts, value, k."""
    return resample(readings(spark, sf), ["variable"], values=["value", "k"], fill_gaps=False)


HOURLY_SQL = (
    READINGS_SQL
    + """,
hourly AS (
  SELECT variable, date_trunc('hour', ts) AS ts, avg(value) AS value, avg(k) AS k
  FROM readings GROUP BY 1, 2
)"""
)


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means per variable without gaps."""
    return fill_time_gaps(hourly(spark, sf), ["variable"])


GRID_SQL = (
    HOURLY_SQL
    + """,
spine AS (
  SELECT variable, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts
  FROM (SELECT variable, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY 1)
),
grid AS (
  SELECT s.variable, s.ts, h.value, h.k
  FROM spine s LEFT JOIN hourly h ON h.variable = s.variable AND h.ts = s.ts
)"""
)


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly table with one column per variable: ts, click .. view."""
    from aerocal.operators.align import pivot_variables

    return pivot_variables(hourly(spark, sf), ["ts"], "variable", "value", {t: t for t in TYPES})


WIDE_SQL = (
    HOURLY_SQL
    + """,
wide AS (
  SELECT ts, """
    + ", ".join(f"max(CASE WHEN variable = '{t}' THEN value END) AS {t}" for t in TYPES)
    + """
  FROM hourly GROUP BY 1
)"""
)


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Raw calibration rows: sensor, time, signal, masked temperature, humidity, label."""
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sensor_id"),
        F.col("l_shipdate").alias("ts"),
        ppb_to_ppm(price).alias("O3_lcs_ppb"),
        mask_outside(F.col("l_quantity")).alias("Temp_lcs"),
        (F.col("l_discount") * 1000).alias("RH_lcs"),
        ppb_to_ppm(price * (1 - F.col("l_discount"))).alias("O3_ref"),
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means per sensor, only days with readings: all that labelled rows need."""
    return resample(shipments(spark, sf), ["sensor_id"], every="1 day", fill_gaps=False)


def _parts(rows: DataFrame) -> int:
    """Tasks for the series of a table, by its row count (read from the files' footers)."""
    return 1 + rows.count() // ROWS_A_PART


def fused(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means per sensor on a gap-free grid: what the models train on."""
    rows = shipments(spark, sf)
    return resample(rows, ["sensor_id"], every="1 day", parts=_parts(rows))


def fused_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """The gap-free grid with trailing means of the features: fill and means share one sort."""
    rows = shipments(spark, sf)
    grid = resample(rows, ["sensor_id"], every="1 day", fill_gaps=False)
    return fill_with_rolling(grid, SPEC, every="1 day", parts=_parts(rows))


FUSED_SQL = """
daily AS (
  SELECT l_suppkey AS sensor_id, l_shipdate AS ts,
         avg(l_extendedprice / 1000e0) AS o3, avg(CASE WHEN l_quantity BETWEEN -10 AND 40 THEN l_quantity END) AS t,
         avg(l_discount * 1000) AS h, avg(l_extendedprice * (1 - l_discount) / 1000e0) AS y
  FROM lineitem GROUP BY 1, 2
),
days AS (
  SELECT sensor_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts
  FROM (SELECT sensor_id, min(ts) AS lo, max(ts) AS hi FROM daily GROUP BY 1)
),
fused AS (
  SELECT d.sensor_id, d.ts, o3, t, h, y
  FROM days d LEFT JOIN daily x ON x.sensor_id = d.sensor_id AND x.ts = d.ts
)"""

SPLIT_SQL = (
    FUSED_SQL
    + """,
labelled AS (
  SELECT *, CASE WHEN month(ts) IN (3, 4, 5, 6) THEN 'train' WHEN month(ts) = 7 THEN 'test' END AS split
  FROM fused WHERE y IS NOT NULL AND month(ts) IN (3, 4, 5, 6, 7)
),
med AS (
  SELECT median(o3) AS mo3, median(t) AS mt, median(h) AS mh FROM labelled WHERE split = 'train'
),
filled AS (
  SELECT l.*, coalesce(o3, mo3) AS fo3, coalesce(t, mt) AS ft, coalesce(h, mh) AS fh FROM labelled l, med
)"""
)

BASELINE_SQL = (
    SPLIT_SQL
    + """,
comp AS (
  SELECT *, fo3 / 1.451e0 + 0.1034e0 * ft * ft - 2.225e0 * ft + 0.01223e0 * fh * fh - 1.984e0 * fh + 79 AS x
  FROM filled
),
line AS (
  SELECT regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta FROM comp WHERE split = 'train'
),
based AS (SELECT c.*, alpha + beta * x AS yb FROM comp c, line)"""
)

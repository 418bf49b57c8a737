"""Time axis: resampling, gaps, interpolation, rolling means, folds, time parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerocal.catalog.frames import (
    FUSED_SQL,
    GRID_SQL,
    HOURLY_SQL,
    READINGS_SQL,
    daily,
    grid,
    hourly,
    readings,
    table,
)
from aerocal.catalog.registry import label, ls, query, r, rs
from aerocal.functions import (
    compose_timestamp,
    date_plus_hours,
    mask_outside,
    month_label,
    parse_day_first,
    parse_mixed,
    shift_hours,
    within_time,
)
from aerocal.operators.folds import fold_members, fold_starts, with_fold_block
from aerocal.operators.timeaxis import (
    dedupe_first,
    interpolate,
    interpolate_raw,
    rolling_mean,
)


@query(
    f"""WITH {HOURLY_SQL}
SELECT variable, {ls("ts")} AS ts, {ls("ts", "%Y-%m")} AS month, month(ts) AS month_no,
       {rs("value")} AS value, {rs("k")} AS k FROM hourly"""
)
def hourly_resample(spark, sf):
    return hourly(spark, sf).select(
        "variable",
        label("ts").alias("ts"),
        month_label(F.col("ts")).alias("month"),
        F.month("ts").cast("long").alias("month_no"),
        r("value").alias("value"),
        r("k").alias("k"),
    )


@query(
    f"""WITH {GRID_SQL}
SELECT variable, {ls("ts")} AS ts, {rs("value")} AS value, {rs("k")} AS k FROM grid"""
)
def resample_gapfill(spark, sf):
    return grid(spark, sf).select(
        "variable", label("ts").alias("ts"), r("value").alias("value"), r("k").alias("k")
    )


# A row's neighbours: the last known row at or before it, the first at or after it.
def _interpolated_sql(source: str, keys: str, order: str, x: str) -> str:
    return f"""
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}
),
near AS (
  SELECT *,
    max(CASE WHEN {x} IS NOT NULL THEN rn END) OVER (PARTITION BY {keys} ORDER BY rn
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_rn,
    min(CASE WHEN {x} IS NOT NULL THEN rn END) OVER (PARTITION BY {keys} ORDER BY rn
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_rn,
    last_value({x} IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY rn
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_x,
    first_value({x} IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY rn
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_x
  FROM numbered
),
smooth AS (
  SELECT *, CASE WHEN {x} IS NOT NULL THEN {x}
      WHEN p_rn IS NOT NULL AND n_rn IS NOT NULL THEN p_x + (n_x - p_x) * (rn - p_rn) / (n_rn - p_rn)
      ELSE p_x END AS forward
  FROM near
)"""


@query(
    f"""WITH {GRID_SQL}, {_interpolated_sql("grid", "variable", "ts", "value")}
SELECT variable, {ls("ts")} AS ts, {rs("forward")} AS value FROM smooth"""
)
def interpolate_forward(spark, sf):
    out = interpolate(grid(spark, sf), ["value"], ["variable"])
    return out.select("variable", label("ts").alias("ts"), r("value").alias("value"))


_MASKED = """
masked AS (
  SELECT event_id, sensor_id, variable, ts, CASE WHEN value BETWEEN -10 AND 40 THEN value END AS value
  FROM readings
)"""


@query(
    f"""WITH {READINGS_SQL}, {_MASKED},
{_interpolated_sql("masked", "sensor_id", "ts, event_id", "value")}
SELECT event_id, {rs("coalesce(forward, n_x)")} AS value FROM smooth"""
)
def outlier_mask_interpolate(spark, sf):
    """Raw rows per sensor, interpolated in both directions."""
    masked = readings(spark, sf).withColumn("value", mask_outside(F.col("value")))
    out = interpolate_raw(masked, ["value"], ["sensor_id"], both=True, tie=["event_id"])
    return out.select("event_id", r("value").alias("value"))


@query(
    f"""WITH {READINGS_SQL}, {_MASKED},
{_interpolated_sql("masked", "variable", "ts, event_id", "value")}
SELECT event_id, {rs("forward")} AS value FROM smooth"""
)
def interpolate_long_series(spark, sf):
    """Few long series, cut into chunks of rows: no series is sorted in one task."""
    masked = readings(spark, sf).withColumn("value", mask_outside(F.col("value")))
    out = interpolate_raw(masked, ["value"], ["variable"], tie=["event_id"], chunk_rows=1000, group_chunks=10)
    return out.select("event_id", r("value").alias("value"))


@query(
    f"""WITH {GRID_SQL}
SELECT variable, {ls("ts")} AS ts,
  {rs("avg(value) OVER w")} AS value_rm3h, {rs("avg(k) OVER w")} AS k_rm3h
FROM grid WINDOW w AS (PARTITION BY variable ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
)
def rolling_mean3(spark, sf):
    out = rolling_mean(grid(spark, sf), ["value", "k"], ["variable"])
    return out.select(
        "variable", label("ts").alias("ts"), r("value_rm3h").alias("value_rm3h"), r("k_rm3h").alias("k_rm3h")
    )


@query(
    f"""WITH {READINGS_SQL}
SELECT variable, {ls("hour")} AS hour, event_id, {rs("value")} AS value FROM (
  SELECT *, date_trunc('hour', ts) AS hour,
    row_number() OVER (PARTITION BY variable, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn
  FROM readings) WHERE rn = 1"""
)
def dedupe_first_row(spark, sf):
    rows = readings(spark, sf).withColumn("hour", F.window("ts", "1 hour").start)
    out = dedupe_first(rows, ["variable", "hour"], ["ts", "event_id"])
    return out.select("variable", label("hour").alias("hour"), "event_id", r("value").alias("value"))


_ORDER = ["ts", "sensor_id"]


@query(
    f"""WITH {FUSED_SQL},
train AS (
  SELECT *, row_number() OVER (ORDER BY ts, sensor_id) - 1 AS rn, count(*) OVER () AS n
  FROM fused WHERE y IS NOT NULL AND month(ts) IN (3, 4, 5, 6)
),
cut AS (SELECT *, n // 5 AS step FROM train),
members AS (
  SELECT fold, CASE WHEN rn < n - (4 - fold) * step THEN 'train'
                    WHEN rn < n - (3 - fold) * step THEN 'test' END AS role, ts, sensor_id, y
  FROM cut, (SELECT unnest([0, 1, 2, 3]) AS fold)
)
SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS n_rows,
       {ls("min(ts)")} AS first_ts, {ls("max(ts)")} AS last_ts, {rs("avg(y)")} AS mean_y
FROM members WHERE role IS NOT NULL GROUP BY ALL"""
)
def time_series_folds(spark, sf):
    rows = daily(spark, sf).where(F.month("ts").isin(3, 4, 5, 6))
    blocks = with_fold_block(rows, _ORDER, fold_starts(rows, _ORDER))
    return (
        fold_members(blocks)
        .groupBy(F.col("fold").cast("long").alias("fold"), "role")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            label(F.min("ts")).alias("first_ts"),
            label(F.max("ts")).alias("last_ts"),
            r(F.avg("O3_ref")).alias("mean_y"),
        )
    )


_RAW_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


@query(
    """WITH cut AS (
  SELECT l_shipdate, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS rn,
         count(*) OVER () AS n, count(*) OVER () // 5 AS t, l_extendedprice AS x
  FROM lineitem
)
SELECT CASE WHEN rn < n - 4 * t THEN 0 ELSE 1 + (rn - (n - 4 * t)) // t END AS block,
       count(*) AS n_rows, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day,
       strftime(max(l_shipdate), '%Y-%m-%d') AS last_day, round(avg(x), 4) + 0e0 AS mean_x
FROM cut GROUP BY 1"""
)
def time_series_folds_raw(spark, sf):
    """Fold borders inside days that many rows share, found by counting ranks."""
    rows = table(spark, sf, "lineitem").select(*_RAW_ORDER, "l_extendedprice")
    blocks = with_fold_block(rows, _RAW_ORDER, fold_starts(rows, _RAW_ORDER))
    return blocks.groupBy(F.col("block").cast("long").alias("block")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        label(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_day"),
        label(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_day"),
        r(F.avg("l_extendedprice"), 4).alias("mean_x"),
    )


@query(
    f"""SELECT o_orderkey,
  {ls("o_orderdate + to_hours(CAST(1 + o_orderkey % 24 AS BIGINT))")} AS ts,
  {ls("o_orderdate + to_hours(CAST(1 + o_orderkey % 24 AS BIGINT))")} AS ts_iso,
  CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE
    {ls("make_timestamp(2025, month(o_orderdate), day(o_orderdate), 0, 0, 0) + to_hours(CAST(1 + o_orderkey % 24 AS BIGINT))")}
  END AS ts_2025
FROM orders"""
)
def compose_hour24(spark, sf):
    """Date text and hour 1..24 to a time; hour 24 is the next midnight."""
    hour = F.lit(1) + F.col("o_orderkey") % 24
    day = F.date_format("o_orderdate", "dd/MM/yy")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        label(compose_timestamp(day, hour.cast("string"))).alias("ts"),
        label(date_plus_hours(F.col("o_orderdate"), hour.cast("int"))).alias("ts_iso"),
        label(compose_timestamp(day, hour.cast("string"), 2025)).alias("ts_2025"),
    )


@query(
    f"""SELECT event_id, {ls("date_trunc('minute', ts)")} AS strict_ts, {ls("date_trunc('second', ts)")} AS day_first_ts,
  {ls("date_trunc('second', ts)")} AS mixed_ts, CAST(NULL AS VARCHAR) AS bad_ts,
  {ls("date_trunc('minute', ts) + INTERVAL 1 HOUR")} AS shifted_ts
FROM events"""
)
def parse_formats(spark, sf):
    """Times written in several formats and read back; bad text gives null."""
    ts = F.col("ts")
    short = F.date_format(ts, "d/M/yy H:mm")
    iso = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    us = F.date_format(ts, "MM/dd/yyyy HH:mm:ss")
    mixed = F.when(F.col("event_id") % 2 == 0, iso).otherwise(us)
    return table(spark, sf, "events").select(
        "event_id",
        label(parse_day_first(short, strict=True)).alias("strict_ts"),
        label(parse_day_first(F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))).alias("day_first_ts"),
        label(parse_mixed(mixed)).alias("mixed_ts"),
        label(parse_day_first(F.concat(F.lit("x"), short), strict=True)).alias("bad_ts"),
        label(shift_hours(parse_day_first(short, strict=True), 1)).alias("shifted_ts"),
    )


@query(
    f"""WITH {HOURLY_SQL}
SELECT variable, {ls("ts")} AS ts, {rs("value")} AS value FROM hourly
WHERE ts BETWEEN TIMESTAMP '2024-01-07 15:01:00' AND TIMESTAMP '2024-01-24 14:00:00'"""
)
def time_slice(spark, sf):
    """Both ends of the slice are kept."""
    rows = hourly(spark, sf).where(
        within_time(F.col("ts"), "2024-01-07 15:01:00", "2024-01-24 14:00:00")
    )
    return rows.select("variable", label("ts").alias("ts"), r("value").alias("value"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS day, l_quantity
FROM lineitem WHERE month(l_shipdate) = 7"""
)
def month_slice(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.month("l_shipdate") == 7)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", label("l_shipdate", "yyyy-MM-dd").alias("day"), "l_quantity"
    )

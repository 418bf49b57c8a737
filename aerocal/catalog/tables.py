"""Joins, cleaning, coverage, masks and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerocal.catalog.frames import (
    FUSED_SQL,
    GRID_SQL,
    HOURLY_SQL,
    READINGS_SQL,
    SPEC,
    TYPES,
    WIDE_SQL,
    daily,
    fresh_name,
    grid,
    hourly,
    readings,
    shipments,
    table,
    wide,
)
from aerocal.catalog.registry import label, ls, query, r, rs
from aerocal.config import SplitSpec
from aerocal.functions import (
    all_present,
    any_present,
    clean_number,
    clean_text,
    compensate_ozone,
    mask_outside,
    masked,
    month_label,
    ppb_to_ppm,
)
from aerocal.operators.align import (
    align_by_position,
    compare_sources,
    first_rows,
    fuse,
    outer_join_variables,
    stack_tables,
)
from aerocal.operators.calibrate import impute, two_point_calibrate
from aerocal.operators.models import labelled_splits
from aerocal.operators.orderstat import exact_medians
from aerocal.operators.quality import coverage_by, coverage_total, optional_column, require_columns
from aerocal.operators.timeaxis import numbered, resample
from aerocal.sinks import write_bucketed

_ROUNDED = ", ".join(f"{rs(t)} AS {t}" for t in TYPES)


@query(f"WITH {WIDE_SQL} SELECT {ls('ts')} AS ts, {_ROUNDED} FROM wide")
def station_pivot(spark, sf):
    return wide(spark, sf).select(label("ts").alias("ts"), *[r(t).alias(t) for t in TYPES])


@query(f"WITH {WIDE_SQL} SELECT {ls('ts')} AS ts, {_ROUNDED} FROM wide")
def outer_join_variables_chain(spark, sf):
    h = hourly(spark, sf)
    parts = [
        h.where(F.col("variable") == t).select("ts", F.col("value").alias(t)) for t in TYPES
    ]
    out = outer_join_variables(parts, ["ts"])
    return out.select(label("ts").alias("ts"), *[r(t).alias(t) for t in TYPES])


@query(
    f"""WITH {HOURLY_SQL},
sensor AS (
  SELECT sensor_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM readings GROUP BY 1, 2
)
SELECT s.sensor_id, {ls("s.ts")} AS ts, {rs("s.value")} AS value, {rs("h.value")} AS ref
FROM sensor s LEFT JOIN hourly h ON h.ts = s.ts AND h.variable = 'view'"""
)
def left_fuse(spark, sf):
    sensor = resample(readings(spark, sf), ["sensor_id"], values=["value"], fill_gaps=False)
    reference = hourly(spark, sf).where("variable = 'view'").select("ts", F.col("value").alias("ref"))
    out = fuse(sensor, reference, ["ts"])
    return out.select("sensor_id", label("ts").alias("ts"), r("value").alias("value"), r("ref").alias("ref"))


@query(
    f"""WITH {HOURLY_SQL},
sensor AS (
  SELECT sensor_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM readings GROUP BY 1, 2
)
SELECT s.sensor_id, {ls("s.ts")} AS ts, {rs("s.value")} AS value, {rs("h.value")} AS ref
FROM sensor s LEFT JOIN hourly h ON h.ts = s.ts AND h.variable = 'view'"""
)
def fused_table_roundtrip(spark, sf):
    """Sensor and reference tables written bucketed by time, joined without a shuffle, written and read again."""
    sensor = resample(readings(spark, sf), ["sensor_id"], values=["value"], fill_gaps=False)
    reference = hourly(spark, sf).where("variable = 'view'").select("ts", F.col("value").alias("ref"))
    left, right = (write_bucketed(t, fresh_name(n), ["ts"], 8) for n, t in (("sensor", sensor), ("reference", reference)))
    out = write_bucketed(fuse(left, right, ["ts"]), fresh_name("fused"), ["sensor_id", "ts"], 8)
    return out.select("sensor_id", label("ts").alias("ts"), r("value").alias("value"), r("ref").alias("ref"))


@query(
    f"""WITH {GRID_SQL},
a AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM grid WHERE variable = 'click'),
b AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM grid WHERE variable = 'view')
SELECT {ls("a.ts")} AS ts, {rs("a.value")} AS a, {rs("b.value")} AS b FROM a JOIN b ON a.rn = b.rn"""
)
def align_positions(spark, sf):
    g = grid(spark, sf)
    a = g.where("variable = 'click'").select("ts", F.col("value").alias("a"))
    b = g.where("variable = 'view'").select("ts", F.col("value").alias("b"))
    out = align_by_position(a, b, strict=False)
    return out.select(label("ts").alias("ts"), r("a").alias("a"), r("b").alias("b"))


@query(
    f"""WITH {FUSED_SQL},
a AS (SELECT sensor_id, ts, o3, row_number() OVER (PARTITION BY sensor_id ORDER BY ts) AS rn FROM daily),
b AS (SELECT sensor_id, y, row_number() OVER (PARTITION BY sensor_id ORDER BY ts + INTERVAL 17 MINUTE) AS rn FROM daily)
SELECT a.sensor_id, {ls("ts")} AS ts, {rs("o3", 10)} AS signal, {rs("y", 10)} AS reference
FROM a JOIN b ON a.sensor_id = b.sensor_id AND a.rn = b.rn"""
)
def align_positions_by_sensor(spark, sf):
    """Two records of each sensor whose clocks differ, row by row; lengths must agree."""
    rows = daily(spark, sf)
    signal = rows.select("sensor_id", "ts", F.col("O3_lcs_ppb").alias("signal"))
    late = F.col("ts") + F.expr("INTERVAL 17 MINUTES")
    reference = rows.select("sensor_id", late.alias("ts"), F.col("O3_ref").alias("reference"))
    out = align_by_position(signal, reference, keys=["sensor_id"])
    return out.select("sensor_id", label("ts").alias("ts"), r("signal", 10).alias("signal"), r("reference", 10).alias("reference"))


@query(
    f"""WITH {READINGS_SQL}
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place,
  row_number() OVER (PARTITION BY variable ORDER BY ts, event_id) AS place_in_variable FROM readings"""
)
def row_positions(spark, sf):
    """Places of all raw rows, over the table and per variable, without a window over rows."""
    rows = readings(spark, sf).select("event_id", "variable", "ts")
    order = ["ts", "event_id"]
    out = numbered(numbered(rows, [], order, "place"), ["variable"], order, "place_in_variable")
    return out.select("event_id", "place", "place_in_variable")


@query(
    f"""WITH {HOURLY_SQL},
pairs AS (SELECT unnest(['click', 'view']) AS source),
times AS (SELECT DISTINCT ts FROM hourly WHERE variable IN ('click', 'view'))
SELECT {ls("t.ts")} AS ts, q.variable, p.source,
       {rs("CASE WHEN q.variable = 'signal' THEN h.value ELSE h.k END")} AS value
FROM times t CROSS JOIN pairs p CROSS JOIN (SELECT unnest(['signal', 'covariate']) AS variable) q
LEFT JOIN hourly h ON h.ts = t.ts AND h.variable = p.source"""
)
def source_comparison_long(spark, sf):
    h = hourly(spark, sf)
    sources = {t: h.where(F.col("variable") == t) for t in ("click", "view")}
    columns = {
        "signal": {"click": "value", "view": "value"},
        "covariate": {"click": "k", "view": "k"},
    }
    out = compare_sources(sources, columns)
    return out.select(label("ts").alias("ts"), "variable", "source", r("value").alias("value"))


@query(
    f"""WITH {WIDE_SQL}
SELECT variable, {rs("coverage")} AS coverage FROM (
  UNPIVOT (SELECT {", ".join(f"100e0 * count({t}) / count(*) AS {t}" for t in TYPES)} FROM wide)
  ON {", ".join(TYPES)} INTO NAME variable VALUE coverage)"""
)
def coverage_total_report(spark, sf):
    return coverage_total(wide(spark, sf), TYPES).select("variable", r("coverage").alias("coverage"))


@query(
    f"""WITH {GRID_SQL}
SELECT {ls("ts", "%Y-%m-%d")} AS day, {rs("100e0 * count(value) / count(*)", 1)} AS value,
       {rs("100e0 * count(k) / count(*)", 1)} AS k FROM grid GROUP BY 1"""
)
def coverage_by_day(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    out = coverage_by(grid(spark, sf), day, ["value", "k"])
    return out.select("day", r("value", 1).alias("value"), r("k", 1).alias("k"))


@query(
    f"""SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n_rows,
  {rs("100e0 * count(CASE WHEN l_quantity BETWEEN -10 AND 40 THEN 1 END) / count(*)", 4)} AS Temp_lcs,
  {rs("100e0 * count(l_discount) / count(*)", 4)} AS RH_lcs
FROM lineitem GROUP BY 1"""
)
def coverage_by_month(spark, sf):
    rows = shipments(spark, sf)
    month = month_label(F.col("ts")).alias("month")
    out = coverage_by(rows, month, ["Temp_lcs", "RH_lcs"], digits=None)
    counts = rows.groupBy(month).agg(F.count(F.lit(1)).alias("n_rows"))
    return out.join(counts, "month").select(
        "month", "n_rows", r("Temp_lcs", 4).alias("Temp_lcs"), r("RH_lcs", 4).alias("RH_lcs")
    )


@query(
    f"""WITH {READINGS_SQL}
SELECT event_id, variable AS name, CASE WHEN k >= 50 THEN value END AS reading,
       CASE WHEN value < 100 THEN value END AS numeric_only
FROM readings"""
)
def clean_sentinels(spark, sf):
    """Readings written as text with sentinels, then cleaned."""
    k, text = F.col("k"), F.col("value").cast("string")
    raw = (
        F.when(k < 10, "nr").when(k < 20, "NR").when(k < 30, "Na").when(k < 40, "NA").when(k < 50, "")
        .otherwise(F.concat(F.lit(" "), text, F.lit(" ")))
    )
    odd = F.when(F.col("value") < 100, text).otherwise(F.concat(text, F.lit(" ppb")))
    header = F.concat(F.lit("  "), F.upper("variable"), F.lit(" "))
    return readings(spark, sf).select(
        "event_id",
        clean_text(header).alias("name"),
        clean_number(raw).alias("reading"),
        clean_number(odd).alias("numeric_only"),
    )


@query(
    f"""WITH {WIDE_SQL}
SELECT {ls("ts")} AS ts, {rs("click")} AS click, {rs("view")} AS view FROM wide
WHERE click IS NOT NULL AND view IS NOT NULL"""
)
def presence_all(spark, sf):
    rows = wide(spark, sf).where(all_present(["click", "view"]))
    return rows.select(label("ts").alias("ts"), r("click").alias("click"), r("view").alias("view"))


@query(
    f"""WITH {WIDE_SQL}
SELECT {ls("ts")} AS ts, {rs("click")} AS click, {rs("view")} AS view FROM wide
WHERE click IS NOT NULL OR view IS NOT NULL"""
)
def presence_any(spark, sf):
    rows = wide(spark, sf).where(any_present(["click", "view"]))
    return rows.select(label("ts").alias("ts"), r("click").alias("click"), r("view").alias("view"))


@query(
    f"""WITH {WIDE_SQL}
SELECT {ls("ts")} AS ts,
  {rs("CASE WHEN click IS NOT NULL AND view IS NOT NULL THEN 2 + 0.5e0 * click - 0.25e0 * view END")} AS score
FROM wide"""
)
def masked_score(spark, sf):
    value = 2.0 + 0.5 * F.col("click") - 0.25 * F.col("view")
    rows = wide(spark, sf).withColumn("score", masked(all_present(["click", "view"]), value))
    return rows.select(label("ts").alias("ts"), r("score").alias("score"))


@query(
    f"""WITH {WIDE_SQL},
m AS (SELECT {", ".join(f"median({t}) AS m_{t}" for t in TYPES)} FROM wide)
SELECT {ls("ts")} AS ts, {", ".join(f"{rs(f'coalesce({t}, m_{t})')} AS {t}" for t in TYPES)} FROM wide, m"""
)
def impute_median(spark, sf):
    rows = wide(spark, sf)
    out = impute(rows, TYPES, exact_medians(rows, TYPES))
    return out.select(label("ts").alias("ts"), *[r(t).alias(t) for t in TYPES])


_COLS = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    f"""SELECT l_returnflag, {", ".join(f"{rs(f'median({c})')} AS {c}" for c in _COLS)}
FROM lineitem GROUP BY 1"""
)
def median_by_rank(spark, sf):
    """Medians of three columns per group, all in the same passes, in brackets cut to few rows."""
    out = exact_medians(table(spark, sf, "lineitem"), _COLS, ["l_returnflag"], leaf_rows=1000)
    return out.select("l_returnflag", *[r(c).alias(c) for c in _COLS])


@query(
    f"""WITH {READINGS_SQL}
SELECT event_id, {rs("value / 1000")} AS ppm,
  {rs("value / 1.451e0 + 0.1034e0 * pow(k / 4, 2) - 2.225e0 * k / 4 + 0.01223e0 * k * k - 1.984e0 * k + 79")} AS compensated
FROM readings"""
)
def compensate(spark, sf):
    return readings(spark, sf).select(
        "event_id",
        r(ppb_to_ppm(F.col("value"))).alias("ppm"),
        r(compensate_ozone(F.col("value"), F.col("k") / 4, F.col("k"))).alias("compensated"),
    )


@query(
    f"""WITH {WIDE_SQL},
e AS (SELECT min(click) AS a, max(click) AS b, min(view) AS c, max(view) AS d FROM wide)
SELECT {ls("ts")} AS ts, {rs("(click - a) * (d - c) / nullif(b - a, 0) + c")} AS calibrated FROM wide, e"""
)
def two_point(spark, sf):
    out = two_point_calibrate(wide(spark, sf), "click", "view", "calibrated")
    return out.select(label("ts").alias("ts"), r("calibrated").alias("calibrated"))


@query(
    f"""WITH {FUSED_SQL},
e AS (SELECT sensor_id, min(o3) AS a, max(o3) AS b, min(y) AS c, max(y) AS d FROM fused GROUP BY 1)
SELECT f.sensor_id, {ls("ts")} AS ts, {rs("(o3 - a) * (d - c) / nullif(b - a, 0) + c", 8)} AS calibrated
FROM fused f JOIN e ON e.sensor_id = f.sensor_id WHERE o3 IS NOT NULL"""
)
def two_point_by_sensor(spark, sf):
    out = two_point_calibrate(daily(spark, sf), "O3_lcs_ppb", "O3_ref", "calibrated", keys=["sensor_id"])
    return out.select("sensor_id", label("ts").alias("ts"), r("calibrated", 8).alias("calibrated"))


@query(
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, o_totalprice,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 2 END AS half
FROM orders WHERE o_orderstatus IN ('F', 'O')"""
)
def union_months(spark, sf):
    """Tables with different columns stacked by name."""
    orders = table(spark, sf, "orders")
    base = [label("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_totalprice"]
    done = orders.where("o_orderstatus = 'F'").select(*base, (F.col("o_totalprice") / 2).alias("half"))
    return stack_tables([done, orders.where("o_orderstatus = 'O'").select(*base)])


@query(
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, o_totalprice
FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 12"""
)
def preview_topk(spark, sf):
    rows = first_rows(table(spark, sf, "orders"), 12, ["o_orderdate", "o_orderkey"])
    return rows.select(label("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_totalprice")


@query(
    f"""SELECT o_orderkey AS id, {rs("o_totalprice / 1000")} AS ppm, CAST(NULL AS DOUBLE) AS absent
FROM orders"""
)
def optional_columns(spark, sf):
    rows = table(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "id", "o_totalprice": "gas"})
    require_columns(rows, ["id", "gas"])
    return rows.select(
        "id",
        r(ppb_to_ppm(optional_column(rows, "gas"))).alias("ppm"),
        optional_column(rows, "not_there").alias("absent"),
    )


@query(
    f"""WITH {FUSED_SQL}
SELECT CASE WHEN month(ts) = 7 THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows,
       count(t) AS n_temp, {ls("min(ts)")} AS first_ts, {ls("max(ts)")} AS last_ts
FROM fused WHERE y IS NOT NULL AND month(ts) IN (3, 4, 5, 6, 7) GROUP BY 1"""
)
def split_counts(spark, sf):
    rows = labelled_splits(daily(spark, sf), SPEC, SplitSpec())
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("Temp_lcs").alias("n_temp"),
        label(F.min("ts")).alias("first_ts"),
        label(F.max("ts")).alias("last_ts"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_quantity BETWEEN -10 AND 40 THEN l_quantity END AS temp FROM lineitem"""
)
def outlier_mask(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", mask_outside(F.col("l_quantity")).alias("temp")
    )

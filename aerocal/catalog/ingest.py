"""Sources, sinks and whole plans, over files that Spark derives from the tables.

The files go to a fresh folder under the shared one and hold every row of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.catalog.frames import (
    BASELINE_SQL,
    GRID_SQL,
    READINGS_SQL,
    SPEC,
    SPLIT_SQL,
    daily,
    grid,
    readings,
)
from aerocal.catalog.registry import label, ls, query, r, rs
from aerocal.catalog.statistics import baseline_rows
from aerocal.config import MONTH_NUMBERS, STATION_VARIABLES, SplitSpec
from aerocal.functions import month_number
from aerocal.operators.evaluate import model_metrics
from aerocal.operators.models import fit_model, labelled_splits, predict
from aerocal.plans.compensation import compensation_study
from aerocal.plans.fusion import fuse_sensor
from aerocal.plans.station import combine_months, normalise_station, write_station
from aerocal.session import materialise, scratch_path
from aerocal.sinks import save_model, summary_lines, write_monthly, write_table
from aerocal.sources import (
    load_model,
    read_hourly_station,
    read_met_station,
    read_sensor_2023,
    read_sensor_report,
    read_station_table,
)
from aerocal.sources.station import file_report, missing_files, read_station_files

STATION = "EST"
# Station variables and the series that play them.
_PLAYED = {"co": "click", "o3": "view", "rh": "signup", "tmp": "purchase"}
_MONTHS = tuple(MONTH_NUMBERS)


def write_station_exports(spark, sf: str) -> str:
    """Raw station exports, one folder per variable and month, title and header rows
    included; hours run 1..24 and missing readings are ``nr``."""
    codes = F.create_map(*[F.lit(x) for code, name in _PLAYED.items() for x in (name, code)])
    names = F.create_map(
        *[F.lit(x) for name, number in MONTH_NUMBERS.items() for x in (number, name)]
    )
    hour = F.when(F.hour("ts") == 0, 24).otherwise(F.hour("ts"))
    day = F.when(F.hour("ts") == 0, F.date_sub("ts", 1)).otherwise(F.to_date("ts"))
    cells = (
        grid(spark, sf)
        .where(F.col("variable").isin(list(_PLAYED.values())))
        .select(
            F.concat_ws("-", codes[F.col("variable")], names[F.date_format(day, "MM")]).alias("name"),
            F.date_format(day, "dd/MM/yy").alias("c0"),
            hour.cast("string").alias("c1"),
            F.coalesce(F.col("value").cast("string"), F.lit("nr")).alias("c2"),
        )
    )
    heads = cells.select("name").distinct().select(
        "name",
        F.inline(
            F.array(
                F.struct(F.lit("Hourly means").alias("c0"), F.lit("").alias("c1"), F.lit("").alias("c2")),
                F.struct(F.lit("Fecha").alias("c0"), F.lit("Hora").alias("c1"), F.lit(STATION).alias("c2")),
            )
        ),
    )
    folder = scratch_path(spark, "exports")
    rows = cells.unionByName(heads).withColumn("export", F.concat("name", F.lit(".csv"))).drop("name")
    rows.write.option("encoding", "ISO-8859-1").option("emptyValue", "").partitionBy("export").csv(folder)
    return folder


def write_broken_exports(spark, sf: str, folder: str) -> None:
    """Exports of the error series beside the others, without a header and for another station."""
    cells = grid(spark, sf).where("variable = 'error'").select(
        F.date_format(F.col("ts") - F.expr("INTERVAL 1 HOUR"), "MM").alias("month"),
        F.date_format("ts", "dd/MM/yy").alias("c0"),
        F.hour("ts").cast("string").alias("c1"),
        F.coalesce(F.col("value").cast("string"), F.lit("nr")).alias("c2"),
    )
    heads = cells.select("month").distinct().select(
        "month", F.lit("Fecha").alias("c0"), F.lit("Hora").alias("c1"), F.lit("OTRA").alias("c2")
    )
    names = F.create_map(*[F.lit(x) for name, number in MONTH_NUMBERS.items() for x in (number, name)])
    kinds = {"noheader": cells, "badcol": cells.unionByName(heads)}
    rows = reduce(
        DataFrame.unionByName,
        [df.withColumn("export", F.concat(F.lit(f"{k}-"), names[F.col("month")], F.lit(".csv"))) for k, df in kinds.items()],
    )
    rows.drop("month").write.mode("append").option("encoding", "ISO-8859-1").option("emptyValue", "").partitionBy(
        "export"
    ).csv(folder)


def _station(spark, sf: str):
    folder = write_station_exports(spark, sf)
    return normalise_station(spark, f"{folder}/*", STATION, None, _MONTHS)


_NAMED = ", ".join(f"{rs(_PLAYED[v])} AS {c}" for v, c in STATION_VARIABLES.items())
_HOURS = f"""WITH {GRID_SQL},
station AS (
  SELECT ts, {", ".join(f"max(CASE WHEN variable = '{t}' THEN value END) AS {t}" for t in _PLAYED.values())}
  FROM grid WHERE variable IN ({", ".join(f"'{t}'" for t in _PLAYED.values())}) GROUP BY 1
)"""


def _station_rows(df: DataFrame) -> DataFrame:
    return df.select(label("ts").alias("ts"), *[r(c).alias(c) for c in STATION_VARIABLES.values()])


@query(f"{_HOURS} SELECT {ls('ts')} AS ts, {_NAMED} FROM station")
def station_csv_ingest(spark, sf):
    """Raw exports to one wide table: read, parse, clean, pivot, combine."""
    return _station_rows(_station(spark, sf).combined)


_CODES = " ".join(f"WHEN '{name}' THEN '{code}'" for code, name in _PLAYED.items())


@query(
    f"""WITH {GRID_SQL},
named AS (SELECT variable, CASE variable {_CODES} END AS code, strftime(ts - INTERVAL 1 HOUR, '%m') AS month FROM grid),
files AS (SELECT DISTINCT code, month FROM named WHERE code IS NOT NULL),
broken AS (SELECT DISTINCT month FROM named WHERE variable = 'error'),
expected AS (
  SELECT code, lpad(m::VARCHAR, 2, '0') AS month
  FROM (VALUES {", ".join(f"('{code}')" for code in _PLAYED)}) v(code), range(1, 13) r(m)
)
SELECT code AS variable, month, 'ok' AS status FROM files
UNION ALL SELECT 'noheader', month, 'no_header' FROM broken
UNION ALL SELECT 'badcol', month, 'bad_columns' FROM broken
UNION ALL SELECT e.code, e.month, 'missing' FROM expected e LEFT JOIN files f ON f.code = e.code AND f.month = e.month
WHERE f.code IS NULL"""
)
def station_file_check(spark, sf):
    """Every export with its state: usable, without a header, without the columns, or missing."""
    folder = write_station_exports(spark, sf)
    write_broken_exports(spark, sf, folder)
    raw = read_station_files(spark, f"{folder}/*")
    number = month_number(F.col("month_name")).alias("month")
    missing = missing_files(raw, _MONTHS, _PLAYED).select("variable", number, F.lit("missing").alias("status"))
    return file_report(raw, STATION).select("variable", number, "status").unionByName(missing)


@query(
    f"""{_HOURS} SELECT year(ts - INTERVAL 1 HOUR)::BIGINT AS year_of_file, strftime(ts - INTERVAL 1 HOUR, '%m') AS month,
  count(*) AS n_rows, count(view) AS n_o3, {ls("min(ts)")} AS first_ts, {ls("max(ts)")} AS last_ts
FROM station GROUP BY 1, 2"""
)
def monthly_station_sink(spark, sf):
    """Tables partitioned by the month of the source file, written and read back."""
    monthly = _station(spark, sf).monthly
    # The partition key is the file's month; hour 24 of its last day stays with it.
    folder = scratch_path(spark, "monthly")
    in_year = F.year(F.col("ts") - F.expr("INTERVAL 1 HOUR")).cast("long")
    write_monthly(monthly.withColumn("year_of_file", in_year), folder, 2024)
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(folder)
    return back.groupBy("year_of_file", F.lpad(F.col("month").cast("string"), 2, "0").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("O3_ref").alias("n_o3"),
        label(F.min("ts")).alias("first_ts"),
        label(F.max("ts")).alias("last_ts"),
    )


@query(f"{_HOURS} SELECT {ls('ts')} AS ts, {_NAMED} FROM station")
def station_table_roundtrip(spark, sf):
    """The combined table written as CSV and read by the table reader."""
    tables = _station(spark, sf)
    folder = scratch_path(spark, "combined")
    out = tables.combined.withColumnRenamed("ts", "Timestamp").drop("station_id")
    write_table(out, folder, "csv")
    return _station_rows(read_station_table(spark, folder, STATION))


def write_sensor_report(spark, sf: str) -> str:
    """Raw report of one sensor over all readings: text times, several columns."""
    out = readings(spark, sf).select(
        F.date_format("ts", "dd/MM/yy HH:mm").alias("Timestamp"),
        F.col("value").alias("Ozone"),
        (F.col("k") * 10).alias("Carbon_Monoxide"),
        (F.col("value") - 5).alias("Temperature"),
        F.col("k").alias("Relative_Humidity"),
        (F.col("value") / 2).alias("PM2.5"),
        (F.col("value") / 4).alias("PM10*"),
    )
    folder = scratch_path(spark, "report")
    write_table(out, folder, "csv")
    return folder


@query(
    f"""WITH {READINGS_SQL},
minutes AS (
  SELECT date_trunc('minute', ts) AS ts, value, k * 10 AS co, CASE WHEN value - 5 BETWEEN -10 AND 40 THEN value - 5 END AS temp, k,
    row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY value, k * 10, value - 5, k) AS rn
  FROM readings
),
firsts AS (SELECT *, row_number() OVER (ORDER BY ts) AS pos FROM minutes WHERE rn = 1),
near AS (
  SELECT *,
    max(CASE WHEN temp IS NOT NULL THEN pos END) OVER b AS p_rn, min(CASE WHEN temp IS NOT NULL THEN pos END) OVER f AS n_rn,
    last_value(temp IGNORE NULLS) OVER b AS p_x, first_value(temp IGNORE NULLS) OVER f AS n_x
  FROM firsts WINDOW b AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
smooth AS (
  SELECT *, coalesce(temp, CASE WHEN p_rn IS NOT NULL AND n_rn IS NOT NULL THEN p_x + (n_x - p_x) * (pos - p_rn) / (n_rn - p_rn) END,
    p_x, n_x) AS t FROM near
),
hours AS (
  SELECT date_trunc('hour', ts) AS ts, avg(value) AS o3, avg(co) AS co, avg(t) AS t, avg(k) AS h FROM smooth GROUP BY 1
),
spine AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hours),
station AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS o3_ref FROM readings WHERE variable = 'view' GROUP BY 1)
SELECT {ls("s.ts")} AS ts, {rs("o3", 8)} AS O3_lcs_ppb, {rs("co / 1000", 8)} AS CO_lcs_ppm, {rs("t", 8)} AS Temp_lcs,
  {rs("h", 8)} AS RH_lcs, {rs("o3_ref", 8)} AS O3_ref
FROM spine s LEFT JOIN hours x ON x.ts = s.ts LEFT JOIN station r ON r.ts = s.ts"""
)
def sensor_report_fused(spark, sf):
    """Raw report to hourly fused table: parse, dedupe, mask, interpolate, resample, join."""
    report = read_sensor_report(spark, write_sensor_report(spark, sf), "S1")
    reference = grid(spark, sf).where("variable = 'view'").select(
        F.lit(STATION).alias("station_id"), "ts", F.col("value").alias("O3_ref")
    )
    out = fuse_sensor(report, reference)
    columns = ["O3_lcs_ppb", "CO_lcs_ppm", "Temp_lcs", "RH_lcs", "O3_ref"]
    return out.select(label("ts").alias("ts"), *[r(c, 8).alias(c) for c in columns])


def write_mixed_reports(spark, sf: str) -> str:
    """All readings as two reports with other columns in another order; some times are not day-first."""
    rows = readings(spark, sf).select(
        F.when(F.col("event_id") % 7 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .otherwise(F.date_format("ts", "dd/MM/yy HH:mm")).alias("Timestamp"),
        F.col("value").alias("Ozone"),
        F.col("k").alias("Relative_Humidity"),
        (F.col("k") * 10).alias("Carbon_Monoxide"),
        (F.col("value") / 4).alias("PM10*"),
        F.coalesce(F.col("variable") < "m", F.lit(False)).alias("early"),
    )
    folder = scratch_path(spark, "reports")
    write_table(rows.where("early").select("Timestamp", "Ozone", "Relative_Humidity", "Carbon_Monoxide"), f"{folder}/report-early", "csv")
    late = rows.where("not early").select("`PM10*`", "Relative_Humidity", "Timestamp", "Carbon_Monoxide", "Ozone")
    write_table(late, f"{folder}/report-late", "csv")
    return folder


@query(
    f"""WITH {READINGS_SQL},
told AS (
  SELECT *, CASE WHEN coalesce(variable < 'm', false) THEN 'early' ELSE 'late' END AS report,
    CASE WHEN event_id % 7 <> 0 THEN date_trunc('minute', ts) END AS parsed FROM readings
)
SELECT report AS sensor_id, count(*) AS n_rows, count(*) FILTER (parsed IS NULL) AS n_unparsed, {ls("min(parsed)")} AS first_ts, {ls("max(parsed)")} AS last_ts,
  {rs("avg(value)")} AS o3, {rs("avg(k)")} AS rh, {rs("avg(k * 10)")} AS co,
  count(CASE WHEN report = 'late' THEN value END) AS n_pm10
FROM told GROUP BY 1"""
)
def sensor_reports_own_headers(spark, sf):
    """Reports of several sensors in one read: each file by its own header, ids from the paths."""
    sensor = F.regexp_extract("path", "report-([^/]+)/", 1)
    rows = read_sensor_report(spark, f"{write_mixed_reports(spark, sf)}/*", sensor)
    return rows.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("ts").isNull()).alias("n_unparsed"),
        label(F.min("ts")).alias("first_ts"),
        label(F.max("ts")).alias("last_ts"),
        r(F.avg("O3_lcs_ppb")).alias("o3"),
        r(F.avg("RH_lcs")).alias("rh"),
        r(F.avg("Carbon_Monoxide")).alias("co"),
        F.count("PM10").alias("n_pm10"),
    )


_STUDY = f"""WITH {GRID_SQL},
ref_rows AS (SELECT ts, value + 1 AS o3 FROM grid WHERE variable = 'view'),
ref_n AS (SELECT *, row_number() OVER (ORDER BY ts) AS pos FROM ref_rows),
sen AS (
  SELECT date_trunc('hour', date_trunc('second', ts) + INTERVAL 1 HOUR) AS ts, avg(value) AS o3, avg(k / 4) AS t, avg(k) AS h
  FROM readings GROUP BY 1
),
cut AS (
  SELECT s.ts, o3, t, h FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM sen) s
  LEFT JOIN sen x ON x.ts = s.ts
  WHERE s.ts BETWEEN TIMESTAMP '2024-01-03 15:01:00' AND TIMESTAMP '2024-01-28 14:47:00'
),
cut_n AS (SELECT *, row_number() OVER (ORDER BY ts) AS pos FROM cut)"""


def _forward_sql(source: str, column: str, name: str) -> str:
    return f"""
{name}_near AS (
  SELECT ts, pos, {column} AS x, max(CASE WHEN {column} IS NOT NULL THEN pos END) OVER b AS p_rn,
    min(CASE WHEN {column} IS NOT NULL THEN pos END) OVER f AS n_rn,
    last_value({column} IGNORE NULLS) OVER b AS p_x, first_value({column} IGNORE NULLS) OVER f AS n_x
  FROM {source} WINDOW b AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
{name} AS (
  SELECT ts, coalesce(x, CASE WHEN p_rn IS NOT NULL AND n_rn IS NOT NULL
    THEN p_x + (n_x - p_x) * (pos - p_rn) / (n_rn - p_rn) END, p_x) AS v FROM {name}_near
)"""


_STUDY += "," + ",".join(
    _forward_sql(s, c, n)
    for s, c, n in (("ref_n", "o3", "fr"), ("cut_n", "o3", "fo"), ("cut_n", "t", "ft"), ("cut_n", "h", "fh"))
)
_STUDY += """,
pairs AS (
  SELECT fr.ts, fr.v AS ref, fo.v AS o3, ft.v AS t, fh.v AS h,
    fo.v / 1.451e0 + 0.1034e0 * ft.v * ft.v - 2.225e0 * ft.v + 0.01223e0 * fh.v * fh.v - 1.984e0 * fh.v + 79 AS comp
  FROM fr JOIN fo ON fo.ts = fr.ts JOIN ft ON ft.ts = fr.ts JOIN fh ON fh.ts = fr.ts
),
cal AS (
  SELECT p.*, (comp - c0) * (r1 - r0) / nullif(c1 - c0, 0) + r0 AS cal FROM pairs p,
    (SELECT min(comp) AS c0, max(comp) AS c1, min(ref) AS r0, max(ref) AS r1 FROM pairs)
)"""


def _stage_sql(stage: str, column: str) -> str:
    return f"""SELECT '{stage}' AS stage, {rs(f"avg(abs(ref - {column}))", 4)} AS mae,
  {rs(f"100 * avg(abs(ref - {column}) / nullif(ref, 0))", 4)} AS mape,
  {rs(f"sqrt(avg(pow(ref - {column}, 2)))", 4)} AS rmse FROM cal"""


@query(
    f"""{_STUDY}
{" UNION ALL ".join(_stage_sql(s, c) for s, c in (("raw", "o3"), ("compensated", "comp"), ("calibrated", "cal")))}"""
)
def compensation_plan(spark, sf):
    """Three source files to the error of each stage of the study."""
    return _study(spark, sf).errors.select("stage", *[r(c, 4).alias(c) for c in ("mae", "mape", "rmse")])


@query(
    f"""{_STUDY}
SELECT {ls("ts")} AS ts, {rs("ref", 5)} AS o3_ref, {rs("comp", 5)} AS compensated, {rs("cal", 5)} AS calibrated FROM cal"""
)
def compensation_series(spark, sf):
    out = _study(spark, sf).aligned
    return out.select(
        label("ts").alias("ts"), *[r(c, 5).alias(c) for c in ("o3_ref", "compensated", "calibrated")]
    )


def _study(spark, sf: str):
    """Write the three files of the study and run it on what the readers return."""
    raw = readings(spark, sf)
    ref = grid(spark, sf).where("variable = 'view'").select(
        F.date_format("ts", "yyyy-MM-dd").alias("Fecha"),
        F.hour("ts").alias("Hora"),
        F.lit(None).cast("double").alias("ccaco"),
        (F.col("value") + 1).alias("ccao3"),
        F.lit(None).cast("double").alias("ccapm2"),
    )
    met = raw.select(
        F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("TIMESTAMP"),
        F.col("k").alias("RH_Avg"),
        (F.col("k") / 4).alias("Temp_Avg"),
    )
    sensor = raw.select(
        F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("Timestamp"),
        F.col("value").alias("Ozone_Data"),
        (F.col("k") / 4).alias("Temperature_Data"),
        F.col("k").alias("Relative_Humidity_Data"),
    )
    paths = [write_table(df, scratch_path(spark, n), "csv") for n, df in (("ref", ref), ("met", met), ("sensor", sensor))]
    return compensation_study(
        read_hourly_station(spark, paths[0], STATION),
        read_met_station(spark, paths[1], "MET"),
        read_sensor_2023(spark, paths[2], "S2"),
        period=("2024-01-03 15:01:00", "2024-01-28 14:47:00"),
    )


@query(
    f"""WITH {BASELINE_SQL},
m AS (
  SELECT split, 1 - sum(pow(y - yb, 2)) / (var_pop(y) * count(y)) AS r2, sqrt(avg(pow(y - yb, 2))) AS rmse, avg(abs(y - yb)) AS mae
  FROM based GROUP BY 1
)
SELECT CASE WHEN split = 'train' THEN 1 ELSE 2 END AS pos,
  printf('%-5s: R2=%.3f RMSE=%.2f MAE=%.2f', upper(split[1]) || split[2:], r2, rmse, mae) AS line FROM m
UNION ALL SELECT 0, 'TARGET = O3' UNION ALL SELECT 0, 'baseline'"""
)
def metric_summary_lines(spark, sf):
    """The text report, written and read back."""
    rows = baseline_rows(spark, sf)
    metrics = model_metrics(rows, "O3_ref", {"baseline": "y_baseline"}, by=["split"])
    folder = scratch_path(spark, "summary")
    summary_lines(metrics, "O3").write.parquet(folder)
    back = spark.read.parquet(folder)
    return back.select(F.col("pos").cast("int").alias("pos"), "line")


@query(f"WITH {SPLIT_SQL} SELECT split, count(*) AS n_rows, 0e0 AS max_difference FROM labelled GROUP BY 1")
def model_roundtrip(spark, sf):
    """A saved and reloaded model scores as the fitted one: the largest difference is zero."""
    rows = materialise(labelled_splits(daily(spark, sf), SPEC, SplitSpec()), "splits")
    model = fit_model(rows.where("split = 'train'"), SPEC.features, SPEC.label)
    again = load_model(save_model(model, scratch_path(spark, "model")))
    both = predict(again, predict(model, rows, "a"), "b")
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), r(F.max(F.abs(F.col("a") - F.col("b")))).alias("max_difference")
    )

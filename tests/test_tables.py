import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from aerocal.operators.align import (
    align_by_position,
    compare_sources,
    first_rows,
    fuse,
    outer_join_variables,
    pivot_variables,
    stack_tables,
)
from aerocal.operators.calibrate import impute, two_point_calibrate
from aerocal.operators.quality import (
    coverage_by,
    coverage_total,
    optional_column,
    require_columns,
    require_splits,
)
from aerocal.sinks import write_bucketed, write_monthly
from tests.conftest import column


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pivot_equals_outer_joins_on_unique_keys(spark):
    long = table(
        spark, [(1, "a", 1.0), (2, "a", 2.0), (2, "b", 3.0), (3, "c", None)], "ts int, v string, x double"
    )
    pivot = pivot_variables(long, ["ts"], "v", "x", {"a": "A", "b": "B", "c": "C"})
    parts = [long.where(F.col("v") == v).select("ts", F.col("x").alias(v.upper())) for v in "abc"]
    joined = outer_join_variables(parts, ["ts"])
    assert sorted(pivot.collect()) == sorted(joined.collect()) == [(1, 1.0, None, None), (2, 2.0, 3.0, None), (3, None, None, None)]


def test_outer_join_multiplies_repeated_keys(spark):
    a = table(spark, [(1, 1.0), (1, 2.0)], "ts int, a double")
    b = table(spark, [(1, 5.0), (1, 6.0)], "ts int, b double")
    assert outer_join_variables([a, b], ["ts"]).count() == 4


def test_fuse_keeps_every_sensor_row(spark):
    sensor = table(spark, [(1, 1.0), (2, 2.0)], "ts int, x double")
    ref = table(spark, [(2, 9.0), (3, 9.0)], "ts int, y double")
    assert column(fuse(sensor, ref, ["ts"]), "y") == [None, 9.0]


def test_align_by_position(spark):
    a = table(spark, [(10, 1.0), (30, 3.0), (20, 2.0)], "ts int, a double")
    b = table(spark, [(5, 7.0), (6, 8.0), (7, 9.0)], "ts int, b double")
    assert [tuple(r) for r in align_by_position(a, b).orderBy("ts").collect()] == [
        (10, 1.0, 7.0), (20, 2.0, 8.0), (30, 3.0, 9.0)]
    with pytest.raises(ValueError):
        align_by_position(a, b.where("ts > 5"))
    keyed = a.withColumn("k", F.lit("s")), b.where("ts > 5").withColumn("k", F.lit("s"))
    with pytest.raises(ValueError):
        align_by_position(*keyed, keys=["k"])


def test_compare_sources_lists_every_source_per_time(spark):
    a = table(spark, [(1, 1.0), (2, 2.0)], "ts int, t double")
    b = table(spark, [(2, 5.0)], "ts int, u double")
    out = compare_sources({"a": a, "b": b}, {"temp": {"a": "t", "b": "u"}})
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "temp", "a", 1.0), (1, "temp", "b", None), (2, "temp", "a", 2.0), (2, "temp", "b", 5.0)], key=str
    )


def test_stack_and_preview(spark):
    a = table(spark, [(3, 1.0), (1, 1.0)], "ts int, x double")
    b = table(spark, [(2, 4.0)], "ts int, y double")
    both = stack_tables([a, b])
    assert both.columns == ["ts", "x", "y"] and both.count() == 3
    assert [r.ts for r in first_rows(both, 2).collect()] == [1, 2]


def test_coverage(spark):
    rows = [(dt.datetime(2024, 1, 1), 1.0, None), (dt.datetime(2024, 1, 2), None, None), (dt.datetime(2024, 2, 1), 1.0, 1.0)]
    df = table(spark, rows, "ts timestamp_ntz, a double, b double")
    total = {r.variable: r.coverage for r in coverage_total(df, ["a", "b"]).collect()}
    assert total == pytest.approx({"a": 200 / 3, "b": 100 / 3})
    by = coverage_by(df, F.date_format("ts", "yyyy-MM").alias("m"), ["a", "b"]).orderBy("m").collect()
    assert [tuple(r) for r in by] == [("2024-01", 50.0, 0.0), ("2024-02", 100.0, 100.0)]


def test_guards(spark):
    df = table(spark, [("train", 1)], "split string, x int")
    with pytest.raises(ValueError, match="missing"):
        require_columns(df, ["x", "y"])
    with pytest.raises(ValueError, match="test"):
        require_splits(df)
    assert require_splits(df.unionByName(df.withColumn("split", F.lit("test")))) == {"train": 1, "test": 1}
    assert df.select(optional_column(df, "PM2.5").alias("p")).first()["p"] is None


def test_impute_and_two_point(spark):
    df = table(spark, [("a", 0.0, 20.0), ("a", 5.0, 25.0), ("a", 10.0, 40.0), ("b", 3.0, 1.0)], "k string, raw double, ref double")
    a = df.where("k = 'a'")
    assert column(two_point_calibrate(a, "raw", "ref", "out"), "out", "raw") == [20.0, 30.0, 40.0]
    keyed = two_point_calibrate(df, "raw", "ref", "out", keys=["k"])
    assert {(r.k, r.out) for r in keyed.collect()} == {("a", 20.0), ("a", 30.0), ("a", 40.0), ("b", None)}
    holes = table(spark, [(None,), (4.0,)], "x double")
    assert sorted(r.x for r in impute(holes, ["x"], {"x": 1.5}).collect()) == [1.5, 4.0]
    assert sorted(r.x for r in impute(holes, ["x"], table(spark, [(2.5,)], "x double")).collect()) == [2.5, 4.0]


def test_outer_join_of_many_tables_equals_joins(spark):
    a = table(spark, [(1, "x", 1.0), (1, "x", 2.0), (2, "x", 3.0), (None, "x", 4.0)], "k int, s string, a double")
    b = table(spark, [(1, "x", 5.0), (1, "x", 6.0), (3, "x", 7.0), (None, "x", 8.0)], "k int, s string, b double")
    c = table(spark, [(2, "x", "p", None), (3, "y", "q", 1)], "k int, s string, c string, d int")
    on = ["k", "s"]
    got = outer_join_variables([a, b, c], on)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    want = a.join(b, on, "full").join(c, on, "full")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    with pytest.raises(ValueError):
        outer_join_variables([a, a], on)


def test_bucketed_tables_join_without_a_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = table(spark, [(s, t, s * t) for s in range(3) for t in range(20)], "station int, ts int, x int")
        right = table(spark, [(s, t, s + t) for s in range(3) for t in range(5, 30)], "station int, ts int, y int")
        keys = ["station", "ts"]
        a, b = (write_bucketed(t, f"bucketed_{uuid.uuid4().hex}", keys, 4) for t in (left, right))
        out = fuse(a, b, keys)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, fuse(left, right, keys).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_year_partition_is_that_of_the_source_file(spark, tmp_path):
    rows = [(dt.datetime(2023, 12, 31, 23), "12", 1.0), (dt.datetime(2024, 1, 1, 0), "12", 2.0), (dt.datetime(2024, 1, 1, 1), "01", 3.0), (None, "01", 4.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, month string, x double")
    write_monthly(df, str(tmp_path / "out"), 2024)
    got = {(r.x, r.year, r.month) for r in spark.read.schema("x double, year int, month string").parquet(str(tmp_path / "out")).collect()}
    assert got == {(1.0, 2023, "12"), (2.0, 2023, "12"), (3.0, 2024, "01"), (4.0, 2024, "01")}

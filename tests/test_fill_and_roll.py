"""Filling gaps and trailing means in one sort equal the two steps one after the other."""

import datetime as dt

from aerocal.operators.timeaxis import fill_and_roll, fill_time_gaps, rolling_mean


def _grid(spark):
    rows = []
    for key in ("a", None, "c"):
        for i, day in enumerate([0, 1, 2, 4, 5, 8, 12, 20, 21, 22]):
            x = None if (i + len(key or "")) % 4 == 0 else 0.1 * day * day
            rows.append((key, dt.datetime(2024, 2, 25) + dt.timedelta(days=day), x, float(i)))
    rows.append(("single", dt.datetime(2024, 1, 1), 1.0, None))
    return spark.createDataFrame(rows, "`a key` string, ts timestamp_ntz, `x y` double, z double")


def test_equals_fill_then_rolling(spark):
    grid, keys, columns = _grid(spark), ["a key"], ["x y", "z"]
    for rows in (1, 2, 3, 4):
        want = rolling_mean(fill_time_gaps(grid, keys, every="1 day"), columns, keys, rows=rows)
        for parts in (None, 3):
            got = fill_and_roll(grid, columns, keys, every="1 day", rows=rows, parts=parts)
            assert got.columns == want.columns
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_without_keys(spark):
    grid = _grid(spark).where("`a key` = 'c'").drop("a key")
    want = rolling_mean(fill_time_gaps(grid, [], every="1 day"), ["z"], [])
    got = fill_and_roll(grid, ["z"], [], every="1 day")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_only_the_unopened_rows_are_sorted(spark):
    plan = fill_and_roll(_grid(spark), ["z"], ["a key"], every="1 day")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_parts_grow_with_the_table(spark, tmp_path, monkeypatch):
    from aerocal.catalog import frames

    start = dt.datetime(2001, 3, 1)
    rows = [(s, start + dt.timedelta(days=d), 1000.0 * s, 10.0, 0.01) for s in range(50) for d in range(0, 8, 2)]
    schema = "l_suppkey bigint, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double, l_discount double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(frames, "ROWS_A_PART", 20)
    for frame in (frames.fused, frames.fused_rolling):
        table = frame(spark, str(tmp_path))
        assert table.count() == 50 * 7
        assert table.rdd.getNumPartitions() == 11


def test_bins_are_made_once(spark):
    days = [(1, dt.datetime(2024, 1, d), 1.0) for d in (1, 4, 9)]
    grid = spark.createDataFrame(days, "k int, ts timestamp_ntz, x double")
    filled = fill_and_roll(grid, ["x"], ["k"], every="1 day")
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sequence(") == 1  # no filter makes them again
    assert filled.count() == 9

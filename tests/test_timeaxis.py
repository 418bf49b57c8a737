import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerocal.operators.timeaxis import (
    dedupe_first,
    fill_time_gaps,
    interpolate,
    interpolate_raw,
    numbered,
    resample,
    rolling_mean,
)
from tests.conftest import column


def test_resample_fills_empty_bins_and_drops_null_times(spark):
    rows = [
        ("a", dt.datetime(2024, 1, 1, 0, 10), 1.0),
        ("a", dt.datetime(2024, 1, 1, 2, 59), 3.0),
        ("a", None, 9.0),
    ]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, x double").withColumn("note", F.lit("t"))
    out = resample(df, ["key"])
    assert out.columns == ["key", "ts", "x"]
    assert column(out, "ts") == [dt.datetime(2024, 1, 1, h) for h in range(3)]
    assert column(out, "x") == [1.0, None, 3.0]


def test_resample_skips_nulls_and_keeps_series_apart(spark):
    t = dt.datetime(2024, 1, 1, 5, 30)
    rows = [("a", t, 1.0), ("a", t, None), ("b", t, 5.0), ("b", t + dt.timedelta(hours=2), None)]
    out = resample(spark.createDataFrame(rows, "key string, ts timestamp_ntz, x double"), ["key"])
    got = {(r.key, r.ts.hour): r.x for r in out.collect()}
    assert got == {("a", 5): 1.0, ("b", 5): 5.0, ("b", 6): None, ("b", 7): None}


def test_fill_daily_gaps(spark):
    rows = [("a", dt.datetime(2024, 2, 27), 1.0), ("a", dt.datetime(2024, 3, 1), 2.0)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, x double")
    assert column(fill_time_gaps(df, ["key"], every="1 day"), "x") == [1.0, None, None, 2.0]


def test_rolling_mean(hours):
    df = hours([None, 2.0, None, 4.0, None, None, None, 8.0])
    out = rolling_mean(df, ["x"], ["key"])
    assert column(out, "x_rm3h") == [None, 2.0, 2.0, 3.0, 4.0, 4.0, None, 8.0]


@pytest.mark.parametrize("fill", [interpolate, interpolate_raw])
def test_interpolate(hours, fill):
    df = hours([None, 1.0, None, None, 4.0, None])
    assert column(fill(df, ["x"], ["key"]), "x") == pytest.approx([None, 1.0, 2.0, 3.0, 4.0, 4.0])
    assert column(fill(df, ["x"], ["key"], both=True), "x") == pytest.approx([1.0, 1.0, 2.0, 3.0, 4.0, 4.0])


@pytest.mark.parametrize("fill", [interpolate, interpolate_raw])
def test_interpolate_all_null(hours, fill):
    assert column(fill(hours([None, None, None]), ["x"], ["key"], both=True), "x") == [None] * 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=1, max_size=40),
    st.sampled_from([1, 3, 100]),
    st.booleans(),
)
def test_chunks_equal_whole_series(hours, values, chunk, both):
    df = hours(values).unionByName(hours(list(reversed(values)), key=None))
    whole = {(r.key, r.ts): r.x for r in interpolate(df, ["x"], ["key"], both=both).collect()}
    parts = {(r.key, r.ts): r.x for r in interpolate_raw(df, ["x"], ["key"], both=both, chunk_rows=chunk, group_chunks=2).collect()}
    assert parts.keys() == whole.keys()
    for key, value in whole.items():
        assert parts[key] == (None if value is None else pytest.approx(value))
    known = [v for v in values if v is not None]
    for (key, _), value in parts.items():
        if value is not None:
            assert min(known) - 1e-9 <= value <= max(known) + 1e-9


def test_interpolate_raw_counts_rows_not_time(spark):
    base = dt.datetime(2024, 1, 1)
    minutes = [0, 1, 2, 60 * 30, 60 * 50]
    rows = [("a", base + dt.timedelta(minutes=m), x) for m, x in zip(minutes, [0.0, None, None, None, 4.0])]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, x double")
    assert column(interpolate_raw(df, ["x"], ["key"], chunk_rows=2), "x") == pytest.approx([0, 1, 2, 3, 4])


def test_dedupe_is_deterministic_and_pruned_early(spark):
    rows = [(1, "b", 2), (1, "a", 3), (1, "a", 1), (None, "z", 1), (None, "y", 1)]
    df = spark.createDataFrame(rows, "k int, s string, v int")
    out = dedupe_first(df, ["k"], ["s", "v"])
    assert sorted(out.collect(), key=str) == sorted([(1, "a", 1), (None, "y", 1)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_interpolate_one_hot_series_and_one_dense_instant(spark):
    """Most rows share one series, and most of those one millisecond; no chunk holds more than 50 rows."""
    base = dt.datetime(2024, 1, 1)
    rng = random.Random(6)
    times = [base + dt.timedelta(milliseconds=rng.choice([5] * 8 + [0, 1, 9])) for _ in range(2000)]
    rows = [("hot", t, i, rng.random() if rng.random() < 0.02 else None) for i, t in enumerate(times)]
    rows += [(k, base, i, float(i) if i % 5 == 0 else None) for k in ("a", None) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, i int, x double").repartition(5)
    got = {(r.key, r.i): r.x for r in interpolate_raw(df, ["x"], ["key"], both=True, tie=["i"], chunk_rows=50, group_chunks=3).collect()}
    for key in ("hot", "a", None):
        part = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        known = [n for n, r in enumerate(part) if r[3] is not None]
        want = np.interp(range(len(part)), known, [part[n][3] for n in known])
        assert [got[key, r[2]] for r in part] == pytest.approx(list(want))


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "x", None]), rng.randint(0, 20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, a int, b int").repartition(7)
    got = {r.b: r.place for r in numbered(df, [], ["a", "b"], "place").collect()}
    assert got == {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: r[1:]))}
    got = {r.b: r._rn for r in numbered(df, ["k"], ["a", "b"]).collect()}
    for k in ("hot", "x", None):
        part = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])
        assert [got[r[2]] for r in part] == list(range(1, len(part) + 1))
    same = numbered(spark.createDataFrame([(1,)] * 40, "a int").repartition(3), [], ["a"])
    assert sorted(r._rn for r in same.collect()) == list(range(1, 41))
    assert numbered(df.limit(0), ["k"], ["a"]).collect() == []
    plan = same._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerocal.operators import orderstat
from aerocal.operators.folds import fold_members, fold_starts, with_fold_block
from aerocal.operators.gram import fold_medians
from aerocal.operators.orderstat import exact_medians, values_at_ranks


@pytest.mark.parametrize("leaf_rows", [0, 10**6])
def test_median_averages_the_middle_pair(spark, leaf_rows):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert exact_medians(df, ["x"], leaf_rows=leaf_rows).first()["x"] == 2.5


@pytest.mark.parametrize(
    ("shape", "buckets", "leaf_rows"),
    [
        ("spread", 4096, 100_000), ("spread", 64, 50), ("hot value", 64, 50), ("two values", 64, 0),
        ("one outlier", 4096, 50), ("infinite", 64, 50), ("wide", 4096, 500),
    ],
)
def test_median_by_rank_matches_numpy(spark, shape, buckets, leaf_rows):
    rng = random.Random(7)
    make = {
        "spread": lambda: rng.gauss(0, 1),
        "hot value": lambda: 5.0 if rng.random() < 0.4 else rng.gauss(5, 2),
        "two values": lambda: float(rng.random() < 0.5),
        "one outlier": lambda: 1e18 if rng.random() < 0.01 else rng.random(),
        "infinite": lambda: rng.choice([float("inf"), float("-inf"), 1.0, 2.0, 3.0, 4.0]),
        "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(280, 308),
    }[shape]
    rows = [("hot" if rng.random() < 0.8 else rng.choice("xyz"), make(), make()) for _ in range(4001)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r.k: (r.a, r.b) for r in exact_medians(df, ["a", "b"], ["k"], buckets, leaf_rows).collect()}
    for k in "hot", "x", "y", "z":
        part = np.array([r[1:] for r in rows if r[0] == k])
        assert got[k] == pytest.approx(tuple(np.median(part, axis=0)), abs=0)


def test_median_of_empty_and_null_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), (None, 2.0)], "k string, x double")
    for leaf_rows in (0, 10**6):
        got = {r.k: r.x for r in exact_medians(df, ["x"], ["k"], leaf_rows=leaf_rows).collect()}
        assert got == {"a": None, "b": 1.0, None: 2.0}
    assert exact_medians(df.limit(0), ["x"]).first()["x"] is None
    assert exact_medians(df.limit(0), ["x"], ["k"]).collect() == []


def test_values_at_ranks_reports_counts(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 2, 5, 5, 5, 9]], "x int")
    targets = [lambda n: [F.lit(0)], lambda n: [F.lit(4)], lambda n: [n - 1], lambda n: [F.lit(None)]]
    for leaf_rows in (0, 2, 100):
        found = values_at_ranks(df, "x", targets, leaf_rows=leaf_rows).collect()
        got = {r.target: (r.value, r.n_less, r.n_equal, r.n) for r in found}
        assert got == {0: (1, 0, 2, 7), 1: (5, 3, 3, 7), 2: (9, 6, 1, 7)}


def test_ranks_of_large_integers_and_times(spark):
    big = 2**60
    df = spark.createDataFrame([(big + i, dt.datetime(2024, 1, 1, 0, 0, 0, i)) for i in range(300)], "x long, t timestamp_ntz")
    for leaf_rows in (0, 10**6):
        found = values_at_ranks(df, "x", [lambda n: [F.lit(i) for i in (0, 150, 299)]], leaf_rows=leaf_rows).collect()
        assert {r["rank"]: r.value for r in found} == {i: big + i for i in (0, 150, 299)}
        found = values_at_ranks(df, "t", [lambda n: [F.lit(7)]], buckets=3, leaf_rows=leaf_rows).collect()
        assert [r.value.microsecond for r in found] == [7]
    with pytest.raises(TypeError):
        values_at_ranks(df.select(F.lit("a").alias("x")), "x", [lambda n: [n]])


def test_brackets_that_are_not_few_are_written(spark, monkeypatch):
    monkeypatch.setattr("aerocal.operators.orderstat._HELD_ROWS", 3)
    rng = random.Random(1)
    rows = [(i % 40, rng.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = {r.k: r.x for r in exact_medians(df, ["x"], ["k"], 16, 10).collect()}
    assert got == pytest.approx({k: np.median([x for i, x in rows if i == k]) for k in range(40)}, abs=0)


def _expected(n, splits):
    size = n // (splits + 1)
    return [n - (splits - k) * size for k in range(splits)]


def test_fold_starts(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=i), i) for i in range(11)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, i int")
    starts = fold_starts(df, ["ts"], 4)
    assert [int((s[0] - base).total_seconds() // 3600) for s in starts] == [3, 5, 7, 9] == _expected(11, 4)
    members = fold_members(with_fold_block(df, ["ts"], starts)).collect()
    for fold, start in enumerate([3, 5, 7, 9]):
        assert sorted(m.i for m in members if m.fold == fold and m.role == "test") == [start, start + 1]
        assert sorted(m.i for m in members if m.fold == fold and m.role == "train") == list(range(start))


def test_fold_starts_inside_repeated_times(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.5 else rng.randint(0, 4), rng.randint(0, 3), i) for i in range(203)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    ordered = sorted(rows)
    starts = fold_starts(df, ["a", "b", "c"], 4)
    assert starts == [ordered[i] for i in _expected(203, 4)]


def test_fold_errors(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (1,), (1,), (1,)], "a int")
    with pytest.raises(ValueError):
        fold_starts(df, ["a"], 4)
    with pytest.raises(ValueError):
        fold_starts(df.select(F.when(F.rand(1) < 0.5, 1).alias("a"), F.monotonically_increasing_id().alias("b")), ["a", "b"], 4)
    with pytest.raises(ValueError):
        fold_starts(df.limit(3), ["a"], 4)


@pytest.mark.parametrize("zone", ["UTC", "America/Mexico_City", "Asia/Tokyo"])
def test_fold_blocks_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    base = dt.datetime(1996, 4, 6, 22)  # crosses a clock change in one of the zones
    rows = [(base + dt.timedelta(hours=i), i) for i in range(11)]
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame(rows, "ts timestamp_ntz, i int")
        blocks = with_fold_block(df, ["ts"], fold_starts(df, ["ts"]))
        assert [r.block for r in blocks.orderBy("i").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_brackets_of_keys_without_nulls_join_as_numbers(spark, monkeypatch):
    plans = []
    inside = orderstat._inside

    def spy(*args):
        found = inside(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(orderstat, "_inside", spy)
    rng = random.Random(2)
    rows = [(i % 3, rng.random(), None if i % 5 else rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "block int, a double, b double")
    got = {r.fold: (r.a, r.b) for r in fold_medians(df, ["a", "b"], "block", 3).collect()}
    for k in range(3):
        parts = [[r[c] for r in rows if r[0] <= k and r[c] is not None] for c in (1, 2)]
        assert got[k] == pytest.approx([np.median(p) for p in parts], abs=0)
    assert plans and not any("isnull" in plan.split("BroadcastExchange")[0] for plan in plans)

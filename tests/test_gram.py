"""Grid search from additive sums against a fit per fold, penalty and group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerocal.operators.gram import LinearSetting, fit_linear, fold_errors, grid_errors

SETTINGS = [
    LinearSetting(features, alpha)
    for features in (("a", "b"), ("a", "b", "c"))
    for alpha in (0.0, 0.5, 5.0)
]


def fitted(train, features, alpha):
    """Medians, intercept and slopes of the train rows by dense algebra."""
    x = np.array([[r[c] if r[c] is not None else np.nan for c in features] for r in train])
    medians = np.array([np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else 0.0 for v in x.T])
    x = np.where(np.isnan(x), medians, x)
    y = np.array([r["y"] for r in train])
    scale = x.std(0)
    scale[scale == 0] = 1
    z = (x - x.mean(0)) / scale
    w = np.linalg.pinv(z.T @ z + alpha * np.eye(len(features))) @ z.T @ (y - y.mean()) / scale
    return medians, y.mean() - w @ x.mean(0), w


def brute(rows, k, setting):
    medians, level, w = fitted([r for r in rows if r["block"] <= k], setting.features, setting.alpha)
    test = [r for r in rows if r["block"] == k + 1]
    x = np.array([[r[c] if r[c] is not None else m for c, m in zip(setting.features, medians)] for r in test])
    return np.abs(np.array([r["y"] for r in test]) - level - x @ w).mean()


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for station in ("hot",) * 600 + ("x",) * 60 + (None,) * 50:
        a, b = rng.gauss(1e4, 3), rng.gauss(0, 1e-3)
        c = None if station == "x" else rng.gauss(0, 1)
        y = 3 * a - 500 * b + (c or 0) + rng.gauss(0, 1)
        row = {"station": station, "a": a, "b": b if rng.random() < 0.8 else None, "c": c, "y": y}
        rows.append(row | {"block": rng.randint(0, 4)})
    kinds = "station string, a double, b double, c double, y double, block int"
    extra = [{**rows[0], "y": None}]
    return rows, spark.createDataFrame(rows + extra, kinds).repartition(3)


def test_fold_errors_by_station(table):
    rows, df = table
    got = {(r.station, r.fold, r.setting): r.mae for r in fold_errors(df, "y", SETTINGS, keys=["station"]).collect()}
    want = {
        (s, k, i): brute([r for r in rows if r["station"] == s], k, setting)
        for s in ("hot", "x", None) for k in range(4) for i, setting in enumerate(SETTINGS)
    }
    assert got == pytest.approx(want, rel=1e-6)


def test_fold_errors_of_the_whole_table(table):
    rows, df = table
    errors = fold_errors(df, "y", SETTINGS)
    got = {(r.fold, r.setting): (r.mae, r.n) for r in errors.collect()}
    for (k, i), (mae, n) in got.items():
        assert mae == pytest.approx(brute(rows, k, SETTINGS[i]), rel=1e-6)
        assert n == sum(r["block"] == k + 1 for r in rows)
    means = {r.setting: r.cv_mae for r in grid_errors(errors).collect()}
    assert means[2] == pytest.approx(np.mean([got[k, 2][0] for k in range(4)]))


def test_the_rows_are_aggregated_once_for_all_settings(table):
    plan = fold_errors(table[1], "y", SETTINGS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Join") == 1


def test_fit_by_station(table):
    rows, df = table
    for r in fit_linear(df, "y", SETTINGS, ["station"]).collect():
        setting = SETTINGS[r.setting]
        medians, level, w = fitted([x for x in rows if x["station"] == r.station], setting.features, setting.alpha)
        assert set(r.slopes) == set(setting.features)
        assert [r.slopes[c] for c in setting.features] == pytest.approx(w, rel=1e-5, abs=1e-7)
        assert r.intercept == pytest.approx(level, rel=1e-5)
        assert r.medians["a"] == medians[0]
    whole = fit_linear(df, "y", [LinearSetting(("a", "b", "c"), 1.0)]).first()
    assert whole.slopes["a"] == pytest.approx(fitted(rows, ("a", "b", "c"), 1.0)[2][0])


def test_two_equal_features_and_no_rows(table):
    _, df = table
    twice = df.withColumn("same", F.col("a"))
    one, two = (
        fold_errors(twice, "y", [LinearSetting(f, 0.0)]).orderBy("fold").collect() for f in (("a",), ("a", "same"))
    )
    assert [r.mae for r in two] == pytest.approx([r.mae for r in one], rel=1e-6)
    assert fold_errors(df.limit(0), "y", SETTINGS).collect() == []

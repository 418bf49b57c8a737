import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerocal.config import (
    Candidate,
    ForestParams,
    KernelParams,
    RidgeParams,
    default_candidates,
    target_spec,
)
from aerocal.operators.models import (
    best_of,
    best_row,
    fit_model,
    linear_coefficients,
    predict,
    search,
    search_table,
)
from aerocal.plans.residual import (
    compare_on_month,
    compare_residuals,
    forest_residual,
    prepare_residual,
    score_full_period,
    tuned_residual,
    with_rolling,
)
from aerocal.sinks import save_model, summary_lines, write_metrics, write_summary
from aerocal.sources import load_model

O3 = target_spec("O3")


@pytest.fixture(scope="module")
def sensor(spark):
    """Five months of hourly readings whose reference depends on temperature and humidity."""
    rng = np.random.default_rng(11)
    n = 24 * 153
    hour = np.arange(n)
    temp = 20 + 6 * np.sin(hour * 2 * np.pi / 24) + rng.normal(0, 1, n)
    rh = 55 - 15 * np.sin(hour * 2 * np.pi / 24) + rng.normal(0, 4, n)
    ref = np.clip(40 + 25 * np.sin((hour - 6) * 2 * np.pi / 24) + rng.normal(0, 6, n), 1, None)
    raw = 1.451 * (ref - (0.1034 * temp**2 - 2.225 * temp + 0.01223 * rh**2 - 1.984 * rh + 79)) + rng.normal(0, 8, n)
    raw += 6 * np.sin(temp / 2)
    start = dt.datetime(2025, 3, 1)

    def hole(x, p):
        return None if rng.random() < p else float(x)

    rows = [
        ("s1", start + dt.timedelta(hours=int(h)), hole(a, 0.05), hole(t, 0.05), hole(u, 0.05), hole(y, 0.1))
        for h, a, t, u, y in zip(hour, raw, temp, rh, ref)
    ]
    schema = "sensor_id string, ts timestamp_ntz, O3_lcs_ppb double, Temp_lcs double, RH_lcs double, O3_ref double"
    return with_rolling(spark.createDataFrame(rows, schema), O3).cache()


def arrays(df, *names):
    return np.array([tuple(r) for r in df.select(*names).collect()], dtype=float)


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.5, -2.0, 0.3] + 4 + rng.normal(0, 0.1, 200)
    rows = [(*(None if i % 10 == j else float(v) for j, v in enumerate(r)), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    model = fit_model(df, ["a", "b", "c"], "y")
    filled = np.array([r[:3] for r in rows], dtype=float)
    filled = np.where(np.isnan(filled), np.nanmedian(filled, axis=0), filled)
    design = np.c_[np.ones(200), filled]
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    got = linear_coefficients(model, ["a", "b", "c"])
    assert list(got.values()) == pytest.approx(list(want))
    assert predict(model, df, "p").columns == [*df.columns, "p"]


@pytest.mark.parametrize("alpha", [0.5, 5.0, 200.0])
def test_ridge_matches_closed_form(spark, alpha):
    rng = np.random.default_rng(1)
    x = rng.normal(3, [1, 5, 0.2], size=(120, 3))
    y = x @ [2.0, 0.1, -7.0] + rng.normal(0, 1, 120)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    z = x / x.std(axis=0)
    zc, yc = z - z.mean(axis=0), y - y.mean()
    w = np.linalg.solve(zc.T @ zc + alpha * np.eye(3), zc.T @ yc)
    got = linear_coefficients(fit_model(df, ["a", "b", "c"], "y", RidgeParams(alpha)), ["a", "b", "c"])
    assert list(got.values()) == pytest.approx([y.mean() - z.mean(axis=0) @ w, *w], rel=1e-6)


def test_feature_without_values_is_left_out(spark):
    df = spark.createDataFrame([(float(i), None, 2.0 * i) for i in range(20)], "a double, b double, y double")
    model = fit_model(df, ["a", "b"], "y")
    assert linear_coefficients(model, ["a"])["a"] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        fit_model(df, ["b"], "y")
    with pytest.raises(ValueError):
        fit_model(df.limit(0), ["a"], "y")


def test_forest_and_kernel_learn_a_curve(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-3, 3, 900)
    y = np.sin(x) * 10 + rng.normal(0, 0.5, 900)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    for params in (ForestParams(trees=30, max_depth=8), KernelParams(c=10.0, landmarks=64)):
        out = arrays(predict(fit_model(df, ["x"], "y", params), df, "p"), "y", "p")
        assert 1 - ((out[:, 0] - out[:, 1]) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.97


def test_saved_models_score_alike(spark, sensor, tmp_path):
    train = sensor.where(F.col("O3_ref").isNotNull())
    for i, params in enumerate((None, ForestParams(trees=5, max_depth=4), KernelParams(landmarks=16, max_iter=10))):
        model = fit_model(train, O3.features, O3.label, params)
        again = load_model(save_model(model, str(tmp_path / str(i))))
        both = arrays(predict(again, predict(model, train, "a"), "b"), "a", "b")
        assert np.array_equal(both[:, 0], both[:, 1])


def test_compensated_baseline_fits_train_only(sensor):
    baseline, rows = prepare_residual(sensor, O3)
    train = arrays(rows.where("split = 'train'"), *O3.features, O3.label, "y_baseline")
    x = np.where(np.isnan(train[:, :3]), np.nanmedian(train[:, :3], axis=0), train[:, :3])
    comp = x[:, 0] / 1.451 + 0.1034 * x[:, 1] ** 2 - 2.225 * x[:, 1] + 0.01223 * x[:, 2] ** 2 - 1.984 * x[:, 2] + 79
    beta, alpha = np.polyfit(comp, train[:, 3], 1)
    assert (baseline.params["alpha"], baseline.params["beta"]) == pytest.approx((alpha, beta))
    assert train[:, 4] == pytest.approx(alpha + beta * comp)
    gap = arrays(rows, O3.label, "y_baseline", "residual")
    assert gap[:, 0] - gap[:, 1] == pytest.approx(gap[:, 2])


def test_search_scores_every_fold_and_uses_train_statistics_only(spark):
    # The last block holds an absurd value: fits on earlier blocks must not see it.
    rows = [(float(i % 7), 2.0 * (i % 7), min(i // 10, 4)) for i in range(49)] + [(1e9, 0.0, 4)]
    df = spark.createDataFrame(rows, "x double, y double, block int").withColumn("yb", F.lit(0.0))
    found = search(df, ["x"], "yb", "y", [Candidate("Ridge", (RidgeParams(1e-9), RidgeParams(50.0)))])
    assert [len(r["fold_mae"]) for r in found] == [4, 4]
    assert found[0]["fold_mae"][:3] == pytest.approx([0, 0, 0], abs=1e-6)
    assert found[0]["fold_mae"][3] > 1e6
    assert best_of(found)["params"] == min(found, key=lambda r: r["cv_mae"])["params"]
    assert best_row(search_table(spark, found)).first()["cv_mae"] == pytest.approx(best_of(found)["cv_mae"])


def test_first_setting_wins_ties():
    table = [{"cv_mae": 2.0, "i": 0}, {"cv_mae": 1.0, "i": 1}, {"cv_mae": 1.0, "i": 2}]
    assert best_of(table)["i"] == 1


def test_default_grid_has_forty_settings():
    assert [len(c.grid) for c in default_candidates()] == [16, 16, 4, 4]


def test_tuned_study_beats_its_baseline_and_scores_the_period(spark, sensor, tmp_path):
    grid = (Candidate("RF_v2", (ForestParams(trees=20, max_depth=6, min_leaf=5, max_bins=64),), True),
            Candidate("Ridge_v1", (RidgeParams(1.0),), False))
    study = tuned_residual(sensor, O3, candidates=grid)
    mae = {(r.split, r.model): r.mae for r in study.metrics.collect()}
    name = study.models[0].name
    assert mae["test", name] < mae["test", "baseline"]
    assert study.search.count() == 2

    full = score_full_period(sensor, study)
    assert full.count() == sensor.count()
    hat, final = f"O3_{name}_residual_hat", f"O3_{name}_final"
    bad = full.where(~(F.col(final).eqNullSafe(F.col("O3_baseline_cal") + F.col(hat))))
    assert bad.count() == 0
    no_raw = full.where("coalesce(O3_lcs_ppb, Temp_lcs, RH_lcs) IS NULL")
    assert no_raw.where("O3_baseline_cal IS NOT NULL").count() == 0
    assert full.where("O3_baseline_imputed AND O3_baseline_cal IS NOT NULL").count() == 0

    july = compare_on_month(full, O3, [name])
    compared = {r.model: r.mae for r in july["metrics"].collect()}
    labelled = full.where((F.month("ts") == 7) & F.col("O3_ref").isNotNull())
    got = arrays(labelled.dropna(subset=[final]), "O3_ref", final)
    assert compared[name] == pytest.approx(np.abs(got[:, 0] - got[:, 1]).mean())
    assert july["points"].count() == 400

    lines = [r.line for r in summary_lines(study.metrics, "O3").orderBy("model", "pos").collect()]
    assert lines[0] == "TARGET = O3" and len(lines) == 7
    first = study.metrics.where("model = 'baseline' AND split = 'train'").first()
    assert f"Train: R2={first.r2:.3f} RMSE={first.rmse:.2f} MAE={first.mae:.2f}" in lines
    text = spark.read.text(write_summary(study.metrics, "O3", str(tmp_path / "t"))).count()
    assert text == 7
    assert spark.read.json(write_metrics(study.metrics, str(tmp_path / "j"))).count() == 4


def test_full_scope_refits_medians(sensor):
    study = forest_residual(sensor, O3, params=ForestParams(trees=5, max_depth=4))
    train = score_full_period(sensor, study).where("O3_lcs_ppb IS NULL AND Temp_lcs IS NOT NULL").count()
    full = score_full_period(sensor, study, impute_scope="full")
    assert full.where("O3_lcs_ppb IS NULL AND Temp_lcs IS NOT NULL").count() == train


def test_comparison_of_forest_and_kernel(sensor):
    study = compare_residuals(
        sensor, O3, forest=ForestParams(trees=20, max_depth=6, min_leaf=5, max_bins=64),
        kernel_grid=(KernelParams(c=1.0, landmarks=32, max_iter=20), KernelParams(c=10.0, landmarks=32, max_iter=20)),
    )
    mae = {(r.split, r.model): r.mae for r in study.metrics.collect()}
    assert {m for _, m in mae} == {"baseline", "forest", "kernel"}
    assert mae["test", "kernel"] < mae["test", "baseline"]


def test_co_target_uses_linear_baseline(sensor):
    co = target_spec("CO")
    table = sensor.withColumnsRenamed({"O3_lcs_ppb": "CO_lcs_ppm", "O3_ref": "CO_ref"})
    baseline, rows = prepare_residual(table, co)
    assert baseline.model is not None and rows.where("y_baseline IS NULL").count() == 0
    scored = baseline.apply(table)
    assert scored.where("y_baseline IS NULL").count() == table.where("coalesce(CO_lcs_ppm, Temp_lcs, RH_lcs) IS NULL").count()


def test_empty_split_is_an_error(sensor):
    with pytest.raises(ValueError, match="test"):
        prepare_residual(sensor.where(F.month("ts") < 7), O3)

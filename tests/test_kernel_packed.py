"""Rows of a kernel fit are written once as arrays of one block each; steps and errors read only those."""

import datetime as dt

import numpy as np
import pytest

from aerocal.config import ForestParams, KernelParams, target_spec
from aerocal.operators import kernel
from aerocal.operators.kernel import KernelFit, PackedRows, fit_kernels, fold_error, landmark_inputs
from aerocal.operators.models import Preparation
from aerocal.plans.residual import compare_residuals, with_rolling


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, float(x), float(np.sin(x)), i % 4) for i, x in enumerate(rng.uniform(-2, 2, 400))]
    odd = [(400, None, 0.3, 1), (401, 1.0, None, 2), (402, 1.5, 9.0, None), (403, 0.5, 0.5, 3), (403, 0.5, 0.5, 3)]
    return spark.createDataFrame([*data, *odd], "i int, x double, y double, block int").repartition(3)


def fits(rows, last):
    train = rows.where("y IS NOT NULL").where(f"block <= {last}" if last is not None else "true")
    params = KernelParams(landmarks=5, max_iter=6, tolerance=0.0)
    return KernelFit(landmark_inputs(train, ["x"], Preparation.fit(train, ["x"], "y", True), params, ["i"], last), params)


def opened(packed):
    out = []
    for row in packed.frame.collect():
        values = np.frombuffer(row["data"]).reshape(len(packed.names), -1)
        out += [(row["block"], *(None if np.isnan(v) else v for v in one)) for one in values.T]
    return out


def test_every_row_with_a_label_is_packed_once(rows, monkeypatch):
    monkeypatch.setattr(kernel, "PACK_BYTES", 16 * 7)  # seven rows of two numbers
    packed = PackedRows.of(rows, ["x"], "y", "block")
    nowhere = np.iinfo(np.int32).max
    want = [(nowhere if r.block is None else r.block, r.x, r.y) for r in rows.where("y IS NOT NULL").collect()]
    key = lambda r: (r[0], r[1] is not None, r[1] or 0.0, r[2])
    assert sorted(opened(packed), key=key) == sorted(want, key=key)
    assert max(len(r["data"]) for r in packed.frame.collect()) == 16 * 7


def test_steps_and_errors_read_the_packed_rows(rows, monkeypatch):
    apart, together = [fits(rows, k) for k in range(3)], [fits(rows, k) for k in range(3)]
    for f in apart:
        fit_kernels(rows, [f], "y", "block")
    packed = PackedRows.of(rows, ["x"], "y", "block")
    monkeypatch.setattr(PackedRows, "of", None)  # nothing is packed again
    fit_kernels(packed, together, "y")
    errors = fold_error(packed, together, "y", "block")
    pairs = rows.where("y IS NOT NULL").toPandas()
    for k, (a, b) in enumerate(zip(apart, together)):
        assert b.objectives == pytest.approx(a.objectives, rel=1e-6)
        test = pairs[pairs["block"] == k + 1]
        z = np.vstack([z for _, z in b.inputs.expand(test)])
        assert errors[k] == pytest.approx(np.abs(test["y"].to_numpy() - z @ b.weights).mean())


def test_rows_without_a_block_count_where_all_rows_do(rows):
    one = fits(rows, None)
    fit_kernels(rows, [one], "y")
    y = rows.where("y IS NOT NULL").toPandas()["y"].to_numpy()
    assert one.objectives[0] == pytest.approx(np.maximum(np.abs(y) - one.params.epsilon, 0).sum())


def test_several_fits_add_up_together():
    rng = np.random.default_rng(1)
    z, y, w = rng.normal(size=(50, 4)), rng.normal(size=50), rng.normal(size=(3, 4))
    apart = np.vstack([kernel._weighted(z, y, one, 0.1) for one in w])
    assert kernel._weighted(z, y, w, np.full((3, 1), 0.1)) == pytest.approx(apart)


def test_a_comparison_packs_its_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    start = dt.datetime(2024, 3, 1)
    data = [(start + dt.timedelta(days=i), *(float(v) for v in rng.uniform(0, 9, 4)), 1) for i in range(150)]
    grid = spark.createDataFrame(data, "ts timestamp_ntz, O3_lcs_ppb double, Temp_lcs double, RH_lcs double, O3_ref double, sensor_id int")
    made = []
    write = PackedRows.of
    monkeypatch.setattr(PackedRows, "of", lambda *a, **k: made.append(write(*a, **k)) or made[-1])
    few = (KernelParams(c=1.0, landmarks=4, max_iter=2), KernelParams(c=5.0, landmarks=4, max_iter=2))
    forest = ForestParams(trees=1, max_depth=2, min_leaf=5, max_bins=8)
    spec = target_spec("O3")
    study = compare_residuals(with_rolling(grid, spec), spec, forest=forest, kernel_grid=few)
    assert study.metrics.count() == 6 and len(made) == 1
    assert sum(len(r["data"]) for r in made[0].frame.collect()) == 8 * 8 * study.scored.where("split = 'train'").count()

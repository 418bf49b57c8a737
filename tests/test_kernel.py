import numpy as np
import pytest

from aerocal.config import KernelParams
from aerocal.operators.kernel import KernelFit, fit_kernels, kernel_values, landmark_inputs
from aerocal.operators.models import Preparation, fit_model


@pytest.fixture(scope="module")
def rows(spark):
    """A curve with noise, a null, and one reading that holds a third of the rows."""
    rng = np.random.default_rng(3)
    x = [float(v) for v in rng.uniform(-2, 2, 200)] + [0.5] * 100
    data = [(i, v, float(np.sin(2 * v) + rng.normal(0, 0.05))) for i, v in enumerate(x)]
    return spark.createDataFrame([*data, (300, None, 0.1), (301, 1.0, None)], "i int, x double, y double")


def objective(fit, x, y):
    z = kernel_values(x, fit.inputs.marks, fit.inputs.gamma) @ fit.inputs.root

    def at(w):
        out = np.abs(y - z @ w[:-1] - w[-1]) - fit.params.epsilon
        return 0.5 * w[:-1] @ w[:-1] + fit.params.c * np.maximum(out, 0).sum()

    return at


def test_steps_reach_the_minimum(rows):
    train = rows.where("y IS NOT NULL")
    params = KernelParams(c=2.0, landmarks=12, max_iter=60, tolerance=1e-7)
    fit = KernelFit(landmark_inputs(train, ["x"], Preparation.fit(train, ["x"], "y", True), params, ["i"]), params)
    fit_kernels(train, [fit], "y")
    seen = fit.objectives
    assert all(b <= a + 1e-3 for a, b in zip(seen, seen[1:]))
    pairs = train.toPandas()
    at = objective(fit, fit.inputs.standard(pairs), pairs["y"].to_numpy())
    assert at(fit.weights) == pytest.approx(seen[-1], rel=1e-6)
    rng = np.random.default_rng(0)
    for size in (1e-3, 1e-2, 1e-1, 1.0):
        for _ in range(50):
            assert at(fit.weights + rng.normal(0, size, len(fit.weights))) >= seen[-1] * 0.995


def test_landmarks_may_be_equal_and_fewer_than_asked(spark):
    same = spark.createDataFrame([(1.0, 2.0)] * 5 + [(2.0, 3.0)], "x double, y double")
    params = KernelParams(c=100.0, landmarks=20, epsilon=0.01)
    model = fit_model(same, ["x"], "y", params)
    got = {r.x: r._prediction for r in model.transform(same).collect()}
    assert got[1.0] == pytest.approx(2.0, abs=0.05) and got[2.0] == pytest.approx(3.0, abs=0.05)


def test_no_rows_is_an_error(rows):
    with pytest.raises(ValueError, match="no training rows"):
        fit_model(rows.where("false"), ["x"], "y", KernelParams())

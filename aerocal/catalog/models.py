"""Fitted models. Exact ones carry SQL; forests and the searched kernel model are row checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.catalog.frames import BASELINE_SQL, SPEC, SPLIT_SQL, daily, fresh_name, fused, fused_rolling
from aerocal.catalog.registry import label, ls, query, r, rs
from aerocal.catalog.statistics import fitted_baseline
from aerocal.config import Candidate, ForestParams, KernelParams, RidgeParams, SplitSpec, default_ridge_grid, ridge_candidates, target_spec
from aerocal.functions import all_present
from aerocal.operators.calibrate import apply_compensated_baseline
from aerocal.operators.evaluate import model_metrics
from aerocal.operators.folds import fold_starts, with_fold_block
from aerocal.operators.kernel import KernelFit, fit_kernels, landmark_column, landmark_inputs
from aerocal.operators.models import (
    Preparation,
    best_row,
    fit_model,
    labelled_splits,
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
)
from aerocal.session import materialise
from aerocal.sinks import write_bucketed

_FEATURES = ("fo3", "ft", "fh")
_ORDER = ("ts", "sensor_id")


def _det3(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"(({a}) * (({e}) * ({i}) - ({f}) * ({h})) - ({b}) * (({d}) * ({i}) - ({f}) * ({g})) + ({c}) * (({d}) * ({h}) - ({e}) * ({g})))"


def _solve_sql(y: str, source: str, alpha: float = 0.0, scaled: bool = False, tag: str = "") -> str:
    """SQL of a three-feature least-squares or ridge fit, by determinants."""
    x = [f"({c} / s{i})" if scaled else c for i, c in enumerate(_FEATURES)]
    stats = ", ".join(f"(SELECT stddev_pop({c}) FROM {source} WHERE split = 'train') AS s{i}" for i, c in enumerate(_FEATURES))
    cov = [f"covar_pop({x[i]}, {x[j]}) AS c{i}{j}" for i in range(3) for j in range(i, 3)]
    rhs = [f"covar_pop({x[i]}, {y}) AS b{i}" for i in range(3)]
    means = [f"avg({x[i]}) AS m{i}" for i in range(3)]

    def c(i: int, j: int) -> str:
        entry = f"c{min(i, j)}{max(i, j)}"
        return f"{entry} + {alpha}e0 / n" if i == j and alpha else entry

    matrix = [[c(i, j) for j in range(3)] for i in range(3)]
    det = _det3(matrix)
    weights = [
        _det3([[f"b{i}" if j == k else matrix[i][j] for j in range(3)] for i in range(3)]) + f" / {det} AS w{k}"
        for k in range(3)
    ]
    return f"""
scales{tag} AS (SELECT {stats}),
mom{tag} AS (SELECT count(*) AS n, avg({y}) AS my, {", ".join(cov + rhs + means)}
        FROM {source}, scales{tag} WHERE split = 'train'),
w{tag} AS (SELECT {", ".join(weights)}, m0, m1, m2, my FROM mom{tag}),
coef{tag} AS (SELECT w0, w1, w2, my - w0 * m0 - w1 * m1 - w2 * m2 AS intercept FROM w{tag})"""


_OLS = f"""{SPLIT_SQL}, {_solve_sql("y", "filled")},
scored AS (SELECT f.*, intercept + w0 * fo3 + w1 * ft + w2 * fh AS pred FROM filled f, coef)"""


def _splits(spark, sf) -> DataFrame:
    """Labelled rows, written once: a fit reads them several times."""
    return materialise(labelled_splits(daily(spark, sf), SPEC, SplitSpec()), "splits")


def _coefficients(spark, model) -> DataFrame:
    rows = sorted(linear_coefficients(model, SPEC.features).items())
    return spark.createDataFrame(rows, "term string, value double").select("term", r("value").alias("value"))


_COEF_ROWS = f"""SELECT 'intercept' AS term, {rs("intercept")} AS value FROM coef
UNION ALL SELECT '{SPEC.features[0]}', {rs("w0")} FROM coef
UNION ALL SELECT '{SPEC.features[1]}', {rs("w1")} FROM coef
UNION ALL SELECT '{SPEC.features[2]}', {rs("w2")} FROM coef"""


@query(f"WITH {_OLS} {_COEF_ROWS}")
def ols_coefficients(spark, sf):
    model = fit_model(_splits(spark, sf).where("split = 'train'"), SPEC.features, SPEC.label)
    return _coefficients(spark, model)


@query(
    f"""WITH {_OLS}
SELECT split, 'linear' AS model, {rs("1 - sum(pow(y - pred, 2)) / (var_pop(y) * count(y))")} AS r2,
  {rs("sqrt(avg(pow(y - pred, 2)))")} AS rmse, {rs("avg(abs(y - pred))")} AS mae, count(*) AS n
FROM scored GROUP BY 1"""
)
def ols_baseline(spark, sf):
    rows = _splits(spark, sf)
    model = fit_model(rows.where("split = 'train'"), SPEC.features, SPEC.label)
    out = model_metrics(predict(model, rows, "pred"), SPEC.label, {"linear": "pred"}, by=["split"])
    return out.select("split", "model", *[r(c).alias(c) for c in ("r2", "rmse", "mae")], "n")


@query(
    f"""WITH {_OLS}
SELECT f.sensor_id, {ls("f.ts")} AS ts,
  {rs("CASE WHEN o3 IS NOT NULL AND t IS NOT NULL AND h IS NOT NULL THEN intercept + w0 * o3 + w1 * t + w2 * h END", 4)} AS O3_baseline_cal
FROM fused f, coef"""
)
def full_period_linear(spark, sf):
    """The linear baseline over all rows whose features are all present."""
    rows = fused(spark, sf)
    model = fit_model(_splits(spark, sf).where("split = 'train'"), SPEC.features, SPEC.label)
    return _calibrated(predict(model, rows, "O3_baseline_cal", where=all_present(SPEC.features)))


def _calibrated(scored: DataFrame) -> DataFrame:
    return scored.select("sensor_id", label("ts").alias("ts"), r("O3_baseline_cal", 4).alias("O3_baseline_cal"))


def _by_month(scored: DataFrame) -> DataFrame:
    v = F.col("O3_baseline_cal")
    return scored.groupBy("sensor_id", F.month("ts").cast("long").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_scored"), r(F.avg(v), 4).alias("mean_cal"),
        r(F.min(v), 4).alias("low_cal"), r(F.max(v), 4).alias("high_cal"),
    )


@query(
    f"""WITH {BASELINE_SQL}, res AS (SELECT *, y - yb AS e FROM based), {_solve_sql("e", "res", 5.0, True)}
{_COEF_ROWS}"""
)
def ridge_residual(spark, sf):
    """Ridge on the scaled features, fitted to the residual of the baseline."""
    _, rows = prepare_residual(daily(spark, sf), SPEC)
    model = fit_model(rows.where("split = 'train'"), SPEC.features, "residual", RidgeParams(5.0))
    return _coefficients(spark, model)


_ALPHAS = tuple(p.alpha for p in default_ridge_grid())


def _fold_sql(k: int) -> str:
    """Rows of fold k with the medians of its train blocks filled in."""
    return f"""
med{k} AS (SELECT median(o3) AS a, median(t) AS b, median(h) AS c FROM blocks WHERE block <= {k}),
fold{k} AS (
  SELECT e, CASE WHEN block <= {k} THEN 'train' ELSE 'test' END AS split,
    coalesce(o3, a) AS fo3, coalesce(t, b) AS ft, coalesce(h, c) AS fh
  FROM blocks, med{k} WHERE block <= {k + 1}
)"""


def _fold_mae_sql(k: int, alpha: float) -> str:
    tag = f"_{k}_{_ALPHAS.index(alpha)}"
    return f"""
SELECT {alpha}e0 AS alpha, avg(abs(e - (intercept + w0 * fo3 / s0 + w1 * ft / s1 + w2 * fh / s2))) AS mae
FROM fold{k}, scales{tag}, coef{tag} WHERE split = 'test'"""


_SEARCH = f"""{BASELINE_SQL},
ranked AS (
  SELECT o3, t, h, y - yb AS e, row_number() OVER (ORDER BY ts, sensor_id) - 1 AS rn, count(*) OVER () AS n
  FROM based WHERE split = 'train'
),
blocks AS (SELECT *, CASE WHEN rn < n - 4 * (n // 5) THEN 0 ELSE 1 + (rn - (n - 4 * (n // 5))) // (n // 5) END AS block FROM ranked),
{",".join(_fold_sql(k) for k in range(4))},
{",".join(_solve_sql("e", f"fold{k}", a, True, f"_{k}_{i}") for k in range(4) for i, a in enumerate(_ALPHAS))},
maes AS ({" UNION ALL ".join(_fold_mae_sql(k, a) for k in range(4) for a in _ALPHAS)})"""


@query(f"WITH {_SEARCH} SELECT 'alpha=' || alpha AS params, {rs('avg(mae)')} AS cv_mae FROM maes GROUP BY alpha")
def ridge_search(spark, sf):
    """Every ridge penalty over four temporal folds, medians and scales fitted per fold."""
    _, rows = prepare_residual(daily(spark, sf), SPEC)
    train = rows.where("split = 'train'")
    blocks = with_fold_block(train, _ORDER, fold_starts(train, _ORDER))
    grid = [Candidate("Ridge", default_ridge_grid())]
    found = search(blocks, SPEC.features, "y_baseline", "residual", grid)
    return search_table(spark, found).select("params", r("cv_mae").alias("cv_mae"))


@query(
    f"""WITH {_SEARCH}, best AS (SELECT alpha, avg(mae) AS cv_mae FROM maes GROUP BY 1)
SELECT 'Ridge' AS candidate, 'alpha=' || alpha AS params, {rs("cv_mae")} AS cv_mae FROM best
ORDER BY best.cv_mae, alpha LIMIT 1"""
)
def best_ridge(spark, sf):
    """The penalty with the smallest mean error."""
    _, rows = prepare_residual(daily(spark, sf), SPEC)
    train = rows.where("split = 'train'")
    blocks = with_fold_block(train, _ORDER, fold_starts(train, _ORDER))
    found = search(blocks, SPEC.features, "y_baseline", "residual", [Candidate("Ridge", default_ridge_grid())])
    best = best_row(search_table(spark, found))
    return best.select("candidate", "params", r("cv_mae").alias("cv_mae"))


_MONTH = f"""WITH {BASELINE_SQL}, {_solve_sql("y", "filled")},
july AS (SELECT y, yb, intercept + w0 * fo3 + w1 * ft + w2 * fh AS lin FROM based, coef WHERE month(ts) = 7)"""


def _month_sql(model: str, column: str) -> str:
    return f"""SELECT '{model}' AS model, {rs(f"1 - sum(pow(y - {column}, 2)) / (var_pop(y) * count(y))")} AS r2,
  {rs(f"sqrt(avg(pow(y - {column}, 2)))")} AS rmse, {rs(f"avg(abs(y - {column}))")} AS mae, count(*) AS n,
  {rs(f"regr_slope({column}, y)")} AS slope, {rs(f"regr_intercept({column}, y)")} AS intercept FROM july"""


@query(f"{_MONTH} {_month_sql('baseline', 'yb')} UNION ALL {_month_sql('linear', 'lin')}")
def month_comparison(spark, sf):
    """Metrics and trend lines of two exported models in July."""
    rows, params = fitted_baseline(spark, sf)
    linear = fit_model(rows.where("split = 'train'"), SPEC.features, SPEC.label)
    exported = apply_compensated_baseline(daily(spark, sf), SPEC, params, "O3_baseline_cal", everywhere=True)
    got = compare_on_month(predict(linear, exported, "O3_linear_final"), SPEC, ["linear"])
    out = got["metrics"].join(got["lines"], "model")
    return out.select(
        "model", *[r(c).alias(c) for c in ("r2", "rmse", "mae")], "n", *[r(c).alias(c) for c in ("slope", "intercept")]
    )


def _metric_rows(metrics: DataFrame) -> DataFrame:
    return metrics.select("split", "model", *[r(c, 4).alias(c) for c in ("r2", "rmse", "mae")], "n")


@query()
def rf_direct(spark, sf):
    rows = _splits(spark, sf)
    params = ForestParams(trees=20, max_depth=8, min_leaf=2, max_bins=64)
    model = fit_model(rows.where("split = 'train'"), SPEC.features, SPEC.label, params)
    return _metric_rows(
        model_metrics(predict(model, rows, "pred"), SPEC.label, {"forest": "pred"}, by=["split"])
    )


@query()
def rf_residual(spark, sf):
    params = ForestParams(trees=20, max_depth=8, min_leaf=2, max_bins=64)
    return _metric_rows(forest_residual(daily(spark, sf), SPEC, params=params).metrics)


_SMALL_FOREST = ForestParams(trees=15, max_depth=6, min_leaf=5, max_bins=64)


@query()
def rbf_residual(spark, sf):
    """Fixed forest beside the kernel model, its penalty chosen by temporal folds."""
    table = fused_rolling(spark, sf)
    study = compare_residuals(table, SPEC, forest=_SMALL_FOREST, order=_ORDER)
    return _metric_rows(study.metrics)


def _marks_sql(count: int) -> str:
    """Train rows standardised (z) and the ``count`` landmarks among them, as one row (mk)."""
    x = [f"(f{c} - a_{c}) / s_{c} AS x{i}" for i, c in enumerate(("o3", "t", "h"))]
    stats = [f"avg(f{c}) AS a_{c}, stddev_pop(f{c}) AS s_{c}" for c in ("o3", "t", "h")]
    wide = [f"max(CASE WHEN j = {j} THEN x{i} END) AS z{j}_{i}" for j in range(count) for i in range(3)]
    return f"""{SPLIT_SQL},
tr AS (SELECT * FROM filled WHERE split = 'train'),
st AS (SELECT {", ".join(stats)} FROM tr),
z AS (SELECT sensor_id, ts, y, {", ".join(x)} FROM tr, st),
marks AS (
  SELECT row_number() OVER (ORDER BY key) - 1 AS j, x0, x1, x2
  FROM (SELECT *, md5(CAST(sensor_id AS VARCHAR) || '|' || {ls("ts")}) AS key FROM z) ORDER BY key LIMIT {count}
),
mk AS (SELECT {", ".join(wide)} FROM marks)"""


def _kernel_sql(a: Sequence[str], b: Sequence[str]) -> str:
    far = " + ".join(f"pow({u} - {v}, 2)" for u, v in zip(a, b))
    return f"exp(-({far}) / 3e0)"


_KEYS = ("sensor_id", "ts")


def _kernel_inputs(train: DataFrame, params: KernelParams):
    prep = Preparation.fit(train, SPEC.features, SPEC.label, scaled=True)
    return landmark_inputs(train, SPEC.features, prep, params, _KEYS)


_LANDMARKS = 8
_LANDMARK_ROWS = " UNION ALL ".join(
    f"SELECT {j} AS landmark, count(*) AS n, {rs(f'avg(k{j})')} AS mean_kernel, {rs(f'stddev_pop(k{j})')} AS spread FROM kk"
    for j in range(_LANDMARKS)
)


@query(
    f"""WITH {_marks_sql(_LANDMARKS)},
kk AS (SELECT {", ".join(_kernel_sql([f"x{i}" for i in range(3)], [f"z{j}_{i}" for i in range(3)]) + f" AS k{j}" for j in range(_LANDMARKS))}
       FROM z, mk)
{_LANDMARK_ROWS}"""
)
def kernel_features(spark, sf):
    """How near the train rows are to each landmark of a kernel model."""
    train = _splits(spark, sf).where("split = 'train'")
    inputs = _kernel_inputs(train, KernelParams(landmarks=_LANDMARKS))
    near = landmark_column(inputs, [F.col(c).cast("double") for c in inputs.features])
    rows = train.select(F.posexplode(near).alias("landmark", "k"))
    return rows.groupBy("landmark").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("k")).alias("mean_kernel"), r(F.stddev_pop("k")).alias("spread")
    )


_FEW = KernelParams(c=5.0, landmarks=3, max_iter=4, tolerance=0.0)


def _objective_sql(params: KernelParams) -> str:
    """The steps of the kernel fit as systems of four unknowns, and the objective before each."""
    m, floor = params.landmarks, "0.001e0"
    x = [f"x{i}" for i in range(3)]
    marks = [[f"z{j}_{i}" for i in range(3)] for j in range(m)]
    gram = [f"{_kernel_sql(marks[i], marks[j])} AS q{i}_{j}" for i in range(m) for j in range(m)]
    parts = [f"""WITH {_marks_sql(m)},
kk AS (SELECT y, 1e0 AS k{m}, {", ".join(_kernel_sql(x, marks[j]) + f" AS k{j}" for j in range(m))} FROM z, mk),
gram AS (SELECT {", ".join(gram)} FROM mk),
v0 AS (SELECT {", ".join(f"0e0 AS a{i}" for i in range(m + 1))})"""]
    ks = ", ".join(f"k{j}" for j in range(m + 1))
    size = " + ".join(f"a{i} * a{j} * q{i}_{j}" for i in range(m) for j in range(m))
    for s in range(params.max_iter + 1):
        guess = " + ".join(f"a{i} * k{i}" for i in range(m + 1))
        parts.append(f"""r{s} AS (SELECT {ks}, y, y - ({guess}) AS r, greatest(abs(abs(y - ({guess})) - {params.epsilon}e0), {floor}) AS corner FROM kk, v{s}),
w{s} AS (SELECT {ks}, y, (1 / greatest(abs(r), {floor}) + 1 / corner) / 2 AS w, {params.epsilon}e0 * sign(r) / (2 * corner) AS q FROM r{s}),
o{s} AS (SELECT ({size}) / 2 + {params.c}e0 * loss AS objective
  FROM v{s}, gram, (SELECT sum(greatest(abs(r) - {params.epsilon}e0, 0)) AS loss FROM r{s}))""")
        cells = [f"sum(w * k{i} * k{j})" + (f" + max(q{i}_{j}) / {params.c}e0" if max(i, j) < m else "") + f" AS v{i}_{j}"
                 for i in range(m + 1) for j in range(m + 1)]
        cells += [f"sum(k{i} * (w * y - q)) AS v{i}_{m + 1}" for i in range(m + 1)]
        parts.append(f"e{s}_0 AS (SELECT {', '.join(cells)} FROM w{s}, gram)")
        for k in range(m + 1):
            cells = [
                f"v{i}_{j} / v{k}_{k} AS v{i}_{j}" if i == k else f"v{i}_{j} - v{i}_{k} * v{k}_{j} / v{k}_{k} AS v{i}_{j}"
                for i in range(m + 1) for j in range(m + 2)
            ]
            parts.append(f"e{s}_{k + 1} AS (SELECT {', '.join(cells)} FROM e{s}_{k})")
        parts.append(f"v{s + 1} AS (SELECT {', '.join(f'v{i}_{m + 1} AS a{i}' for i in range(m + 1))} FROM e{s}_{m + 1})")
    rows = " UNION ALL ".join(
        f"SELECT {s} AS step, {rs('now.objective / start.objective')} AS share FROM o{s} now, o0 AS start" for s in range(params.max_iter + 1)
    )
    return ",\n".join(parts) + "\n" + rows


@query(_objective_sql(_FEW))
def kernel_objective(spark, sf):
    """The objective of a kernel fit before each of its steps, as a share of the first."""
    train = _splits(spark, sf).where("split = 'train'")
    fit = KernelFit(_kernel_inputs(train, _FEW), _FEW)
    fit_kernels(train, [fit], SPEC.label)
    shares = [(step, value / fit.objectives[0]) for step, value in enumerate(fit.objectives)]
    return spark.createDataFrame(shares, "step int, share double").select("step", r("share").alias("share"))


@query(
    f"""WITH {_OLS}
SELECT split, count(*) AS n, {rs("avg(pred)")} AS mean_baseline, {rs("sqrt(avg(pow(y - pred, 2)))")} AS rmse,
  {rs("avg(abs(y - pred))")} AS mae
FROM scored GROUP BY 1"""
)
def co_target_baseline(spark, sf):
    """The carbon monoxide target, whose baseline is a linear model of its own features."""
    co = target_spec("CO")
    rename = {SPEC.features[0]: co.features[0], SPEC.label: co.label}
    _, rows = prepare_residual(daily(spark, sf).withColumnsRenamed(rename), co)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("y_baseline")).alias("mean_baseline"),
        r(F.sqrt(F.avg(F.pow("residual", F.lit(2.0))))).alias("rmse"), r(F.avg(F.abs("residual"))).alias("mae"),
    )


def _tuned(spark, sf):
    table = fused_rolling(spark, sf)
    candidates = (
        Candidate("forest", (_SMALL_FOREST,), False),
        Candidate("forest_on_baseline", (_SMALL_FOREST,), True),
        *ridge_candidates(),
    )
    return table, tuned_residual(table, SPEC, candidates=candidates, order=_ORDER)


@query()
def tuned_residual_metrics(spark, sf):
    _, study = _tuned(spark, sf)
    return _metric_rows(study.metrics)


_EXTENDED = ("o3", "t", "h", "ro3", "rt", "rh", "yb")


def _grid_sql() -> str:
    """Every penalty of both ridge variants over four folds, as rows (fold, variant, alpha) of one elimination.

    A variant without the baseline has it replaced by zero, which gives it no weight.
    """
    p, raw = len(_EXTENDED), _EXTENDED[:6]
    medians = ", ".join(f"median({c}) AS m_{c}" for c in raw)
    x = [f"coalesce(b.{c}, m_{c})" for c in raw] + ["CASE WHEN variant = 1 THEN b.yb ELSE 0e0 END"]
    stats = [f"stddev_pop(x{i}) AS s{i}, avg(x{i}) AS a{i}, covar_pop(x{i}, e) AS b{i}" for i in range(p)]
    stats += [f"covar_pop(x{i}, x{j}) AS c{i}_{j}" for i in range(p) for j in range(i, p)]
    scale = [f"CASE WHEN s{i} > 0 THEN s{i} ELSE 1e0 END" for i in range(p)]
    entries = []
    for i in range(p):
        for j in range(p):
            cell = f"c{min(i, j)}_{max(i, j)} / ({scale[i]} * {scale[j]})"
            entries.append(f"{cell}{' + alpha / n' if i == j else ''} AS v{i}_{j}")
        entries.append(f"b{i} / ({scale[i]}) AS v{i}_{p}")
    kept = ", ".join(f"a{i}, {scale[i]} AS s{i}" for i in range(p))
    parts = [f"""{BASELINE_SQL},
rolled AS (
  SELECT sensor_id, ts, {", ".join(f"avg({c}) OVER w AS r{c}" for c in ("o3", "t", "h"))} FROM fused
  WINDOW w AS (PARTITION BY sensor_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
),
ranked AS (
  SELECT o3, t, h, ro3, rt, rh, yb, y - yb AS e, row_number() OVER (ORDER BY ts, sensor_id) - 1 AS rn, count(*) OVER () AS n
  FROM based JOIN rolled USING (sensor_id, ts) WHERE split = 'train'
),
blocks AS (SELECT *, CASE WHEN rn < n - 4 * (n // 5) THEN 0 ELSE 1 + (rn - (n - 4 * (n // 5))) // (n // 5) END AS block FROM ranked),
folds AS (SELECT unnest([0, 1, 2, 3]) AS fold), variants AS (SELECT unnest([0, 1]) AS variant),
alphas AS (SELECT unnest([{", ".join(f"{a}e0" for a in _ALPHAS)}]) AS alpha),
foldmed AS (SELECT fold, {medians} FROM folds JOIN blocks ON block <= fold GROUP BY fold),
imputed AS (
  SELECT fold, variant, block, e, {", ".join(f"{v} AS x{i}" for i, v in enumerate(x))}
  FROM blocks b JOIN foldmed ON block <= fold + 1, variants
),
moments AS (SELECT fold, variant, count(*) AS n, avg(e) AS ae, {", ".join(stats)} FROM imputed WHERE block <= fold GROUP BY 1, 2),
step0 AS (SELECT fold, variant, alpha, n, ae, {kept}, {", ".join(entries)} FROM moments, alphas)"""]
    for k in range(p):
        cells = []
        for i in range(p):
            for j in range(p + 1):
                cells.append(
                    f"v{i}_{j} / v{k}_{k} AS v{i}_{j}" if i == k else f"v{i}_{j} - v{i}_{k} * v{k}_{j} / v{k}_{k} AS v{i}_{j}"
                )
        own = ", ".join(f"a{i}, s{i}" for i in range(p))
        parts.append(f"step{k + 1} AS (SELECT fold, variant, alpha, n, ae, {own}, {', '.join(cells)} FROM step{k})")
    guess = " + ".join(f"v{i}_{p} / s{i} * (x{i} - a{i})" for i in range(p))
    parts.append(f"""maes AS (
  SELECT f.fold, f.variant, alpha, avg(abs(e - (ae + {guess}))) AS mae
  FROM step{p} f JOIN imputed t ON t.fold = f.fold AND t.variant = f.variant WHERE block = f.fold + 1 GROUP BY 1, 2, 3
),
grid AS (SELECT CASE WHEN variant = 1 THEN 'ridge_on_baseline' ELSE 'ridge' END AS candidate,
  'alpha=' || alpha AS params, variant, alpha, avg(mae) AS cv_mae FROM maes GROUP BY variant, alpha)""")
    return "WITH " + ",\n".join(parts)


def _ridge_grid(spark, sf) -> DataFrame:
    _, rows = prepare_residual(fused_rolling(spark, sf), SPEC)
    train = rows.where("split = 'train'")
    blocks = with_fold_block(train, _ORDER, fold_starts(train, _ORDER))
    found = search(blocks, SPEC.extended_features, "y_baseline", "residual", ridge_candidates())
    return search_table(spark, found)


@query(f"{_grid_sql()} SELECT candidate, params, {rs('cv_mae')} AS cv_mae FROM grid")
def ridge_grid(spark, sf):
    """All penalties of ridge on raw and rolling features, without and with the baseline."""
    return _ridge_grid(spark, sf).select("candidate", "params", r("cv_mae").alias("cv_mae"))


@query(
    f"""{_grid_sql()} SELECT candidate, params, {rs("cv_mae")} AS cv_mae FROM grid
ORDER BY grid.cv_mae, variant, params LIMIT 1"""
)
def best_candidate(spark, sf):
    """The best of both ridge variants; the forests' settings are compared in tuned_residual_metrics."""
    return best_row(_ridge_grid(spark, sf)).select("candidate", "params", r("cv_mae").alias("cv_mae"))


@query()
def full_period_residual(spark, sf):
    """Baseline, residual and final value over the whole period, and the July comparison."""
    table = fused_rolling(spark, sf)
    study = forest_residual(table, SPEC, params=_SMALL_FOREST)
    exported = score_full_period(table, study)
    return compare_on_month(exported, SPEC, ["forest"])["metrics"].select(
        "model", *[r(c, 4).alias(c) for c in ("r2", "rmse", "mae")], "n"
    )


@query(
    f"""WITH {BASELINE_SQL}
SELECT f.sensor_id, {ls("f.ts")} AS ts,
  {rs("CASE WHEN coalesce(f.o3, f.t, f.h) IS NOT NULL THEN alpha + beta * (coalesce(f.o3, mo3) / 1.451e0 + 0.1034e0 * pow(coalesce(f.t, mt), 2) - 2.225e0 * coalesce(f.t, mt) + 0.01223e0 * pow(coalesce(f.h, mh), 2) - 1.984e0 * coalesce(f.h, mh) + 79) END", 4)} AS O3_baseline_cal
FROM fused f, med, line"""
)
def full_period_baseline(spark, sf):
    """The compensated baseline over all rows with any feature, train medians."""
    _, params = fitted_baseline(spark, sf)
    return _calibrated(apply_compensated_baseline(fused(spark, sf), SPEC, params, "O3_baseline_cal"))


@query(
    f"""WITH {BASELINE_SQL}
SELECT sensor_id, month(ts) AS month, count(*) AS n_rows, count(v) AS n_scored, {rs("avg(v)", 4)} AS mean_cal,
  {rs("min(v)", 4)} AS low_cal, {rs("max(v)", 4)} AS high_cal
FROM (SELECT f.sensor_id, f.ts, CASE WHEN coalesce(f.o3, f.t, f.h) IS NOT NULL THEN alpha + beta * (coalesce(f.o3, mo3) / 1.451e0 + 0.1034e0 * pow(coalesce(f.t, mt), 2) - 2.225e0 * coalesce(f.t, mt) + 0.01223e0 * pow(coalesce(f.h, mh), 2) - 1.984e0 * coalesce(f.h, mh) + 79) END AS v
      FROM fused f, med, line) GROUP BY 1, 2"""
)
def calibrated_table_roundtrip(spark, sf):
    """The calibrated table written bucketed by sensor and time, read back and summed up."""
    _, params = fitted_baseline(spark, sf)
    out = apply_compensated_baseline(fused(spark, sf), SPEC, params, "O3_baseline_cal")
    return _by_month(write_bucketed(out, fresh_name("calibrated"), ["sensor_id", "ts"], 8))

"""Baseline plus residual model: tuned search, fixed comparison and full scoring."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.config import (
    COMPARISON_FOREST,
    Candidate,
    ForestParams,
    SplitSpec,
    TargetSpec,
    default_candidates,
    default_kernel_grid,
)
from aerocal.functions import any_present, in_months
from aerocal.operators.calibrate import (
    apply_compensated_baseline,
    collect_params,
    fit_compensated_baseline,
    recombine,
    residual,
)
from aerocal.operators.evaluate import model_metrics, trend_lines, trend_points
from aerocal.operators.folds import fold_starts, with_fold_block
from aerocal.operators.kernel import PackedRows
from aerocal.operators.models import (
    Preparation,
    best_of,
    fit_model,
    labelled_splits,
    predict,
    search,
    search_table,
)
from aerocal.operators.orderstat import exact_medians
from aerocal.operators.quality import require_columns, require_splits
from aerocal.operators.timeaxis import fill_and_roll, rolling_mean
from aerocal.session import materialise

BASELINE, RESIDUAL = "y_baseline", "residual"


@dataclass(frozen=True)
class Baseline:
    """A fitted baseline of either kind."""

    spec: TargetSpec
    params: Mapping[str, float] | None = None
    model: PipelineModel | None = None

    @classmethod
    def fit(cls, train: DataFrame, spec: TargetSpec) -> Baseline:
        if spec.baseline == "compensated":
            return cls(spec, params=collect_params(fit_compensated_baseline(train, spec)))
        return cls(spec, model=fit_model(train, spec.features, spec.label))

    def apply(
        self,
        df: DataFrame,
        out: str = BASELINE,
        everywhere: bool = False,
        impute_from: DataFrame | None = None,
    ) -> DataFrame:
        """Score rows with any raw feature, or all rows when ``everywhere``.

        ``impute_from`` takes the medians from that table instead of the train rows.
        """
        if self.params is None:
            where = None if everywhere else any_present(self.spec.features)
            return predict(self.model, df, out, where=where)
        params = dict(self.params)
        if impute_from is not None:
            params |= collect_params(exact_medians(impute_from, self.spec.features))
        return apply_compensated_baseline(df, self.spec, params, out, everywhere=everywhere)


@dataclass(frozen=True)
class ResidualModel:
    name: str
    features: tuple[str, ...]
    model: PipelineModel


@dataclass(frozen=True)
class ResidualStudy:
    baseline: Baseline
    models: tuple[ResidualModel, ...]
    metrics: DataFrame  # split, model, r2, rmse, mae, n
    scored: DataFrame  # labelled rows with y_baseline, <model>_residual_hat, <model>_final
    search: DataFrame | None = field(default=None)  # candidate_no, candidate, params, cv_mae


def with_rolling(fused: DataFrame, spec: TargetSpec, keys: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """Trailing three-row means of the raw features, per series, on the whole grid."""
    return rolling_mean(fused, spec.features, keys)


def fill_with_rolling(
    grid: DataFrame, spec: TargetSpec, keys: Sequence[str] = ("sensor_id",), every: str = "1 hour", parts: int | None = None
) -> DataFrame:
    """:func:`with_rolling` of a grid whose gaps are filled on the way."""
    return fill_and_roll(grid, spec.features, keys, every=every, parts=parts)


def prepare_residual(
    table: DataFrame, spec: TargetSpec, split: SplitSpec = SplitSpec()
) -> tuple[Baseline, DataFrame]:
    """Fitted baseline, and the labelled rows with baseline and residual.

    The labelled rows are written to the shared folder first: every fit and fold reads
    those files, and nothing upstream of them runs twice.
    """
    require_columns(table, [spec.label, *spec.features])
    rows = materialise(labelled_splits(table, spec, split), "labelled")
    require_splits(rows)
    baseline = Baseline.fit(rows.where("split = 'train'"), spec)
    scored = baseline.apply(rows, everywhere=True)
    return baseline, residual(scored, spec.label, BASELINE, RESIDUAL)


def _study(
    baseline: Baseline,
    rows: DataFrame,
    models: Sequence[ResidualModel],
    results: DataFrame | None = None,
) -> ResidualStudy:
    scored = rows
    for m in models:
        hat = f"{m.name}_residual_hat"
        scored = predict(m.model, scored, hat).withColumn(f"{m.name}_final", recombine(BASELINE, hat))
    predictions = {"baseline": BASELINE} | {m.name: f"{m.name}_final" for m in models}
    metrics = model_metrics(scored, baseline.spec.label, predictions, by=["split"])
    return ResidualStudy(baseline, tuple(models), metrics, scored, results)


def forest_residual(
    table: DataFrame,
    spec: TargetSpec,
    split: SplitSpec = SplitSpec(),
    params: ForestParams = ForestParams(),
) -> ResidualStudy:
    """A forest on the raw features and the baseline."""
    baseline, rows = prepare_residual(table, spec, split)
    features = (*spec.features, BASELINE)
    model = fit_model(rows.where("split = 'train'"), features, RESIDUAL, params)
    return _study(baseline, rows, [ResidualModel("forest", features, model)])


def _folds(rows: DataFrame, order: Sequence[str], n_splits: int) -> DataFrame:
    train = rows.where("split = 'train'")
    return with_fold_block(train, order, fold_starts(train, order, n_splits))


def tuned_residual(
    table: DataFrame,
    spec: TargetSpec,
    split: SplitSpec = SplitSpec(),
    candidates: Iterable[Candidate] | None = None,
    order: Sequence[str] = ("ts",),
    n_splits: int = 4,
    parallelism: int = 4,
) -> ResidualStudy:
    """Search forest and ridge settings by temporal folds and refit the best on all
    train rows. ``table`` carries the rolling features."""
    baseline, rows = prepare_residual(table, spec, split)
    train = _folds(rows, order, n_splits)
    found = search(
        train,
        spec.extended_features,
        BASELINE,
        RESIDUAL,
        candidates or default_candidates(),
        n_splits=n_splits,
        parallelism=parallelism,
    )
    best = best_of(found)
    model = fit_model(train, best["features"], RESIDUAL, best["params"])
    chosen = ResidualModel(best["candidate"].name, tuple(best["features"]), model)
    return _study(baseline, rows, [chosen], search_table(table.sparkSession, found))


def compare_residuals(
    table: DataFrame,
    spec: TargetSpec,
    split: SplitSpec = SplitSpec(),
    forest: ForestParams = COMPARISON_FOREST,
    kernel_grid: Sequence | None = None,
    order: Sequence[str] = ("ts",),
    n_splits: int = 4,
    parallelism: int = 4,
) -> ResidualStudy:
    """A fixed forest beside a kernel model whose penalty is chosen by temporal folds."""
    baseline, rows = prepare_residual(table, spec, split)
    features = (*spec.extended_features, BASELINE)
    train = _folds(rows, order, n_splits).select(*dict.fromkeys([*order, *features, RESIDUAL, "block"]))
    train = materialise(train, "folds")  # read once for every step of the fits
    packed = PackedRows.of(train, features, RESIDUAL, "block")
    kernel = Candidate("kernel", tuple(kernel_grid or default_kernel_grid()), with_baseline=True)
    found = search(
        train,
        spec.extended_features,
        BASELINE,
        RESIDUAL,
        [kernel],
        n_splits=n_splits,
        parallelism=parallelism,
        keys=order,
        packed=packed,
    )
    best = best_of(found)
    prep = Preparation.fit(train, features, RESIDUAL, scaled=True)
    models = [
        ResidualModel("forest", features, fit_model(train, features, RESIDUAL, forest, prep=prep)),
        ResidualModel("kernel", features, fit_model(train, features, RESIDUAL, best["params"], order, prep, packed)),
    ]
    return _study(baseline, rows, models, search_table(table.sparkSession, found))


def score_full_period(table: DataFrame, study: ResidualStudy, impute_scope: str = "train") -> DataFrame:
    """Baseline, residual and final value over the whole period, labelled or not.

    The baseline needs a raw feature, the residual a raw or rolling one. Where only
    a rolling one exists the model sees an imputed baseline: such rows are flagged
    and have no final value. ``impute_scope='full'`` takes the baseline's medians
    from all scored rows.
    """
    spec = study.baseline.spec
    usable = any_present(spec.features)
    source = table.where(usable) if impute_scope == "full" else None
    out = study.baseline.apply(table, BASELINE, impute_from=source)
    for m in study.models:
        needed = [c for c in m.features if c != BASELINE]
        hat = f"{spec.name}_{m.name}_residual_hat"
        out = predict(m.model, out, hat, where=any_present(needed))
        out = out.withColumn(f"{spec.name}_{m.name}_final", recombine(BASELINE, hat))
    return out.withColumn(
        f"{spec.name}_baseline_imputed", F.col(BASELINE).isNull() & any_present(spec.extended_features)
        if set(spec.rolling_features) <= set(table.columns)
        else F.lit(False),
    ).withColumnRenamed(BASELINE, f"{spec.name}_baseline_cal")


def compare_on_month(
    exported: DataFrame, spec: TargetSpec, models: Sequence[str], month: int = 7, points: int = 200
) -> dict[str, DataFrame]:
    """Models against the reference in one month of the exported table.

    Returns ``metrics`` (model, r2, rmse, mae, n), ``lines`` and ``points``.
    """
    rows = exported.where(in_months(F.col("ts"), [month]) & F.col(spec.label).isNotNull())
    columns = {"baseline": f"{spec.name}_baseline_cal"} | {m: f"{spec.name}_{m}_final" for m in models}
    lines = trend_lines(rows, spec.label, columns)
    return {
        "metrics": model_metrics(rows, spec.label, columns),
        "lines": lines,
        "points": trend_points(lines, points),
    }

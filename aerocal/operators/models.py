"""Regression models with median imputation, temporal search and scoring."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from aerocal.config import (
    Candidate,
    ForestParams,
    KernelParams,
    RidgeParams,
    SplitSpec,
    TargetSpec,
)
from aerocal.functions import masked, split_label
from aerocal.operators.gram import LinearSetting, fold_errors, fold_medians
from aerocal.operators.kernel import KernelFit, KernelRegression, PackedRows, fit_kernels, fold_error, landmark_inputs
from aerocal.operators.orderstat import exact_medians

FEATURES = "_features"
PREDICTION = "_prediction"
ModelParams = ForestParams | RidgeParams | KernelParams | None


# ---------------------------------------------------------------- preparation


def _number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _prep_stage(
    features: Sequence[str],
    medians: Mapping[str, float],
    shift: Mapping[str, float] | None = None,
    scale: Mapping[str, float] | None = None,
) -> SQLTransformer:
    """Impute, then optionally (x - shift) / scale, into ``_x_<i>`` columns."""
    terms = []
    for i, c in enumerate(features):
        term = f"COALESCE(CAST(`{c}` AS DOUBLE), {_number(medians[c])})"
        if shift:
            term = f"({term} - {_number(shift[c])})"
        if scale:
            term = f"({term} / {_number(scale[c])})"
        terms.append(f"{term} AS `_x_{i}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


@dataclass(frozen=True)
class Preparation:
    """What a fit needs to know of its train rows, taken from those rows only."""

    n: int
    label_std: float
    medians: Mapping[str, float]
    means: Mapping[str, float]
    scales: Mapping[str, float]

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        features: Sequence[str],
        label: str,
        scaled: bool = False,
        found: Row | None = None,
    ) -> Preparation:
        """The medians, then one small job for the rest; means and deviations only when ``scaled``.

        Features without any value are left out of ``medians``. ``found`` holds the medians where they
        were looked up before, for all folds at once.
        """
        found = found or exact_medians(train, features).first()
        medians = {c: float(found[c]) for c in features if found[c] is not None}
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()} if scaled else {}
        row = train.agg(
            F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("s"),
            *[F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")) for x in filled.values()],
        ).first()
        if not row["n"]:
            raise ValueError("no training rows")
        means, scales = {}, {}
        for c, (mean, std) in zip(filled, row[2:], strict=True):
            means[c], scales[c] = mean, std or 1.0
        return cls(row["n"], row["s"] or 0.0, medians, means, scales)

    def stages(self, features: Sequence[str], params: ModelParams = None) -> list:
        """Transformers from raw columns to the feature vector.

        Plain models and forests impute medians; ridge also divides by the deviation
        without centring.
        """
        features = [c for c in features if c in self.medians]
        if not features:
            raise ValueError("no feature has a value in the training rows")
        inputs = [f"_x_{i}" for i in range(len(features))]
        scale = self.scales if isinstance(params, RidgeParams) else None
        prep = _prep_stage(features, self.medians, scale=scale)
        return [prep, VectorAssembler(inputCols=inputs, outputCol=FEATURES)]


def _needs_scale(params: ModelParams) -> bool:
    return isinstance(params, RidgeParams | KernelParams)


# ---------------------------------------------------------------- estimators


def estimator(params: ModelParams, label: str, n: int, label_std: float):
    """MLlib estimator for a settings object; ``None`` is ordinary least squares.

    ``n`` and the label's population deviation turn the ridge penalty of the sum-form
    objective into MLlib's mean-form ``regParam``.
    """
    common = {"featuresCol": FEATURES, "labelCol": label, "predictionCol": PREDICTION}
    if params is None:
        return LinearRegression(solver="normal", regParam=0.0, **common)
    if isinstance(params, RidgeParams):
        return LinearRegression(
            solver="normal",
            elasticNetParam=0.0,
            standardization=False,
            regParam=params.alpha * label_std / n,
            **common,
        )
    subset = params.max_features
    return RandomForestRegressor(
        numTrees=params.trees,
        maxDepth=params.max_depth,
        minInstancesPerNode=params.min_leaf,
        featureSubsetStrategy=subset if isinstance(subset, str) else repr(float(subset)),
        maxBins=params.max_bins,
        maxMemoryInMB=512,
        seed=params.seed,
        **common,
    )


def fit_model(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    params: ModelParams = None,
    keys: Sequence[str] = (),
    prep: Preparation | None = None,
    packed: PackedRows | None = None,
) -> PipelineModel:
    """Fit imputation, scaling and estimator on ``train``; rows without label are left out.

    ``keys`` identify a row; the landmarks of a kernel model are drawn by them. ``prep`` is given when
    it is known of the same rows and features already, ``packed`` when those rows are packed.
    """
    train = train.where(F.col(label).isNotNull())
    prep = prep or Preparation.fit(train, features, label, _needs_scale(params))
    if isinstance(params, KernelParams):
        fit = KernelFit(landmark_inputs(train, features, prep, params, keys), params)
        fit_kernels(packed or train, [fit], label)
        names = fit.inputs.features
        ready = _prep_stage(names, prep.medians, prep.means, prep.scales)
        last = KernelRegression.of(fit, [f"_x_{i}" for i in range(len(names))], PREDICTION)
        return PipelineModel(stages=[ready, last])
    slim = train.select(*features, F.col(label).cast("double").alias(label))
    last = estimator(params, label, prep.n, prep.label_std)
    return Pipeline(stages=[*prep.stages(features, params), last]).fit(slim)


def predict(model: PipelineModel, df: DataFrame, out: str, where: Column | None = None) -> DataFrame:
    """Add the prediction, only where ``where`` holds when it is given."""
    scored = model.transform(df)
    value = F.col(PREDICTION)
    if where is not None:
        value = masked(where, value)
    return scored.select(*df.columns, value.alias(out))


def linear_coefficients(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    """Intercept and coefficients of a fitted linear pipeline, by feature."""
    last = model.stages[-1]
    return {"intercept": float(last.intercept)} | {
        c: float(b) for c, b in zip(features, last.coefficients, strict=True)
    }


# ---------------------------------------------------------------- search


def search(
    df: DataFrame,
    features: Sequence[str],
    baseline: str,
    label: str,
    candidates: Iterable[Candidate],
    block: str = "block",
    n_splits: int = 4,
    parallelism: int = 4,
    keys: Sequence[str] = (),
    packed: PackedRows | None = None,
) -> list[dict]:
    """Mean absolute error of every setting of every candidate over expanding folds.

    ``df`` carries the fold block of each row. Ridge settings are all solved from sums over
    the blocks (:func:`aerocal.operators.gram.fold_errors`). Kernel settings of all folds are fitted side
    by side, their landmarks drawn by ``keys``, over ``packed`` if the rows are packed already. For the others, medians and scales are
    fitted inside each fold, once for all candidates; candidates with the same inputs share one
    cached feature frame. Independent fits are submitted from a few threads, as
    MLlib's own validators do, so that the cluster is not idle between jobs.
    """
    table = [
        {
            "candidate_no": number,
            "candidate": c,
            "features": [*features, baseline] if c.with_baseline else list(features),
            "params": params,
            "fold_mae": [],
        }
        for number, c in enumerate(candidates)
        for params in c.grid
    ]
    linear = [row for row in table if isinstance(row["params"], RidgeParams)]
    if linear:
        settings = [LinearSetting(tuple(row["features"]), row["params"].alpha) for row in linear]
        found = fold_errors(df, label, settings, block, n_splits).orderBy("fold").collect()
        for row in found:
            linear[row["setting"]]["fold_mae"].append(row["mae"])
    kernel = [row for row in table if isinstance(row["params"], KernelParams)]
    if kernel:
        _score_kernels(df, kernel, label, block, n_splits, keys, packed)
    fitted = [row for row in table if row not in linear and row not in kernel]
    used = list(dict.fromkeys(c for row in fitted for c in row["features"]))
    middle = _fold_medians(df, used, block, n_splits) if fitted else {}
    for k in range(n_splits if fitted else 0):
        train, test = df.where(F.col(block) <= k), df.where(F.col(block) == k + 1)
        prep = Preparation.fit(train, used, label, found=middle.get(k))
        ready: dict[tuple, list[DataFrame]] = {}
        for row in fitted:
            key = _inputs_key(row)
            if key not in ready:
                model = PipelineModel(prep.stages(row["features"], row["params"]))
                ready[key] = [
                    model.transform(part).select(FEATURES, label).persist() for part in (train, test)
                ]

        def score(row: dict, prep=prep, ready=ready) -> float:
            fold_train, fold_test = ready[_inputs_key(row)]
            model = estimator(row["params"], label, prep.n, prep.label_std).fit(fold_train)
            error = F.avg(F.abs(F.col(PREDICTION) - F.col(label))).alias("mae")
            return model.transform(fold_test).agg(error).first()["mae"]

        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            for row, mae in zip(fitted, pool.map(score, fitted), strict=True):
                row["fold_mae"].append(mae)
        for parts in ready.values():
            for part in parts:
                part.unpersist()
    for row in table:
        row["cv_mae"] = sum(row["fold_mae"]) / n_splits
    return table


def _fold_medians(df: DataFrame, features: Sequence[str], block: str, n_splits: int) -> dict[int, Row]:
    """The medians of the train rows of every fold, by fold."""
    return {row["fold"]: row for row in fold_medians(df, features, block, n_splits).collect()}


def _score_kernels(
    df: DataFrame, table: Sequence[dict], label: str, block: str, n_splits: int, keys: Sequence[str], packed: PackedRows | None
) -> None:
    """Fit every kernel setting of every fold in shared passes, and add the errors to ``table``."""
    fits: list[tuple[dict, KernelFit]] = []
    used = list(dict.fromkeys(c for row in table for c in row["features"]))
    middle = _fold_medians(df, used, block, n_splits)
    for k in range(n_splits):
        train = df.where(F.col(block) <= k)
        prep, ready = Preparation.fit(train, used, label, scaled=True, found=middle.get(k)), {}
        for row in table:
            p = row["params"]
            key = (tuple(row["features"]), p.landmarks, p.gamma)
            if key not in ready:
                ready[key] = landmark_inputs(train, row["features"], prep, p, keys, last=k)
            fits.append((row, KernelFit(ready[key], p)))
    only = [f for _, f in fits]
    rows = packed or PackedRows.of(df, used, label, block)
    fit_kernels(rows, only, label)
    for (row, _), mae in zip(fits, fold_error(rows, only, label, block), strict=True):
        row["fold_mae"].append(mae)


def _inputs_key(row: dict) -> tuple:
    return tuple(row["features"])


def best_of(table: Sequence[dict]) -> dict:
    """Smallest mean error; the earlier entry wins a tie."""
    return min(table, key=lambda row: row["cv_mae"])


def search_table(spark, table: Sequence[dict]) -> DataFrame:
    """The search results as rows: one per candidate and setting."""
    rows = [
        (r["candidate_no"], r["candidate"].name, _describe(r["params"]), float(r["cv_mae"]))
        for r in table
    ]
    return spark.createDataFrame(
        rows, "candidate_no int, candidate string, params string, cv_mae double"
    )


def best_row(results: DataFrame) -> DataFrame:
    return results.orderBy("cv_mae", "candidate_no", "params").limit(1)


def _describe(params: ModelParams) -> str:
    return ", ".join(f"{k}={v}" for k, v in asdict(params).items()) if params else "ols"


# ---------------------------------------------------------------- split frames


def labelled_splits(df: DataFrame, spec: TargetSpec, split: SplitSpec, ts: str = "ts") -> DataFrame:
    """Rows with a label that fall in the train or test months, marked in ``split``."""
    return (
        df.where(F.col(spec.label).isNotNull())
        .withColumn("split", split_label(F.col(ts), split))
        .where(F.col("split").isNotNull())
    )

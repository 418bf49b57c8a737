"""Sensor report and station table to one hourly table, and the first models on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.config import ForestParams, SplitSpec, TargetSpec
from aerocal.functions import all_present, ppb_to_ppm
from aerocal.operators.align import fuse
from aerocal.operators.evaluate import model_metrics
from aerocal.operators.models import fit_model, labelled_splits, predict
from aerocal.operators.quality import optional_column, require_columns, require_splits
from aerocal.operators.timeaxis import dedupe_first, interpolate_raw, resample
from aerocal.session import materialise
from aerocal.sources.tables import mask_temperature


def hourly_sensor(report: DataFrame, every: str = "1 hour") -> DataFrame:
    """Clean a raw report and average it per hour.

    First row per time (ties by value), temperature outliers masked and interpolated
    by position over the raw rows in both directions, then hourly means on a gap-free
    grid, then carbon monoxide in ppm.
    """
    values = [c for c in report.columns if c not in ("sensor_id", "ts")]
    rows = report.where(F.col("ts").isNotNull())
    rows = dedupe_first(rows, ["sensor_id", "ts"], values)
    if "Temp_lcs" in values:
        rows = interpolate_raw(mask_temperature(rows), ["Temp_lcs"], ["sensor_id"], both=True)
    grid = resample(rows, ["sensor_id"], every=every)
    return grid.withColumn("CO_lcs_ppm", ppb_to_ppm(optional_column(grid, "Carbon_Monoxide")))


def fuse_sensor(
    report: DataFrame, reference: DataFrame, station_of_sensor: DataFrame | None = None
) -> DataFrame:
    """Hourly sensor rows with the reference values of their station and hour.

    Without ``station_of_sensor`` (sensor_id, station_id) the reference must hold one
    station, and rows are matched by time alone; several stations raise, as each would repeat every
    sensor row.
    """
    if station_of_sensor is None:
        stations = reference.select("station_id").distinct().limit(2).collect()
        if len(stations) > 1:
            raise ValueError("the reference holds several stations; give station_of_sensor")
    grid = hourly_sensor(report)
    unique = dedupe_first(
        reference, ["station_id", "ts"], [c for c in reference.columns if c not in ("station_id", "ts")]
    )
    if station_of_sensor is None:
        return fuse(grid, unique.drop("station_id"), ["ts"])
    return fuse(grid.join(station_of_sensor, "sensor_id", "left"), unique, ["station_id", "ts"])


@dataclass(frozen=True)
class FirstModels:
    linear: PipelineModel
    forest: PipelineModel
    metrics: DataFrame  # split, model, r2, rmse, mae, n
    best: str

    @property
    def best_model(self) -> PipelineModel:
        return self.forest if self.best == "forest" else self.linear


def train_first_models(
    fused: DataFrame,
    spec: TargetSpec,
    split: SplitSpec = SplitSpec(),
    forest: ForestParams = ForestParams(),
    pin: str | None = None,
) -> FirstModels:
    """Linear and forest models on the train months, measured on both splits.

    The best is the one with the smaller test error; ``pin`` names it instead.
    """
    require_columns(fused, [spec.label, *spec.features])
    rows = materialise(labelled_splits(fused, spec, split), "splits")
    require_splits(rows)
    train = rows.where("split = 'train'")
    models = {
        "linear": fit_model(train, spec.features, spec.label),
        "forest": fit_model(train, spec.features, spec.label, forest),
    }
    scored = rows
    for name, model in models.items():
        scored = predict(model, scored, f"pred_{name}")
    metrics = model_metrics(scored, spec.label, {m: f"pred_{m}" for m in models}, by=["split"])
    best = pin or metrics.where("split = 'test'").orderBy("mae", "model").first()["model"]
    return FirstModels(models["linear"], models["forest"], metrics, best)


def score_full_period(
    fused: DataFrame, spec: TargetSpec, baseline: PipelineModel, model: PipelineModel
) -> DataFrame:
    """Baseline and model over all rows whose features are all present."""
    usable = all_present(spec.features)
    out = predict(baseline, fused, f"{spec.name}_baseline_cal", where=usable)
    return predict(model, out, f"{spec.name}_ml_cal", where=usable)

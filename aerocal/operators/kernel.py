"""Kernel regression on landmark features with an epsilon-insensitive loss.

The model is f(x) = b + sum a_j k(x, z_j) with k(x, z) = exp(-gamma |x - z|^2) and landmarks z_j out
of the train rows. It minimises 1/2 a'Ka + c * sum max(0, |y - f(x)| - epsilon). Each step
replaces the loss by a weighted square that lies above it and touches it at the present residual, so
no step makes the objective worse. One pass over the rows serves a step of all folds, feature sets
and penalties: tasks add up weighted products, and Spark sums them by position. The rows are written
once as arrays of numbers, some thousand rows of a block in a value, so that no step takes them apart again.

The landmarks are a bounded sample: the ``landmarks`` train rows with the smallest md5 of their keys.
All rows enter the fit. Per fit, (landmarks + 2)^2 / 2 numbers reach the driver in a step.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerocal.config import KernelParams
from aerocal.session import materialise, small_batches

#: Residuals count as at least this far from the corners of the loss.
FLOOR = 1e-3
#: Rows whose features are held at once; so many stay in a core's cache.
CHUNK = 1024
#: Bytes of rows that are written as one value, values handed to Python at once, and bytes of a row group.
PACK_BYTES, PACKS_AT_ONCE, PACK_GROUP = 1 << 17, 32, 1 << 23


def kernel_values(x: np.ndarray, marks: np.ndarray, gamma: float) -> np.ndarray:
    """k(x, z) of every row with every landmark."""
    far = (x * x).sum(axis=1)[:, None] + (marks * marks).sum(axis=1)
    far -= 2.0 * x @ marks.T
    np.maximum(far, 0.0, out=far)
    far *= -gamma
    return np.exp(far, out=far)


@dataclass(frozen=True)
class KernelInputs:
    """How rows become features: fill, standardise, compare with the landmarks.

    ``last`` is the highest block of the train rows; None takes all rows.
    """

    features: tuple[str, ...]
    fill: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    marks: np.ndarray
    gamma: float
    root: np.ndarray
    last: int | None = None

    def standard(self, frame: pd.DataFrame | Mapping[str, np.ndarray]) -> np.ndarray:
        x = np.stack([np.asarray(frame[c], dtype=float) for c in self.features]).T
        return (np.where(np.isnan(x), self.fill, x) - self.shift) / self.scale

    def expand(self, frame: pd.DataFrame | Mapping[str, np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
        """Features whose inner products are the kernel's on the landmarks, and a one, for some rows at a time.

        A feature's values lie side by side, as the products of a step need them.
        """
        x, count = self.standard(frame).T, len(self.features)
        # -gamma |x - z|^2 = 2 gamma z.x - gamma |z|^2 - gamma |x|^2 as one product
        marks = np.column_stack([2.0 * self.marks, -(self.marks * self.marks).sum(axis=1), -np.ones(len(self.marks))]) * self.gamma
        root = np.ascontiguousarray(self.root.T)
        for start in range(0, x.shape[1], CHUNK):
            part = slice(start, min(start + CHUNK, x.shape[1]))
            lifted = np.ones((count + 2, part.stop - part.start))
            lifted[:count] = x[:, part]
            np.sum(lifted[:count] * lifted[:count], axis=0, out=lifted[-1])
            near = marks @ lifted
            np.minimum(near, 0.0, out=near)
            np.exp(near, out=near)
            z = np.ones((len(root) + 1, near.shape[1]))
            np.matmul(root, near, out=z[:-1])
            yield part, z.T


def landmark_inputs(
    train: DataFrame, features: Sequence[str], prep, params: KernelParams, keys: Sequence[str] = (), last: int | None = None
) -> KernelInputs:
    """Inputs of a fit on ``train``; without ``keys`` the features themselves are hashed."""
    features = tuple(c for c in features if c in prep.medians)
    if not features:
        raise ValueError("no feature has a value in the training rows")
    text = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in keys or features]))
    chosen = train.orderBy(text, *features).limit(params.landmarks).select(*features).toPandas()
    fill, shift, scale = (np.array([part[c] for c in features]) for part in (prep.medians, prep.means, prep.scales))
    # inputs have unit variance, so the data-scaled width is 1 / p
    gamma = params.gamma if params.gamma is not None else 1.0 / len(features)
    bare = KernelInputs(features, fill, shift, scale, np.zeros((0, len(features))), gamma, np.zeros((0, 0)), last)
    marks = bare.standard(chosen)
    values, vectors = np.linalg.eigh(kernel_values(marks, marks, gamma))
    kept = values > 1e-10 * values[-1]  # equal landmarks add nothing
    return KernelInputs(
        features, fill, shift, scale, marks, gamma, vectors[:, kept] / np.sqrt(values[kept]), last
    )


@dataclass
class KernelFit:
    """One fit: its inputs, its settings, and its state after the steps so far."""

    inputs: KernelInputs
    params: KernelParams
    weights: np.ndarray = None
    objectives: list[float] = field(default_factory=list)
    done: bool = False

    def __post_init__(self):
        self.weights = np.zeros(self.inputs.root.shape[1] + 1)

    def step(self, sums: np.ndarray) -> None:
        """Note the objective of the present weights; move on unless it has settled."""
        size, c = len(self.weights), self.params.c
        at = _upper(size)
        products = np.zeros((size, size))
        products.flat[at] = sums[: len(at)]
        products = products + np.triu(products, 1).T
        right, loss = sums[len(at) : -1], sums[-1]
        self.objectives.append(float(0.5 * self.weights[:-1] @ self.weights[:-1] + c * loss))
        seen = self.objectives
        settled = len(seen) > 1 and seen[-2] - seen[-1] < self.params.tolerance * abs(seen[-2])
        self.done = settled or len(seen) > self.params.max_iter
        if not self.done:
            penalty = np.append(np.ones(size - 1), 0.0) / c
            self.weights = np.linalg.solve(products + np.diag(penalty), right)


@cache
def _upper(size: int) -> np.ndarray:
    """Places of the upper triangle in a matrix, row by row."""
    return np.flatnonzero(np.triu(np.ones((size, size), dtype=bool)))


def _weighted(z: np.ndarray, y: np.ndarray, weights: np.ndarray, epsilon: float | np.ndarray) -> np.ndarray:
    """Sums of one step over some rows, for each row of ``weights``: products, right side, loss."""
    weights, upper = np.atleast_2d(weights), _upper(z.shape[1])
    residual = y - weights @ z.T
    away = np.abs(residual)
    out = away - epsilon
    corner = np.maximum(np.abs(out), FLOOR)
    w = (1.0 / np.maximum(away, FLOOR) + 1.0 / corner) / 2.0
    pull = epsilon * np.sign(residual) / (2.0 * corner)
    sums = np.empty((len(weights), len(upper) + z.shape[1] + 1))
    sums[:, len(upper) : -1] = (w * y - pull) @ z
    sums[:, -1] = np.maximum(out, 0.0).sum(axis=1)
    for one, root in zip(sums, np.sqrt(w), strict=True):
        half = z * root[:, None]
        (half.T @ half).take(upper, out=one[: len(upper)])  # a matrix with itself: half the multiplications
    return sums


@dataclass(frozen=True)
class PackedRows:
    """The rows of fits in the shared folder: ``block``, and ``data`` with the values of ``names`` one after the other."""

    frame: DataFrame
    names: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], label: str, block: str | None = None) -> PackedRows:
        """The rows with a label, of one block in each value; rows without a block belong to none."""
        used = dict.fromkeys(features)
        place = F.coalesce(F.col(block).cast("int"), F.lit(np.iinfo(np.int32).max)) if block else F.lit(0)
        rows = df.where(F.col(label).isNotNull()).select(
            *[F.col(c).cast("double").alias(c) for c in used], F.col(label).cast("double").alias("_y"), place.alias("_block")
        )
        width = len(used) + 1
        most = max(1, PACK_BYTES // (8 * width))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                values, places = np.stack(columns[:width]), columns[width]
                full = []
                for p in np.unique(places):
                    own = values[:, places == p]
                    own = np.concatenate([held.pop(p), own], axis=1) if p in held else own
                    end = own.shape[1] - own.shape[1] % most
                    full += [(p, own[:, at : at + most].tobytes()) for at in range(0, end, most)]
                    held[p] = own[:, end:]
                yield _pack_batch(full)
            yield _pack_batch([(p, own.tobytes()) for p, own in held.items() if own.size])

        packed = rows.mapInArrow(pack, "block int, data binary")
        return cls(materialise(packed, "packed", **{"parquet.block.size": PACK_GROUP}), (*used, "_y"))

    def up_to(self, lasts: Sequence[int | None]) -> PackedRows:
        """Without the blocks that none of the fits is trained on, so that they are not handed to Python."""
        return self if None in lasts else replace(self, frame=self.frame.where(F.col("block") <= max(lasts)))

    def map(self, add, schema: str) -> DataFrame:
        """Rows that ``add`` makes of one task's blocks and columns."""
        names = self.names

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
            for batch in batches:
                for place, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    values = np.frombuffer(data.as_buffer()).reshape(len(names), -1)
                    yield place, dict(zip(names, values, strict=True))

        return self.frame.mapInArrow(lambda batches: add(opened(batches)), schema)


def _pack_batch(packs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    places, data = [p for p, _ in packs], [d for _, d in packs]
    return pa.record_batch({"block": pa.array(places, pa.int32()), "data": pa.array(data, pa.binary())})


def _shared_inputs(fits: Sequence[KernelFit]) -> list[tuple[KernelInputs, list[int]]]:
    """Fits by their inputs, so that features are made once for all penalties."""
    groups: dict[int, tuple[KernelInputs, list[int]]] = {}
    for number, f in enumerate(fits):
        groups.setdefault(id(f.inputs), (f.inputs, []))[1].append(number)
    return list(groups.values())


def _as_packed(df: DataFrame | PackedRows, fits: Sequence[KernelFit], label: str, block: str | None) -> PackedRows:
    return df if isinstance(df, PackedRows) else PackedRows.of(df, [c for f in fits for c in f.inputs.features], label, block)


def fit_kernels(df: DataFrame | PackedRows, fits: Sequence[KernelFit], label: str, block: str | None = None) -> None:
    """Run the steps of all fits side by side until each has settled or used up its steps."""
    rows = _as_packed(df, fits, label, block)
    while open_ := [f for f in fits if not f.done]:
        groups = _shared_inputs(open_)
        states = [
            (np.array([open_[n].weights for n in numbers]), np.array([[open_[n].params.epsilon] for n in numbers]))
            for _, numbers in groups
        ]
        needed = rows.up_to([inputs.last for inputs, _ in groups])

        def add(blocks: Iterator, groups=groups, states=states) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for place, frame in blocks:
                for g, (inputs, _) in enumerate(groups):
                    if inputs.last is not None and place > inputs.last:
                        continue
                    for at, z in inputs.expand(frame):
                        total[g] = total.get(g, 0.0) + _weighted(z, frame["_y"][at], *states[g])
            found = [(n, one) for g, sums in total.items() for n, one in zip(groups[g][1], sums, strict=True)]
            sums = pa.array([one for _, one in found], pa.list_(pa.float64()))
            yield pa.record_batch({"fit": pa.array([n for n, _ in found], pa.int32()), "sums": sums})

        flat = needed.map(add, "fit int, sums array<double>").select("fit", F.posexplode("sums").alias("pos", "v"))
        added = flat.groupBy("fit", "pos").agg(F.sum("v").alias("v"))
        with small_batches(rows.frame.sparkSession, PACKS_AT_ONCE):
            sums = added.toPandas().sort_values(["fit", "pos"])
        if sums.empty:
            raise ValueError("no training rows")
        for n, one in sums.groupby("fit"):
            open_[n].step(one["v"].to_numpy())


def fold_error(df: DataFrame | PackedRows, fits: Sequence[KernelFit], label: str, block: str) -> list[float]:
    """Mean absolute error of each fit on the block after its train rows, in one pass."""
    rows = _as_packed(df, fits, label, block)
    groups, weights = _shared_inputs(fits), [f.weights for f in fits]

    def add(blocks: Iterator) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(weights)), np.zeros(len(weights), dtype=np.int64)
        for place, frame in blocks:
            for inputs, numbers in groups:
                if place != inputs.last + 1:
                    continue
                for at, z in inputs.expand(frame):
                    total[numbers] += [np.abs(frame["_y"][at] - z @ weights[n]).sum() for n in numbers]
                    count[numbers] += len(z)
        yield pa.record_batch({"fit": pa.array(np.arange(len(weights), dtype=np.int32)), "total": pa.array(total), "n": pa.array(count)})

    parts = rows.map(add, "fit int, total double, n long")
    with small_batches(rows.frame.sparkSession, PACKS_AT_ONCE):
        found = parts.groupBy("fit").agg((F.sum("total") / F.sum("n")).alias("mae")).collect()
    return [r["mae"] for r in sorted(found, key=lambda r: r["fit"])]


def landmark_column(inputs: KernelInputs, columns: Sequence[Column]) -> Column:
    """Kernel values with the landmarks, as an array column."""

    @F.pandas_udf("array<double>")
    def values(x: pd.DataFrame) -> pd.Series:
        x.columns = list(inputs.features)
        return pd.Series(list(kernel_values(inputs.standard(x), inputs.marks, inputs.gamma)))

    return values(F.struct(*columns))


class KernelRegression(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted kernel model over standardised columns; its size is that of its landmarks."""

    inputCols = Param(Params._dummy(), "inputCols", "inputs", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "prediction", TypeConverters.toString)
    marks = Param(Params._dummy(), "marks", "landmarks, one after the other", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "one per landmark", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, marks=None, weights=None, intercept=None, gamma=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, fit: KernelFit, inputs: Sequence[str], out: str) -> KernelRegression:
        return cls(
            inputCols=list(inputs), outputCol=out, marks=fit.inputs.marks.ravel().tolist(),
            weights=(fit.inputs.root @ fit.weights[:-1]).tolist(), intercept=float(fit.weights[-1]),
            gamma=float(fit.inputs.gamma),
        )

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault(self.inputCols)
        marks = np.array(self.getOrDefault(self.marks)).reshape(-1, len(cols))
        weights, gamma = np.array(self.getOrDefault(self.weights)), self.getOrDefault(self.gamma)
        intercept = self.getOrDefault(self.intercept)

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            return pd.Series(kernel_values(x.to_numpy(dtype=float), marks, gamma) @ weights + intercept)

        return df.withColumn(self.getOrDefault(self.outputCol), score(F.struct(*cols)))

"""Least squares from additive sums: many folds, penalties and feature sets from one pass.

A row contributes products of z = (1, x, m, y), with x the features (0 where missing, shifted by a
centre) and m their missing flags. Sums of these products add up over blocks, so the sums of every
expanding fold are prefix sums of the blocks, and imputing a median is a linear change of them: no
row is read again for another fold, median, penalty or feature set. The small systems are solved
by elimination in column expressions, one row per group and fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.operators.orderstat import exact_medians
from aerocal.operators.timeaxis import null_safe_join
from aerocal.session import materialise

#: Up to this many fitted rows are broadcast to the rows they score.
BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class LinearSetting:
    """A feature set and a ridge penalty (0: least squares) on features divided by their deviation."""

    features: tuple[str, ...]
    alpha: float = 0.0


def fold_medians(
    df: DataFrame, features: Sequence[str], block: str, n_splits: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Medians of the train rows of every expanding fold: keys, ``fold``, one column per feature."""
    folds = F.explode(F.sequence(F.col(block).cast("int"), F.lit(n_splits - 1))).alias("fold")
    train = df.where(F.col(block) < n_splits).select(*keys, *features, folds)
    return exact_medians(train, features, [*keys, "fold"])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def block_sums(
    df: DataFrame, features: Sequence[str], label: str, centre: dict[str, float], by: Sequence[str]
) -> DataFrame:
    """One aggregate: the sums of all products of (1, x, m, y) per group."""
    p = range(len(features))
    rows = df.select(
        *by, F.col(label).cast("double").alias("y"),
        *[F.coalesce(F.col(c).cast("double") - F.lit(centre[c]), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)],
        *[F.col(c).isNull().cast("double").alias(f"m{i}") for i, c in enumerate(features)],
    )
    sums = {"n": "double(count(*))", "y": "sum(y)"}
    for i in p:
        sums |= {f"x_{i}": f"sum(x{i})", f"m_{i}": f"sum(m{i})", f"xy_{i}": f"sum(x{i} * y)", f"my_{i}": f"sum(m{i} * y)"}
        sums |= {f"xx_{i}_{j}": f"sum(x{i} * x{j})" for j in p if i <= j}
        sums |= {f"mm_{i}_{j}": f"sum(m{i} * m{j})" for j in p if i <= j}
        sums |= {f"xm_{i}_{j}": f"sum(x{i} * m{j})" for j in p if i != j}
    return rows.groupBy(*by).agg(*[F.expr(f"{v} AS _{k}") for k, v in sums.items()])


def prefix_sums(sums: DataFrame, block: str, n_splits: int, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of the train rows of every fold: the blocks up to it, added."""
    names = [c for c in sums.columns if c not in (*keys, block)]
    folds = F.explode(F.sequence(F.col(block).cast("int"), F.lit(n_splits - 1))).alias("fold")
    opened = sums.where(F.col(block) < n_splits).select(*keys, *names, folds)
    return opened.groupBy(*keys, "fold").agg(*[F.sum(c).alias(c) for c in names])


def _eliminated(matrix: str, size: str) -> str:
    """SQL of the solution of a symmetric positive system, given as rows with the right side last.

    A pivot without weight leaves its unknown at zero.
    """
    kind = "array<array<double>>"
    inverse = "if(rows[k][k] > 1e-12D, 1 / rows[k][k], 0D)"
    step = (
        f"transform(rows, (row, i) -> if(i = k, transform(row, v -> v * {inverse}), "
        f"zip_with(row, rows[k], (v, p) -> v - row[k] * {inverse} * p)))"
    )
    done = f"aggregate(sequence(0, {size} - 1), CAST({matrix} AS {kind}), (rows, k) -> CAST({step} AS {kind}))"
    return f"transform({done}, row -> row[{size}])"


def solved(
    sums: DataFrame, settings: Sequence[LinearSetting], features: Sequence[str], centre: dict[str, float],
    keep: Sequence[str],
) -> DataFrame:
    """Fits of every setting: ``keep``, ``fits`` array of (intercept, slopes of all features).

    ``sums`` carries the medians of the features under their names. Slopes are on the raw features;
    a feature that a setting does not use has slope zero.
    """
    p = range(len(features))
    kept = [_quoted(c) for c in keep]
    lifted = [f"(coalesce({_quoted(c)}, {centre[c]!r}D) - {centre[c]!r}D) AS f{i}" for i, c in enumerate(features)]
    first = sums.selectExpr(*kept, *[c for c in sums.columns if c.startswith("_")], *lifted)

    def product(i: int, j: int) -> str:
        if i == j:
            return f"_xx_{i}_{i} + f{i} * f{i} * _mm_{i}_{i}"
        return f"_xx_{i}_{j} + f{i} * f{j} * _mm_{i}_{j} + f{j} * _xm_{i}_{j} + f{i} * _xm_{j}_{i}"

    second = first.selectExpr(
        *kept, "_n AS n", "_y / _n AS y",
        *[f"(_x_{i} + f{i} * _m_{i}) / _n AS a{i}" for i in p],
        *[f"({product(i, j)}) / _n AS r{i}_{j}" for i in p for j in p if i <= j],
        *[f"(_xy_{i} + f{i} * _my_{i}) / _n AS r{i}_y" for i in p],
    )

    def cell(i: int, j: int) -> str:
        i, j = min(i, j), max(i, j)
        return f"r{i}_{j} - a{i} * a{j}"

    matrix = ", ".join(f"array({', '.join(cell(i, j) for j in p)})" for i in p)
    third = second.selectExpr(
        *kept, "n", "y", f"array({', '.join(f'a{i}' for i in p)}) AS means", f"array({matrix}) AS cov",
        f"array({', '.join(f'r{i}_y - a{i} * y' for i in p)}) AS right",
        # a feature without spread is divided by one
        f"array({', '.join(f'if({cell(i, i)} > 0, sqrt({cell(i, i)}), 1D)' for i in p)}) AS spread",
    )
    uses = [f"named_struct('use', array({', '.join(str(features.index(c)) for c in x.features)}), 'alpha', {x.alpha!r}D)" for x in settings]
    rows = (
        "transform(s.use, a -> concat(transform(s.use, b -> cov[a][b] / (spread[a] * spread[b]) + if(a = b, s.alpha / n, 0D)), "
        "array(right[a] / spread[a])))"
    )
    weights = third.selectExpr(
        "*", f"transform(array({', '.join(uses)}), s -> named_struct('use', s.use, 'w', {_eliminated(rows, 'size(s.use)')})) AS found"
    )
    slopes = (
        f"transform(found, s -> transform(sequence(0, {len(features) - 1}), "
        "i -> if(array_contains(s.use, i), s.w[array_position(s.use, i) - 1] / spread[i], 0D)))"
    )
    centres = ", ".join(f"{centre[c]!r}D" for c in features)
    level = (
        f"y - aggregate(zip_with(w, zip_with(means, array({centres}), (m, c) -> m + c), (v, m) -> v * m), 0D, (t, v) -> t + v)"
    )
    return weights.selectExpr("*", f"{slopes} AS slopes").selectExpr(
        *kept, f"transform(slopes, w -> named_struct('intercept', {level}, 'slopes', w)) AS fits"
    )


def _centre(medians: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = medians.agg(*[F.avg(c).alias(c) for c in features]).first()
    return {c: row[c] or 0.0 for c in features}


def fit_linear(
    df: DataFrame, label: str, settings: Sequence[LinearSetting], keys: Sequence[str] = ()
) -> DataFrame:
    """Every setting fitted to every group: keys, ``setting``, intercept, slopes (a map), medians (a map)."""
    keys = list(keys)
    features = list(dict.fromkeys(c for x in settings for c in x.features))
    rows = df.where(F.col(label).isNotNull())
    medians = exact_medians(rows, features, keys)
    centre = _centre(medians, features)
    sums = block_sums(rows, features, label, centre, keys)
    if keys:
        sums = null_safe_join(sums, medians, keys)
    else:
        found = medians.first()
        sums = sums.withColumns({c: F.lit(found[c]).cast("double") for c in features})
    fits = solved(sums, settings, features, centre, [*keys, *features])
    used = F.array(*[F.array(*map(F.lit, x.features)) for x in settings])
    opened = fits.select(*keys, *features, F.posexplode("fits").alias("setting", "fit"))
    names = F.array(*map(F.lit, features))
    slopes = F.map_filter(
        F.map_from_arrays(names, F.col("fit.slopes")), lambda c, _: F.array_contains(F.get(used, F.col("setting")), c)
    )
    return opened.select(
        *keys, "setting", F.col("fit.intercept").alias("intercept"), slopes.alias("slopes"),
        F.map_from_arrays(names, F.array(*features)).alias("medians"),
    )


def fold_errors(
    df: DataFrame, label: str, settings: Sequence[LinearSetting], block: str = "block", n_splits: int = 4,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean absolute error of every setting on the test block of every fold, per group.

    Returns keys, ``fold``, ``setting``, ``mae``, ``n``. Besides the medians the rows are read twice: for
    the sums, and for the errors of all settings at once.
    """
    keys = list(keys)
    features = list(dict.fromkeys(c for x in settings for c in x.features))
    rows = df.where(F.col(label).isNotNull())
    medians = materialise(fold_medians(rows, features, block, n_splits, keys), "medians")
    centre = _centre(medians, features)
    sums = prefix_sums(block_sums(rows, features, label, centre, [*keys, block]), block, n_splits, keys)
    filled = null_safe_join(sums, medians, [*keys, "fold"])
    fits = materialise(solved(filled, settings, features, centre, [*keys, "fold", *features]), "fits")
    fits = fits.withColumnsRenamed({c: f"_m_{c}" for c in features})
    few = F.broadcast(fits) if fits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else fits
    tested = null_safe_join(
        rows.where(F.col(block) > 0).withColumn("fold", (F.col(block) - 1).cast("int")), few, [*keys, "fold"]
    )
    value = [F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(centre[c])) for c in features]
    scored = tested.select(*keys, "fold", F.col(label).cast("double").alias("_y"), "fits", F.array(*value).alias("_x"))
    errors = []
    for k, setting in enumerate(settings):
        at = f"fits[{k}]"
        guess = " + ".join([f"{at}.intercept", *[f"{at}.slopes[{i}] * _x[{i}]" for i in map(features.index, setting.features)]])
        errors.append(f"named_struct('setting', {k}, 'mae', avg(abs(_y - ({guess}))))")
    found = scored.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("n"), F.expr(f"array({', '.join(errors)}) AS e"))
    return found.select(*keys, "fold", "n", F.inline("e")).select(*keys, "fold", "setting", "mae", "n")


def grid_errors(errors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the folds of every setting: keys, ``setting``, ``cv_mae``."""
    return errors.groupBy(*keys, "setting").agg(F.avg("mae").alias("cv_mae"))

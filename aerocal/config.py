"""Fixed values and run settings shared by the operators and plans."""

from __future__ import annotations

from dataclasses import dataclass, field

# Spanish month names and their two-digit numbers.
MONTH_NUMBERS = {
    "enero": "01",
    "febrero": "02",
    "marzo": "03",
    "abril": "04",
    "mayo": "05",
    "junio": "06",
    "julio": "07",
    "agosto": "08",
    "septiembre": "09",
    "octubre": "10",
    "noviembre": "11",
    "diciembre": "12",
}

# File-name code of a station variable and its output column.
STATION_VARIABLES = {
    "co": "CO_ref",
    "o3": "O3_ref",
    "rh": "RH_ref",
    "tmp": "Temp_ref",
}

# Texts that mean "no reading".
SENTINELS = ("nr", "NR", "Na", "NA", "")

# Accepted temperature range, both ends kept.
TEMPERATURE_RANGE = (-10.0, 40.0)


@dataclass(frozen=True)
class Compensation:
    """Ozone compensation o3/d + a*T^2 + b*T + c*H^2 + e*H + k."""

    divisor: float = 1.451
    temp_sq: float = 0.1034
    temp: float = -2.225
    rh_sq: float = 0.01223
    rh: float = -1.984
    constant: float = 79.0


@dataclass(frozen=True)
class SplitSpec:
    """Months of the train and test rows; ``year`` narrows both when given."""

    train_months: tuple[int, ...] = (3, 4, 5, 6)
    test_months: tuple[int, ...] = (7,)
    year: int | None = None


@dataclass(frozen=True)
class TargetSpec:
    """What is calibrated: label, raw features (signal, temp, rh), baseline kind."""

    name: str
    label: str
    features: tuple[str, str, str]
    unit: str
    baseline: str  # "compensated" or "linear"

    @property
    def rolling_features(self) -> tuple[str, ...]:
        return tuple(f"{c}_rm3h" for c in self.features)

    @property
    def extended_features(self) -> tuple[str, ...]:
        return self.features + self.rolling_features


TARGETS = {
    "O3": TargetSpec("O3", "O3_ref", ("O3_lcs_ppb", "Temp_lcs", "RH_lcs"), "ppb", "compensated"),
    "CO": TargetSpec("CO", "CO_ref", ("CO_lcs_ppm", "Temp_lcs", "RH_lcs"), "ppm", "linear"),
}


def target_spec(name: str) -> TargetSpec:
    """Look up a target by name, ignoring case."""
    try:
        return TARGETS[name.upper()]
    except KeyError:
        raise ValueError(f"target must be one of {sorted(TARGETS)}, got {name!r}") from None


@dataclass(frozen=True)
class ForestParams:
    """Random-forest settings; ``max_features`` is 'all', 'sqrt' or a fraction."""

    trees: int = 300
    max_depth: int = 20
    min_leaf: int = 2
    max_features: str | float = "all"
    max_bins: int = 256
    seed: int = 42


@dataclass(frozen=True)
class RidgeParams:
    alpha: float = 1.0


@dataclass(frozen=True)
class KernelParams:
    """RBF regression: penalty ``c``, landmarks (a bounded sample of train rows), width (None: 1/p),
    half-width of the band without loss, steps and the relative gain at which they end."""

    c: float = 1.0
    landmarks: int = 64
    gamma: float | None = None
    epsilon: float = 0.1
    max_iter: int = 25
    tolerance: float = 1e-4


@dataclass(frozen=True)
class Candidate:
    """One model family with its settings grid; ``with_baseline`` adds y_baseline."""

    name: str
    grid: tuple = field(default_factory=tuple)
    with_baseline: bool = False


def default_forest_grid() -> tuple[ForestParams, ...]:
    return tuple(
        ForestParams(trees=t, max_depth=d, min_leaf=leaf, max_features=mf)
        for t in (150, 250)
        for d in (6, 8)
        for leaf in (3, 5)
        for mf in ("sqrt", 0.8)
    )


def default_ridge_grid() -> tuple[RidgeParams, ...]:
    return tuple(RidgeParams(a) for a in (0.5, 1.0, 2.0, 5.0))


def default_kernel_grid() -> tuple[KernelParams, ...]:
    return tuple(KernelParams(c=c) for c in (1.0, 5.0, 10.0, 50.0))


def default_candidates() -> tuple[Candidate, ...]:
    """Forest and ridge, each without and with the baseline as a feature."""
    return (
        Candidate("forest", default_forest_grid(), False),
        Candidate("forest_on_baseline", default_forest_grid(), True),
        *ridge_candidates(),
    )


def ridge_candidates() -> tuple[Candidate, ...]:
    return (
        Candidate("ridge", default_ridge_grid(), False),
        Candidate("ridge_on_baseline", default_ridge_grid(), True),
    )


# The fixed forest used when two residual models are compared without tuning it.
COMPARISON_FOREST = ForestParams(trees=250, max_depth=6, min_leaf=5)

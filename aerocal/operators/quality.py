"""Coverage reports and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerocal.functions import coverage


def coverage_total(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of rows with a value: one row (variable, coverage) per column."""
    one = df.agg(*[coverage(F.col(c)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("coverage")) for c in columns])
    return one.select(F.inline(pairs))


def coverage_by(df: DataFrame, label: Column, columns: Sequence[str], digits: int | None = 1) -> DataFrame:
    """Percent of rows with a value per label (a month, a day) and column."""
    def pct(c: str) -> Column:
        value = coverage(F.col(c))
        return value if digits is None else F.round(value, digits)

    return df.groupBy(label).agg(*[pct(c).alias(c) for c in columns])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; table has {df.columns}")
    return df


def optional_column(df: DataFrame, name: str) -> Column:
    """The column as double if the table has it, else a null double."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast("double")


def require_splits(df: DataFrame, split: str = "split", needed: Sequence[str] = ("train", "test")) -> dict:
    """Row count per split; raises when a needed one is empty."""
    found = {
        r[split]: r["n"]
        for r in df.where(F.col(split).isin(*needed))
        .groupBy(split)
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    empty = [s for s in needed if not found.get(s)]
    if empty:
        raise ValueError(f"no rows in {empty}; check dates and columns")
    return found

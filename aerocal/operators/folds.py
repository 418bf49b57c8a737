"""Temporal splits: expanding-window folds found by rank, not by numbering rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerocal.operators.orderstat import values_at_ranks


def fold_starts(df: DataFrame, order: Sequence[str], n_splits: int = 4) -> list[tuple]:
    """Order keys of the first row of each test fold.

    With n rows and t = n // (n_splits + 1), test fold k starts at 0-based row
    n - (n_splits - k) * t. Only those few ranks are looked up: by the first column of ``order``, then
    among the rows that share its value by the next. Rows must be distinct in ``order``.
    """
    order = list(order)
    keys = df.select(*order)
    n = keys.count()
    size = n // (n_splits + 1)
    if size == 0:
        raise ValueError(f"{n} rows are too few for {n_splits} temporal folds")
    # what is found so far of each key, the rank among the rows that share it, and their number
    found = [((), n - (n_splits - k) * size, n) for k in range(n_splits)]
    for depth, column in enumerate(order):
        lead = order[:depth]
        part = keys
        if lead:
            part = keys.where(reduce(Column.__or__, [_same(df, lead, x[0]) for x in found]))
        targets = [lambda _, x=x: [F.when(_same(df, lead, x[0]), F.lit(x[1]))] for x in found]
        hits = {row["target"]: row for row in values_at_ranks(part, column, targets, lead).collect()}
        for i, (head, rank, shared) in enumerate(found):
            hit = hits.get(i)
            if hit is None or hit["n"] < shared:
                raise ValueError(f"order column {column!r} holds nulls")
            found[i] = ((*head, hit["value"]), rank - hit["n_less"], hit["n_equal"])
    if any(shared > 1 for _, _, shared in found):
        raise ValueError(f"rows repeat in {order}; add a column that tells them apart")
    return [head for head, _, _ in found]


def _same(df: DataFrame, columns: Sequence[str], values: tuple) -> Column:
    terms = [F.col(c) == _literal(df, c, v) for c, v in zip(columns, values, strict=True)]
    return reduce(Column.__and__, terms, F.lit(True))


def _literal(df: DataFrame, name: str, value) -> Column:
    # A datetime literal would be read in the session's zone; its text is not.
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(df.schema[name].dataType)


def with_fold_block(
    df: DataFrame, order: Sequence[str], starts: Sequence[tuple], block: str = "block"
) -> DataFrame:
    """Add how many fold starts lie at or before each row: 0 .. n_splits.

    Fold k trains on blocks 0..k and tests on block k + 1. A comparison per row,
    no shuffle.
    """
    key = F.struct(*[F.col(c) for c in order])
    number = F.lit(0)
    for start in starts:
        bound = F.struct(*[_literal(df, c, v).alias(c) for c, v in zip(order, start, strict=True)])
        number = number + (key >= bound).cast("int")
    return df.withColumn(block, number)


def fold_members(df: DataFrame, n_splits: int = 4, block: str = "block") -> DataFrame:
    """One row per (row, fold) with its role, as the splitter would list them."""
    roles = F.array(
        *[
            F.struct(
                F.lit(k).alias("fold"),
                F.when(F.col(block) <= k, F.lit("train"))
                .when(F.col(block) == k + 1, F.lit("test"))
                .alias("role"),
            )
            for k in range(n_splits)
        ]
    )
    return df.select("*", F.inline(roles)).where(F.col("role").isNotNull())

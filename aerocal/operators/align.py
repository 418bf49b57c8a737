"""Joins and alignment of series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerocal.operators.timeaxis import numbered


def outer_join_variables(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of several tables on the same keys.

    The tables are stacked and grouped by key, so one shuffle serves any number of them. A key that
    repeats in a table multiplies, as joins do; its rows meet in one group, as they do in a join. Rows
    with a null key match nothing and stay alone. Columns besides the keys must differ.
    """
    on = list(on)
    rests = [[c for c in t.columns if c not in on] for t in tables]
    names = [c for rest in rests for c in rest]
    if len(set(names)) < len(names):
        raise ValueError(f"tables share columns besides {on}: {names}")
    kinds = [
        T.StructType([f for f in t.schema.fields if f.name in rest]).simpleString() for t, rest in zip(tables, rests)
    ]
    stacked = reduce(
        DataFrame.unionByName,
        [
            t.select(
                *on,
                *[
                    (F.struct(*rest) if i == j else F.lit(None).cast(kind)).alias(f"_t{j}")
                    for j, (rest, kind) in enumerate(zip(rests, kinds))
                ],
            )
            for i, (t, rest) in enumerate(zip(tables, rests))
        ],
    )
    complete = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in on])
    lists = stacked.where(complete).groupBy(*on).agg(*[F.collect_list(f"_t{j}").alias(f"_t{j}") for j in range(len(tables))])
    for j in range(len(tables)):
        lists = lists.withColumn(f"_t{j}", F.explode_outer(f"_t{j}"))
    return lists.unionByName(stacked.where(~complete)).select(
        *on, *[F.col(f"_t{j}")[c].alias(c) for j, rest in enumerate(rests) for c in rest]
    )


def pivot_variables(
    long: DataFrame, keys: Sequence[str], variable: str, value: str, names: Mapping[str, str]
) -> DataFrame:
    """Wide table from (keys, variable, value): one shuffle instead of n-1 joins.

    ``names`` maps variable to output column. Where a variable repeats under one
    key the smallest value is kept, so the result does not depend on row order.
    """
    return long.groupBy(*keys).agg(
        *[F.min(F.when(F.col(variable) == v, F.col(value))).alias(out) for v, out in names.items()]
    )


def fuse(sensor: DataFrame, reference: DataFrame, on: Sequence[str]) -> DataFrame:
    """Sensor rows with reference columns where the reference has that key."""
    return sensor.join(reference, list(on), "left")


def align_by_position(
    left: DataFrame, right: DataFrame, ts: str = "ts", keys: Sequence[str] = (), strict: bool = True
) -> DataFrame:
    """Row i of one table with row i of the other, in order of ``ts``, per series or over all rows.

    ``strict`` raises when the lengths differ, as position has no meaning then. Both inputs keep
    their own columns; ``ts`` of the right one is dropped. Rows are numbered by range
    (:func:`aerocal.operators.timeaxis.numbered`), so no series is sorted in one task.
    """
    keys = list(keys)
    if strict:
        _require_same_length(left, right, keys)
    a = numbered(left, keys, [ts], "_pos")
    b = numbered(right, keys, [ts], "_pos").drop(ts)
    return a.join(b, keys + ["_pos"], "inner").drop("_pos")


def _require_same_length(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    if not keys:
        n_left, n_right = left.count(), right.count()
        if n_left != n_right:
            raise ValueError(f"series lengths differ: {n_left} and {n_right}")
        return
    size = F.count(F.lit(1))
    sizes = left.groupBy(*keys).agg(size.alias("n_left")).join(
        right.groupBy(*keys).agg(size.alias("n_right")), keys, "full"
    )
    bad = sizes.where(~F.col("n_left").eqNullSafe(F.col("n_right"))).first()
    if bad is not None:
        raise ValueError(f"series lengths differ: {bad.asDict()}")


def compare_sources(
    sources: Mapping[str, DataFrame],
    variables: Mapping[str, Mapping[str, str]],
    on: Sequence[str] = ("ts",),
) -> DataFrame:
    """Long table (*on, variable, source, value) of several sources by time.

    ``variables`` maps variable to {source: column}. Every time any source of a
    variable has appears once per source of that variable, null where it has none.
    The union is grouped by time, so no source is joined to another.
    """
    parts = []
    for variable, columns in variables.items():
        names = list(columns)
        stacked = reduce(
            DataFrame.unionByName,
            [
                sources[s].select(
                    *on,
                    *[
                        (F.col(columns[s]).cast("double") if n == s else F.lit(None).cast("double")).alias(n)
                        for n in names
                    ],
                )
                for s in names
            ],
        )
        wide = stacked.groupBy(*on).agg(*[F.min(n).alias(n) for n in names])
        pairs = F.array(*[F.struct(F.lit(n).alias("source"), F.col(n).alias("value")) for n in names])
        parts.append(wide.select(*on, F.lit(variable).alias("variable"), F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)


def stack_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; columns are matched by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_rows(df: DataFrame, n: int = 12, order: Sequence[str] = ("ts",)) -> DataFrame:
    """The first ``n`` rows in order; Spark keeps n rows per task, not a full sort."""
    return df.orderBy(*order).limit(n)

"""Exact order statistics by refining equal-width histograms.

Each wanted rank lies in a bracket of values, at first the whole range of its group. One
pass over the rows cuts every bracket into buckets of equal width, counts them map-side and keeps
the bucket that holds the rank, narrowed to the smallest and largest value in it. This goes on, for all
groups and columns in the same pass, until a bracket holds one value or at most ``LEAF_ROWS`` rows; only
those rows are counted per value and put in order. The way is the same at every size: few
rows need no pass but the last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerocal.operators.timeaxis import null_safe_join
from aerocal.session import materialise

#: Buckets a bracket is cut into, and the rows of a bracket that are put in order.
BUCKETS = 4096
LEAF_ROWS = 100_000

#: Up to this many brackets pass through the driver and are broadcast; more are written and joined.
_HELD_ROWS = 10_000

Ranks = Callable[[Column], Sequence[Column]]


def position(value: Column, kind: T.DataType) -> Column:
    """A double that never falls where the value rises."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampNTZType | T.TimestampType):
        # of the written time, so that no zone and no clock change has a part in it
        day = F.unix_date(value.cast("date")).cast("double") * 86400
        return day + F.hour(value) * 3600 + F.minute(value) * 60 + F.date_part(F.lit("SECONDS"), value).cast("double")
    if isinstance(kind, T.NumericType | T.BooleanType):
        return value.cast("double")
    raise TypeError(f"ranks need numbers or times, not {kind.simpleString()}")


def values_at_ranks(
    df: DataFrame,
    value: str,
    targets: Sequence[Ranks],
    keys: Sequence[str] = (),
    buckets: int = BUCKETS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Rows of 0-based ranks per group, nulls left out.

    Each target is a function from the group's row count to ranks; it may name key columns, and a
    null rank is not looked for. Returns the keys and ``target, rank, n, value, n_less, n_equal``.
    A group without values has one row per target with null rank and value.
    """
    keys = list(keys)
    kind = df.schema[value].dataType
    slim = df.select(*keys, F.col(value).alias("_v"))
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("target"), r.cast("bigint").alias("rank"))
            for i, ranks in enumerate(targets)
            for r in ranks(F.col("n"))
        ]
    )
    ranged = slim.groupBy(*keys).agg(
        F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    empty = F.array(*[F.struct(F.lit(i).alias("target"), F.lit(None).cast("bigint").alias("rank")) for i in range(len(targets))])
    state, few = _held(
        ranged.select(
            *keys, "n", "lo", "hi", F.lit(0).cast("bigint").alias("n_less"), F.col("n").alias("inside"),
            F.inline(F.when(F.col("n") > 0, entries).otherwise(empty)),
        ).where("n = 0 OR rank IS NOT NULL")
    )
    done = []
    low, high, at = (position(F.col(c), kind) for c in ("lo", "hi", "_v"))
    wide = (F.col("inside") > leaf_rows) & (low < high)
    while True:
        done.append(state.where(~wide | F.col("lo").isNull()))
        state = state.where(wide)
        if state.isEmpty():
            break
        share = (at / 2 - low / 2) / (high / 2 - low / 2) * buckets
        bucket = (
            F.when(at <= low, 0)
            .when(at >= high, buckets - 1)
            .otherwise(F.least(F.lit(buckets - 1), F.nanvl(F.floor(share).cast("double"), F.lit(buckets / 2))))
        )
        counted = (
            _inside(slim, state, keys, few)
            .groupBy(*keys, "lo", bucket.cast("int").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("size"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        )
        running = W.partitionBy(*keys, "lo").orderBy("bucket")
        counted = counted.withColumn("below", F.sum("size").over(running) - F.col("size"))
        state, few = _held(
            null_safe_join(state, counted, [*keys, "lo"])
            .where(_holds("below", "size"))
            .select(
                *keys, "n", F.col("least").alias("lo"), F.col("most").alias("hi"),
                (F.col("n_less") + F.col("below")).alias("n_less"), F.col("size").alias("inside"), "target", "rank",
            )
        )
    brackets = done[0]
    for more in done[1:]:
        brackets = brackets.unionByName(more)
    single = F.col("lo").isNull() | (F.col("lo") == F.col("hi"))
    known = brackets.where(single).select(
        *keys, "target", "rank", "n", F.col("lo").alias("value"), "n_less", F.col("inside").alias("n_equal")
    )
    open_ = brackets.where(~single)
    if few and open_.isEmpty():
        return known
    valued = _inside(slim, open_, keys, few).groupBy(*keys, "lo", "_v").agg(F.count(F.lit(1)).alias("size"))
    running = W.partitionBy(*keys, "lo").orderBy("_v")
    valued = valued.withColumn("below", F.sum("size").over(running) - F.col("size"))
    found = (
        null_safe_join(open_, valued, [*keys, "lo"])
        .where(_holds("below", "size"))
        .select(
            *keys, "target", "rank", "n", F.col("_v").alias("value"),
            (F.col("n_less") + F.col("below")).alias("n_less"), F.col("size").alias("n_equal"),
        )
    )
    return known.unionByName(found)


def _holds(below: str, size: str) -> Column:
    """Whether a run of ``size`` values behind ``below`` others of the bracket holds the rank."""
    inner = F.col("rank") - F.col("n_less")
    return (inner >= F.col(below)) & (inner < F.col(below) + F.col(size))


def _held(state: DataFrame) -> tuple[DataFrame, bool]:
    """The brackets, kept so that no reader computes them anew, and whether they are few."""
    rows = state.limit(_HELD_ROWS + 1).collect()
    if len(rows) <= _HELD_ROWS:
        return state.sparkSession.createDataFrame(rows, state.schema), True
    return materialise(state, "brackets"), False


def _inside(slim: DataFrame, state: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Rows with the bracket they fall in; brackets of a group are equal or apart."""
    if not keys and not few:
        spans = F.collect_set(F.struct("lo", "hi")).alias("spans")
        hit = F.filter("spans", lambda s: (F.col("_v") >= s["lo"]) & (F.col("_v") <= s["hi"]))
        return slim.withColumn("spans", state.agg(spans).scalar()).select("_v", F.inline(hit))
    # a plain join on the keys stays in generated code; a look through arrays of spans does not
    spans = state.select(*keys, "lo", "hi").where("lo IS NOT NULL").distinct()
    spans = F.broadcast(spans) if few else spans
    within = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    if not keys:
        return slim.join(spans, within)
    # small integers that are never null are looked up as one number; null-safe keys are compared as rows
    plain = not any(slim.schema[k].nullable for k in keys)
    bound = slim.join(spans, keys) if plain else null_safe_join(slim, spans, keys)
    return bound.where(within).select(*keys, "_v", "lo", "hi")


def _middle(n: Column) -> list[Column]:
    return [F.floor((n - 1) / 2), F.floor(n / 2)]


def exact_medians(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    buckets: int = BUCKETS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Exact median per column, averaging the middle pair; one row per group.

    All columns and groups are looked up in the same passes. A group without values in a column
    has a null median there.
    """
    columns, keys = list(columns), list(keys)
    pairs = [F.struct(F.lit(i).alias("_name"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns)]
    long = df.select(*keys, F.inline(F.array(*pairs)))
    at = values_at_ranks(long, "_x", [_middle], [*keys, "_name"], buckets, leaf_rows)
    # two middle ranks per column, equal when the count is odd; none if all are null
    return at.groupBy(*keys).agg(
        *[F.avg(F.when(F.col("_name") == i, F.col("value"))).alias(c) for i, c in enumerate(columns)]
    )

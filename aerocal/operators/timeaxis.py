"""Resampling, gap filling and ordered-row operators on series keyed tables.

Two kinds of input are told apart, because their group sizes differ:

* *grids*: one row per series and time bin, as :func:`resample` returns. A
  series then has at most (last - first) / bin rows however many raw readings
  it had, so a window over one series is bounded by the calendar.
* *raw rows*: any number of readings per series; one series, or one instant of it, may hold
  a third of the table. Rows are numbered by range, windows run over chunks of so many
  rows, and what crosses a chunk border travels through summaries of chunks and of chunk groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerocal.session import materialise

Names = Sequence[str]


def numeric_columns(df: DataFrame, exclude: Names = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def time_bin(ts: Column, every: str = "1 hour") -> Column:
    """Start of the bin holding ``ts``; closed and labelled left, epoch aligned."""
    return F.window(ts, every).start


def resample(
    df: DataFrame,
    keys: Names,
    ts: str = "ts",
    values: Names | None = None,
    every: str = "1 hour",
    fill_gaps: bool = True,
    parts: int | None = None,
) -> DataFrame:
    """Mean of every numeric column per series and time bin.

    Rows without a time are dropped, nulls are skipped, and empty bins between a
    series' first and last bin appear with null values when ``fill_gaps``.
    Partial means are combined before the shuffle, so a hot series costs one row
    per bin and map task.
    """
    keys = list(keys)
    values = list(values) if values is not None else numeric_columns(df, keys + [ts])
    out = (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, time_bin(F.col(ts), every).alias(ts))
        .agg(*[F.avg(c).alias(c) for c in values])
    )
    return fill_time_gaps(out, keys, ts, every, parts) if fill_gaps else out


def fill_time_gaps(
    grid: DataFrame, keys: Names, ts: str = "ts", every: str = "1 hour", parts: int | None = None
) -> DataFrame:
    """Regular bins from first to last per series; added rows carry nulls.

    Each row emits itself and the missing bins up to its successor, so no spine
    is built and no join is needed: one shuffle by series, shared with any later
    window over the same series. ``parts`` deals the series over so many tasks.
    """
    return _filled(grid, keys, ts, every, parts)


def fill_and_roll(
    grid: DataFrame, columns: Names, keys: Names, ts: str = "ts", every: str = "1 hour", rows: int = 3,
    suffix: str = "_rm3h", parts: int | None = None,
) -> DataFrame:
    """:func:`fill_time_gaps`, then :func:`rolling_mean` on the filled grid, with one sort.

    Rows of a filled grid are bins, so the trailing rows of a bin are those of a time range before the
    rows are opened: each row carries the means of itself and of the next ``rows`` - 1 bins, and the added
    bins take theirs from it. The opened rows, many times more, are not sorted. Needs one row per series and bin.
    """
    return _filled(grid, keys, ts, every, parts, {f"{c}{suffix}": c for c in columns}, rows)


def _filled(
    grid: DataFrame, keys: Names, ts: str, every: str, parts: int | None, rolled: dict[str, str] | None = None, rows: int = 0
) -> DataFrame:
    keys, rolled = list(keys), rolled or {}
    step = F.expr(f"INTERVAL {every}")
    w = W.partitionBy(*keys).orderBy(ts)
    rest = [c for c in grid.columns if c not in keys and c != ts]
    if parts:
        grid = grid.repartition(parts, *keys)
    nxt = F.lead(ts).over(w)
    slots = F.when(nxt > F.col(ts) + step, F.sequence(F.col(ts), nxt - step, step)).otherwise(
        F.array(F.col(ts))
    )
    # the row i before lies at least i bins back, so only the reaches from i on can hold it
    reaches = range(1, rows)
    lags = {f"_b{i}_{c}": F.lag(c, i).over(w) for i in reaches for c in (ts, *rolled.values())} if rolled else {}
    bounds = {f"_reach_{k}": F.col(ts) - step * k for k in reaches} if rolled else {}
    near = {f"_near_{i}_{k}": F.col(f"_b{i}_{ts}") >= F.col(f"_reach_{k}") for k in reaches for i in reaches if i <= k} if rolled else {}
    means = {f"_m{k}_{out}": _trailing(c, k) for out, c in rolled.items() for k in range(rows)}
    ready = grid.withColumns({"_slots": slots, **lags, **bounds})
    # there always is a slot; without "outer" Spark would first filter by the arrays, made a second time for it
    opened = ready.withColumns(near).withColumns(means).select(
        *keys, *rest, *means, F.posexplode_outer("_slots").alias("_gap", "_slot")
    )
    return opened.select(
        *keys,
        F.col("_slot").alias(ts),
        *[F.when(F.col("_gap") == 0, F.col(c)).alias(c) for c in rest],
        *[F.coalesce(*[F.when(F.col("_gap") == rows - 1 - k, F.col(f"_m{k}_{out}")) for k in range(rows)]).alias(out) for out in rolled],
    ).select(*grid.columns, *rolled)


def _trailing(c: str, reach: int) -> Column:
    """Mean of the row's value and those of the rows before it within ``reach`` bins, nulls skipped."""
    near = [F.when(F.col(f"_near_{i}_{reach}"), F.col(f"_b{i}_{c}")) for i in range(reach, 0, -1)]
    values = [x.cast("double") for x in (*near, F.col(c))]  # the oldest first, as a window adds them
    total, n = F.lit(0.0), F.lit(0)
    for x in values:
        total, n = total + F.coalesce(x, F.lit(0.0)), n + x.isNotNull().cast("int")
    return F.when(n > 0, total / n)


def rolling_mean(
    grid: DataFrame, columns: Names, keys: Names, ts: str = "ts", rows: int = 3, suffix: str = "_rm3h"
) -> DataFrame:
    """Trailing mean over the last ``rows`` rows, nulls skipped, on a grid."""
    w = W.partitionBy(*keys).orderBy(ts).rowsBetween(1 - rows, 0)
    return grid.withColumns({f"{c}{suffix}": F.avg(c).over(w) for c in columns})


def _blend(rn: Column, x: Column, before: Column, after: Column, both: bool) -> Column:
    """Value at row ``rn`` on the line between two known (rn, x) neighbours."""
    share = (rn - before["rn"]) / (after["rn"] - before["rn"])
    inner = before["x"] + (after["x"] - before["x"]) * share
    pieces = [x, inner, before["x"]] + ([after["x"]] if both else [])
    return F.coalesce(*pieces)


def _numbered(df: DataFrame, part: Names, order: Names) -> DataFrame:
    """Add ``_rn``, the row's position in its part."""
    rn = F.row_number().over(W.partitionBy(*part).orderBy(*order))
    return df.withColumn("_rn", rn.cast("long"))


def _known(c: str) -> Column:
    """(rn, x) of a row with a value, else null."""
    pair = F.struct(F.col("_rn").alias("rn"), F.col(c).alias("x"))
    return F.when(F.col(c).isNotNull(), pair)


def _with_neighbours(rows: DataFrame, columns: Names, part: Names, order: Names) -> DataFrame:
    """Add, per column, the known (rn, x) at or before (``_p_``) and at or after
    (``_n_``) each numbered row. The backward look shares the sort that numbered them.

    The forward look is a backward look over the reversed rows: Spark restarts a frame
    that ends at "unbounded following" on every row, a growing prefix it only extends.
    """
    so_far = (W.unboundedPreceding, 0)
    back = W.partitionBy(*part).orderBy(*order).rowsBetween(*so_far)
    fwd = W.partitionBy(*part).orderBy(F.desc("_rn")).rowsBetween(*so_far)
    out = rows.withColumns({f"_p_{c}": F.last(_known(c), ignorenulls=True).over(back) for c in columns})
    return out.withColumns({f"_n_{c}": F.last(_known(c), ignorenulls=True).over(fwd) for c in columns})


def interpolate(
    grid: DataFrame, columns: Names, keys: Names, ts: str = "ts", both: bool = False
) -> DataFrame:
    """Linear interpolation by row position on a grid.

    Interior gaps are linear, trailing gaps repeat the last value, leading gaps
    stay null unless ``both``, where they take the first value.
    """
    out = _with_neighbours(_numbered(grid, keys, [ts]), columns, keys, [ts])
    rn = F.col("_rn")
    return out.withColumns(
        {c: _blend(rn, F.col(c), F.col(f"_p_{c}"), F.col(f"_n_{c}"), both) for c in columns}
    ).select(*grid.columns)


# Rows a window over raw rows may hold, and chunk summaries a window over them.
CHUNK_ROWS = 100_000
GROUP_CHUNKS = 10_000

# Up to this many offsets (one per partition and series) are broadcast; more are joined.
_OFFSET_ROWS = 100_000


def numbered(df: DataFrame, keys: Names, order: Names, out: str = "_rn") -> DataFrame:
    """Position of every row in its series, from 1, in an order of the whole table.

    Rows are sorted by range of (keys, order) and written with their partition and their place in
    it. A series may span partitions: its rows in earlier ones are added from one count per partition
    and series. So no window holds rows, and neither a hot series nor a hot time meets in one
    task. Rows that tie in ``order`` follow a hash of all their columns, so equal rows are the only ones
    whose places could be exchanged. Without ``keys`` the whole table is one series.
    """
    keys = list(keys)
    if not df.columns:
        raise ValueError("a table without columns has no order")
    tie = F.xxhash64(*[c for c, kind in df.dtypes if "map" not in kind])
    sort = [*keys, *order, "_tie"]
    placed = materialise(
        df.withColumn("_tie", tie)
        .repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .drop("_tie")
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}),
        "numbered",
    )
    present = _present_keys(df, keys)
    series = list(present)
    rows = placed.withColumns(present)
    counts = rows.groupBy("_part", *series).agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    # one row per partition of a series, at most as many as there are partitions
    before = W.partitionBy(*series) if series else W.partitionBy(F.lit(0))
    earlier = F.sum("_size").over(before.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = materialise(
        counts.select("_part", *series, (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_offset")), "offsets"
    )
    if offsets.limit(_OFFSET_ROWS + 1).count() <= _OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    joined = rows.join(offsets, ["_part", *series])
    return joined.select(*df.columns, (F.col("_at") + F.col("_offset")).alias(out))


def interpolate_raw(
    df: DataFrame,
    columns: Names,
    keys: Names,
    ts: str = "ts",
    both: bool = False,
    tie: Names = (),
    chunk_rows: int = CHUNK_ROWS,
    group_chunks: int = GROUP_CHUNKS,
) -> DataFrame:
    """:func:`interpolate` for raw rows, whatever the size of a series or of one instant of it.

    Rows are numbered (:func:`numbered`) and cut into chunks of ``chunk_rows``. Windows run per chunk;
    each chunk is reduced to its first and last known value. What lies outside a chunk comes from a
    scan over those summaries in groups of ``group_chunks`` chunks, and what lies outside a group from
    a scan over the groups. Rows without a time are left out; ``tie`` makes the order total
    where times repeat.
    """
    keys = list(keys)
    cols = df.columns
    rows = numbered(df.where(F.col(ts).isNotNull()), keys, [ts, *tie]).withColumns(_present_keys(df, keys))
    series = list(_present_keys(df, keys))
    rows = rows.withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk_rows))
    part = [*series, "_chunk"]
    ends = [
        side
        for c in columns
        for side in (F.max(_known(c)).alias(f"_tail_{c}"), F.min(_known(c)).alias(f"_head_{c}"))
    ]
    chunks = rows.groupBy(*part).agg(*ends)
    chunks = chunks.withColumn("_group", F.floor(F.col("_chunk") / group_chunks))
    group = [*series, "_group"]
    groups = chunks.groupBy(*group).agg(
        *[F.max(f"_tail_{c}").alias(f"_tail_{c}") for c in columns], *[F.min(f"_head_{c}").alias(f"_head_{c}") for c in columns]
    )
    groups = _outside(groups, columns, series, "_group").select(
        *group, *[F.col(f"_{side}_{c}").alias(f"_g{side}_{c}") for c in columns for side in ("in", "out")]
    )
    carries = (
        _outside(chunks, columns, group, "_chunk")
        .join(groups, group)
        .select(
            *part,
            *[
                F.coalesce(f"_{side}_{c}", f"_g{side}_{c}").alias(f"_{side}_{c}")
                for c in columns
                for side in ("in", "out")
            ],
        )
    )
    joined = _with_neighbours(rows, columns, part, ["_rn"]).join(carries, part)
    out = {
        c: _blend(
            F.col("_rn"), F.col(c), F.coalesce(f"_p_{c}", f"_in_{c}"), F.coalesce(f"_n_{c}", f"_out_{c}"), both
        )
        for c in columns
    }
    return joined.withColumns(out).select(*cols)


def _outside(summaries: DataFrame, columns: Names, series: Names, order: str) -> DataFrame:
    """Add the last known value before (``_in_``) and the first one behind (``_out_``) each summary."""
    earlier = (W.unboundedPreceding, -1)
    before = W.partitionBy(*series).orderBy(order).rowsBetween(*earlier)
    after = W.partitionBy(*series).orderBy(F.desc(order)).rowsBetween(*earlier)
    found = {}
    for c in columns:
        found[f"_in_{c}"] = F.last(f"_tail_{c}", ignorenulls=True).over(before)
        found[f"_out_{c}"] = F.last(f"_head_{c}", ignorenulls=True).over(after)
    return summaries.withColumns(found)


def _present_keys(df: DataFrame, keys: Names) -> dict[str, Column]:
    """Key columns that are never null: the value, or a filler beside a null flag.

    Windows and joins on them need no null-safe comparison, which would hash other
    expressions than the windows do and so shuffle the rows again.
    """
    present = {}
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        plain = isinstance(kind, T.NumericType)
        value = F.col(k) if plain else F.col(k).cast("string")
        present[f"_k{i}"] = F.coalesce(value, F.lit(0).cast(kind) if plain else F.lit(""))
        present[f"_z{i}"] = F.col(k).isNull()
    return present


def null_safe_join(left: DataFrame, right: DataFrame, on: Names, how: str = "inner") -> DataFrame:
    """Equi-join where null keys match each other; right keys are dropped."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = None
    for c in on:
        term = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = term if cond is None else cond & term
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def dedupe_first(df: DataFrame, keys: Names, order: Names) -> DataFrame:
    """One row per key: the first under ``order``.

    Spark prunes each map task to one row per key before the shuffle
    (``WindowGroupLimit``), so many copies of one key do not meet in one task.
    Keys may be null, as in the source tables; null keys count as equal.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")

"""A regression tree with exact splits, found by running sums over distinct values.

MLlib's forests bin their features; this tree tries every distinct value. Per level the rows are
read once and added up per (node, feature, value), map-side first. These sums are sorted by
range and written; a running sum inside each range partition, plus the totals of the earlier partitions
of the same node and feature, gives the sums left of every possible split. So no task holds all values of
a feature, and rows themselves are never sorted. Only the winning split of each node comes to the
driver, at most ``2 ** depth`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerocal.functions import all_present, masked
from aerocal.operators.orderstat import exact_medians
from aerocal.session import materialise

#: Splits whose shares of the explained error agree to so many digits tie.
TIE_DIGITS = 9
#: Deeper trees would hold too many nodes in one expression; use a forest for them.
DEEPEST = 10


@dataclass(frozen=True)
class TreeNode:
    """Node ``node`` (children 2 * node and 2 * node + 1) of ``n`` rows with mean label ``value``.

    ``feature`` is null in a leaf. Rows up to ``threshold`` go to the first child. ``share`` is the part
    of the node's squared error that the split explains.
    """

    node: int
    n: int
    value: float
    feature: str | None = None
    threshold: float | None = None
    share: float | None = None


def fill_medians(rows: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with missing features replaced by the exact medians of ``train``."""
    medians = exact_medians(train, features).first()
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in features})


def fit_tree(
    train: DataFrame, features: Sequence[str], label: str, depth: int = 2, min_leaf: int = 1
) -> list[TreeNode]:
    """Nodes of the tree, in order of their number; none if no row can be learned from.

    Rows with a null label or feature take no part. A split halves the gap between two values that
    occur, leaves ``min_leaf`` rows or more on both sides and explains the largest share of its
    node's squared error; ties go to the first feature, then to the smallest value.
    """
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"depth must lie between 0 and {DEEPEST}")
    if min_leaf < 1:
        raise ValueError("a leaf holds one row or more")
    features = list(features)
    used = train.where(all_present([*features, label])).select(
        *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(label)
    )
    mean = used.agg(F.avg(label)).first()[0]
    if mean is None:
        return []
    rows = used.select(*features, (F.col(label) - F.lit(mean)).alias("_y"))
    nodes: dict[int, TreeNode] = {}
    floor = None
    for level in range(depth + 1):
        placed = rows.withColumn("_node", node_of(list(nodes.values())))
        y = F.col("_y")
        totals = (
            placed.where(F.col("_node") >= 2**level)
            .groupBy("_node")
            .agg(F.count(y).alias("_n"), F.sum(y).alias("_s"), (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)).alias("_sse"))
            .collect()  # at most 2 ** level rows
        )
        floor = max(t["_sse"] for t in totals) * 1e-12 if floor is None else floor
        nodes |= {t["_node"]: TreeNode(t["_node"], t["_n"], mean + t["_s"] / t["_n"]) for t in totals}
        wide = [t for t in totals if t["_sse"] > floor and t["_n"] >= 2 * min_leaf]
        if level == depth or not wide:
            break
        found = _best_splits(placed, features, wide, min_leaf)
        for split in found:
            old = nodes[split["_node"]]
            nodes[old.node] = TreeNode(
                old.node, old.n, old.value, features[split["_feature"]], split["threshold"], split["share"]
            )
        if not found:
            break
    return [nodes[k] for k in sorted(nodes)]


def _best_splits(placed: DataFrame, features: list[str], totals: list, min_leaf: int) -> list:
    """(_node, _feature, threshold, share) of the best split of each node of ``totals`` that has one."""
    pairs = [F.struct(F.lit(i).alias("_feature"), F.col(c).alias("_value")) for i, c in enumerate(features)]
    key, of = ["_node", "_feature"], placed.sparkSession
    sums = materialise(
        placed.where(F.col("_node").isin([t["_node"] for t in totals]))
        .select("_node", "_y", F.inline(F.array(*pairs)))
        .groupBy(*key, "_value")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s")),
        "sums",
    )
    ranged = materialise(
        sums.repartitionByRange(*key, "_value").sortWithinPartitions(*key, "_value")
        .withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    so_far = W.partitionBy("_part", *key).orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    # one row per partition of a feature, at most as many as there are partitions
    earlier = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part", *key)
        .agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
        .select(
            "_part", *key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
            F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"),
        )
    )
    whole = of.createDataFrame(
        [(t["_node"], t["_n"], t["_s"], t["_sse"]) for t in totals], "_node long, _all long, _sum double, _sse double"
    )  # at most 2 ** depth rows
    left = (
        ranged.withColumns({"_run_n": F.sum("_n").over(so_far), "_run_s": F.sum("_s").over(so_far)})
        .join(offsets, ["_part", *key])
        .join(F.broadcast(whole), "_node")
        .select(
            *key, "_value", "_all", "_sum", "_sse",
            (F.col("_n0") + F.col("_run_n")).alias("_nl"), (F.col("_s0") + F.col("_run_s")).alias("_sl"),
        )
        .where((F.col("_nl") >= min_leaf) & (F.col("_all") - F.col("_nl") >= min_leaf))
    )
    other = F.col("_sum") - F.col("_sl")
    gain = (
        F.col("_sl") * F.col("_sl") / F.col("_nl") + other * other / (F.col("_all") - F.col("_nl"))
        - F.col("_sum") * F.col("_sum") / F.col("_all")
    )
    best = (
        left.withColumn("share", F.round(gain / F.col("_sse"), TIE_DIGITS))
        .where("share > 0")
        .groupBy("_node")
        .agg(F.max(F.struct("share", (-F.col("_feature")).alias("f"), (-F.col("_value")).alias("v"))).alias("_top"))
        .select("_node", (-F.col("_top.f")).alias("_feature"), (-F.col("_top.v")).alias("_low"), "_top.share")
        .collect()  # at most one row per node
    )
    if not best:
        return []
    chosen = of.createDataFrame(
        [tuple(b) for b in best], "_node long, _feature int, _low double, share double"
    )
    middle = (F.col("_low") + F.col("_high")) / 2
    return (
        sums.join(F.broadcast(chosen), key)
        .where("_value > _low")
        .groupBy(*key, "_low", "share")
        .agg(F.min("_value").alias("_high"))
        .select(*key, F.when(middle < F.col("_high"), middle).otherwise(F.col("_low")).alias("threshold"), "share")
        .collect()
    )


def _nested(nodes: list[TreeNode], end, empty: Column) -> Column:
    """The tree as one expression; ``end`` gives the column of a node without a split."""
    held = {n.node: n for n in nodes}

    def at(k: int) -> Column:
        node = held.get(k)
        if node is None or node.feature is None:
            return end(k, node)
        return F.when(F.col(node.feature) <= F.lit(node.threshold), at(2 * k)).otherwise(at(2 * k + 1))

    return at(1) if held else empty


def node_of(nodes: list[TreeNode]) -> Column:
    """The number of the deepest node a row reaches."""
    return _nested(nodes, lambda k, node: F.lit(k).cast("long"), F.lit(1).cast("long"))


def tree_value(nodes: list[TreeNode]) -> Column:
    """The tree's prediction, null where a feature it asks for is null."""
    asked = sorted({n.feature for n in nodes if n.feature})
    value = _nested(nodes, lambda k, node: F.lit(node.value), F.lit(None).cast("double"))
    return masked(all_present(asked), value) if asked else value

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.session import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    return tuple(row)  # two numbers


def connected(edges: DataFrame, files: int) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Minima combine map-side and joins are on one node column, so a node with very many edges is a
    skewed join key and never a group in one task. Every step is written to the shared folder, as
    ``files`` files at most.
    """
    now = materialise(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct().coalesce(files),
        "edges",
    )
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            now.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("hub"), F.least("u", "m").alias("m")
        )
        large = both.where("v > u").join(least, F.col("u") == F.col("hub")).select(
            F.col("v").alias("high"), F.col("m").alias("low")
        )
        large = materialise(large.distinct().coalesce(files), "large")
        lowest = large.groupBy("high").agg(F.min("low").alias("m")).withColumnRenamed("high", "hub")
        hung = large.join(lowest, F.col("high") == F.col("hub")).select("low", "m")
        small = hung.where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        now = materialise(
            small.unionByName(lowest.select(F.col("hub").alias("high"), F.col("m").alias("low")))
            .distinct().coalesce(files),
            "edges",
        )
    roots = now.select(F.col("low").alias("node")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )

"""Exact trees on the labels and on the residuals, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.catalog.frames import BASELINE_SQL, SPEC, SPLIT_SQL, daily
from aerocal.catalog.registry import query, r, rs
from aerocal.config import SplitSpec
from aerocal.operators.evaluate import model_metrics
from aerocal.operators.models import labelled_splits
from aerocal.operators.tree import fill_medians, fit_tree, tree_value
from aerocal.plans.residual import BASELINE, RESIDUAL, prepare_residual
from aerocal.session import materialise

DEPTH, MIN_LEAF = 2, 2
_FILLED = ("fo3", "ft", "fh")


def _tree_sql(y: str, columns: tuple[str, ...], source: str) -> str:
    """The levels of a tree on ``y``; t0 .. tDEPTH have the rows of ``source`` with their node."""
    parts = [
        f"""t0 AS (
  SELECT *, 1 AS node, {y} - (SELECT avg({y}) FROM {source} WHERE split = 'train') AS yc FROM {source}
)"""
    ]
    value = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(columns))
    for d in range(DEPTH):
        long = " UNION ALL ".join(
            f"SELECT node, {i} AS f, {c} AS v, yc FROM t{d} WHERE split = 'train'" for i, c in enumerate(columns)
        )
        parts.append(f"""
c{d} AS (SELECT node, f, v, count(*) AS n, sum(yc) AS s FROM ({long}) GROUP BY 1, 2, 3),
a{d} AS (
  SELECT node, count(*) AS n, sum(yc) AS s, sum(yc * yc) - sum(yc) * sum(yc) / count(*) AS sse
  FROM t{d} WHERE split = 'train' GROUP BY 1
),
r{d} AS (
  SELECT node, f, v, CAST(sum(n) OVER w AS BIGINT) AS nl, sum(s) OVER w AS sl,
    lead(v) OVER (PARTITION BY node, f ORDER BY v) AS nx
  FROM c{d} WINDOW w AS (PARTITION BY node, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
g{d} AS (
  SELECT r.node, f, v, nx,
    round((sl * sl / nl + (a.s - sl) * (a.s - sl) / (a.n - nl) - a.s * a.s / a.n) / a.sse, 9) AS share
  FROM r{d} r JOIN a{d} a ON a.node = r.node WHERE nl >= {MIN_LEAF} AND a.n - nl >= {MIN_LEAF} AND a.sse > 0
),
b{d} AS (
  SELECT node, f, (v + nx) / 2 AS threshold, share FROM g{d} WHERE share > 0
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY share DESC, f, v) = 1
),
t{d + 1} AS (
  SELECT t.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN t.node
    WHEN CASE f {value} END <= threshold THEN 2 * t.node ELSE 2 * t.node + 1 END AS node
  FROM t{d} t LEFT JOIN b{d} b ON b.node = t.node
)""")
    parts.append(f"""
leaves AS (SELECT node, avg({y}) AS pred FROM t{DEPTH} WHERE split = 'train' GROUP BY 1),
scored AS (SELECT t.*, pred FROM t{DEPTH} t JOIN leaves l ON l.node = t.node)""")
    return ",\n".join(parts)


def _metrics_sql(pred: str) -> str:
    return f"""SELECT split, 'tree' AS model, {rs(f"1 - sum(pow(y - ({pred}), 2)) / (var_pop(y) * count(y))")} AS r2,
  {rs(f"sqrt(avg(pow(y - ({pred}), 2)))")} AS rmse, {rs(f"avg(abs(y - ({pred})))")} AS mae, count(*) AS n
FROM scored GROUP BY 1"""


def _nodes_sql(columns: tuple[str, ...], y: str) -> str:
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(columns))
    # a node that is not split keeps its number on the next level, so the first level that has it counts
    levels = " UNION ALL ".join(
        f"SELECT {d} AS level, node, count(*) AS n, avg({y}) AS value FROM t{d} WHERE split = 'train' GROUP BY 2"
        for d in range(DEPTH + 1)
    )
    splits = " UNION ALL ".join(f"SELECT * FROM b{d}" for d in range(DEPTH))
    return f"""SELECT l.node, l.n, {rs("l.value")} AS value, CASE f {names} END AS feature,
  {rs("threshold")} AS threshold, {rs("share")} AS share
FROM (SELECT * FROM ({levels}) QUALIFY row_number() OVER (PARTITION BY node ORDER BY level) = 1) l
LEFT JOIN ({splits}) s ON s.node = l.node"""


def _metrics(scored: DataFrame) -> DataFrame:
    out = model_metrics(scored, SPEC.label, {"tree": "pred"}, by=["split"])
    return out.select("split", "model", *[r(c).alias(c) for c in ("r2", "rmse", "mae")], "n")


def _labelled(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Labelled rows without gaps in the features, and the train rows among them."""
    rows = materialise(labelled_splits(daily(spark, sf), SPEC, SplitSpec()), "splits")
    rows = fill_medians(rows, rows.where("split = 'train'"), SPEC.features)
    return rows, rows.where("split = 'train'")


def _residuals(spark, sf) -> tuple[DataFrame, DataFrame]:
    _, rows = prepare_residual(daily(spark, sf), SPEC)
    rows = fill_medians(rows, rows.where("split = 'train'"), SPEC.features)
    return rows, rows.where("split = 'train'")


_DIRECT = f"{SPLIT_SQL},\n{_tree_sql('y', _FILLED, 'filled')}"
_ON_RESIDUAL = f"""{BASELINE_SQL},
residuals AS (SELECT *, y - yb AS e FROM based),
{_tree_sql("e", (*_FILLED, "yb"), "residuals")}"""


@query(f"WITH {_DIRECT}\n{_metrics_sql('pred')}")
def tree_direct(spark, sf):
    """Metrics of an exact tree on the features."""
    rows, train = _labelled(spark, sf)
    tree = fit_tree(train, SPEC.features, SPEC.label, DEPTH, MIN_LEAF)
    return _metrics(rows.withColumn("pred", tree_value(tree)))


@query(f"WITH {_ON_RESIDUAL}\n{_metrics_sql('yb + pred')}")
def tree_residual(spark, sf):
    """Metrics of baseline plus an exact tree on what it leaves."""
    rows, train = _residuals(spark, sf)
    tree = fit_tree(train, [*SPEC.features, BASELINE], RESIDUAL, DEPTH, MIN_LEAF)
    return _metrics(rows.withColumn("pred", F.col(BASELINE) + tree_value(tree)))


@query(f"WITH {_ON_RESIDUAL}\n{_nodes_sql((*SPEC.features, BASELINE), 'e')}")
def tree_nodes(spark, sf):
    """The nodes of the residual tree: rows, mean, split and the share of the error it explains."""
    _, train = _residuals(spark, sf)
    tree = fit_tree(train, [*SPEC.features, BASELINE], RESIDUAL, DEPTH, MIN_LEAF)
    nodes = spark.createDataFrame(
        [(n.node, n.n, n.value, n.feature, n.threshold, n.share) for n in tree],
        "node int, n long, value double, feature string, threshold double, share double",
    )
    return nodes.select(
        "node", "n", r("value").alias("value"), "feature", r("threshold").alias("threshold"), r("share").alias("share")
    )

"""Exact splits against a search over every cut of every node."""

import random

import pytest
from pyspark.sql import functions as F

from aerocal.operators.tree import fill_medians, fit_tree, node_of, tree_value

KINDS = "a double, b double, y double"


def brute(rows, features, depth, min_leaf, node=1):
    """{node: (n, mean, feature, threshold)} by trying every cut."""
    ys = [r["y"] for r in rows]
    mean = sum(ys) / len(ys)
    sse = sum((y - mean) ** 2 for y in ys)
    best = None
    for i, c in enumerate(features if depth and sse > 1e-9 else ()):
        values = sorted({r[c] for r in rows})
        for low, high in zip(values, values[1:]):
            left, right = [r["y"] for r in rows if r[c] <= low], [r["y"] for r in rows if r[c] > low]
            if min(len(left), len(right)) < min_leaf:
                continue
            rest = sum(sum((y - sum(p) / len(p)) ** 2 for y in p) for p in (left, right))
            share = round((sse - rest) / sse, 9)
            if share > 0 and (best is None or share > best[0]):
                best = share, c, (low + high) / 2
    out = {node: (len(rows), mean, best and best[1], best and best[2])}
    if best:
        _, c, cut = best
        out |= brute([r for r in rows if r[c] <= cut], features, depth - 1, min_leaf, 2 * node)
        out |= brute([r for r in rows if r[c] > cut], features, depth - 1, min_leaf, 2 * node + 1)
    return out


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a = 7.0 if rng.random() < 0.4 else rng.gauss(0, 5)  # one value holds many rows
        b = float(rng.randint(0, 6))
        rows.append({"a": a, "b": b, "y": (3 if a > 1 else 0) + (b if a > 1 else -2 * b) + rng.gauss(1000, 0.5)})
    return rows


@pytest.mark.parametrize("depth,min_leaf", [(3, 1), (2, 40)])
def test_equals_a_search_over_all_cuts(spark, depth, min_leaf):
    rows = sample(250, depth)
    extra = [{"a": None, "b": 1.0, "y": 5.0}, {"a": 1.0, "b": 1.0, "y": None}]
    df = spark.createDataFrame(rows + extra, KINDS).repartition(5)
    got = fit_tree(df, ["a", "b"], "y", depth, min_leaf)
    want = brute(rows, ["a", "b"], depth, min_leaf)
    assert [n.node for n in got] == sorted(want)
    for n in got:
        size, mean, feature, cut = want[n.node]
        assert (n.n, n.feature) == (size, feature)
        assert n.value == pytest.approx(mean, rel=1e-12)
        assert cut is None or n.threshold == pytest.approx(cut, rel=1e-12)
    scored = df.select("a", "y", node_of(got).alias("node"), tree_value(got).alias("value")).collect()
    assert sum(r["value"] is None for r in scored) == 1
    leaves = {n.node: n for n in got if n.feature is None}
    kept = [r for r in scored if r["a"] is not None and r["y"] is not None]
    assert {k: sum(r["node"] == k for r in kept) for k in leaves} == {k: n.n for k, n in leaves.items()}


def test_edges(spark):
    empty = spark.createDataFrame([], KINDS)
    assert fit_tree(empty, ["a"], "y") == []
    assert empty.select(tree_value([])).count() == 0
    flat = spark.createDataFrame([(1.0, 2.0, 4.0), (3.0, 2.0, 4.0)], KINDS)
    (root,) = fit_tree(flat, ["a", "b"], "y")
    assert (root.n, root.value, root.feature) == (2, 4.0, None)
    # both features cut the rows alike: the first wins
    tie = spark.createDataFrame([(1.0, 1.0, 0.0), (2.0, 2.0, 1.0), (1.0, 1.0, 0.0)], KINDS)
    assert [(n.feature, n.threshold, n.value) for n in fit_tree(tie, ["b", "a"], "y")] == [
        ("b", 1.5, pytest.approx(1 / 3)), (None, None, 0.0), (None, None, 1.0)
    ]
    for depth, leaf in ((11, 1), (2, 0)):
        with pytest.raises(ValueError):
            fit_tree(tie, ["a"], "y", depth, leaf)


def test_medians_fill_the_gaps(spark):
    df = spark.createDataFrame([(1.0, None, 0.0), (None, 4.0, 0.0), (3.0, 8.0, 0.0)], KINDS)
    got = fill_medians(df, df.where(F.col("b") > 0), ["a", "b"]).orderBy("a", "b").collect()
    assert [(r.a, r.b) for r in got] == [(1.0, 6.0), (3.0, 4.0), (3.0, 8.0)]

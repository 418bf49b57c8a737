"""Near duplicates: one id with several texts, sketches, and large groups without links."""

import os
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerocal.llm.jaccard_join import SKETCH, near_duplicates, sketch


def test_one_id_with_different_texts(spark):
    a = " ".join(f"a{i}" for i in range(70))
    b = " ".join(f"b{i}" for i in range(62))
    rows = [(1, a), (1, b), (2, a), (3, b + " more"), (4, "alone"), (1, a), (None, a)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == sorted(
        [(1, 68, 1), (1, 60, 1), (2, 68, 1), (3, 61, 1), (4, 1, 4), (1, 68, 1), (0, 68, 0)]
    )


def test_shared_passage_and_many_near_copies(spark):
    """A passage in most documents that links none of them, beside a large group of near-copies."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 50))) + " " + passage) for i in range(250)]
    base = [f"c{i}" for i in range(120)]
    for i in range(250, 400):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for x in sets:
        for y in range(x):
            both = len(sets[x] & sets[y])
            if 100 * both >= 90 * (len(sets[x]) + len(sets[y]) - both):
                p, q = root(x), root(y)
                low[max(p, q)] = min(p, q)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, 3, 90, 100).collect()}
    assert got == {i: root(i) for i in sets}
    assert len(set(got.values())) < 400


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 200), st.integers(0, 60))
def test_sketches_never_differ_more_than_their_sets(seed, common, own):
    rng = np.random.default_rng(seed)
    items = rng.integers(-(2**63), 2**63 - 1, common + 2 * own)
    a, b = items[: common + own], np.concatenate([items[:common], items[common + own :]])
    differ = sum(int(x).bit_count() for x in (sketch(a) ^ sketch(b)).view(np.uint64))
    assert len(sketch(a)) == SKETCH
    assert differ <= 2 * own
    assert differ % 2 == 0


def test_digests_are_numbers_and_rounds_stay_within_files(spark):
    """Tokens of the same groups are held once, and no step writes more files than its rows call for."""
    rng = random.Random(4)
    base = [[f"t{k}-{i}" for i in range(60)] for k in range(40)]
    rows = []
    for i in range(400):
        copy = list(base[i % 40])
        copy[0 if i % 3 else -1] = f"own{i}"
        rows.append((i, " ".join(copy)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    folder = spark.conf.get("spark.checkpoint.dir")
    old = set(os.listdir(folder))
    try:
        got = {r.doc_id: r.component_id for r in near_duplicates(df, 3, 90, 100).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: i % 40 for i in range(400)}
    written = [f"{folder}/{d}" for d in sorted(set(os.listdir(folder)) - old)]
    signatures = next(d for d in written if "/signatures-" in d)
    rows = spark.read.parquet(signatures)
    assert dict(rows.dtypes)["digest"] == "bigint"
    buckets = spark.read.parquet(next(d for d in written if "/buckets-" in d))
    held = buckets.groupBy("token").agg(F.sort_array(F.collect_list("grp")).alias("held")).select("held")
    assert held.distinct().count() == held.count() > 0
    assert all(sum(f.endswith(".parquet") for f in os.listdir(d)) <= 24 for d in written)

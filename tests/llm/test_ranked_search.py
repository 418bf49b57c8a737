"""Ranked search against brute force over all documents."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from aerocal.llm import queries as corpus
from aerocal.llm.ranked_search import Search, block_of, build_index, search, terms_of, weight

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, m long, terms string, score string"


def terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text)


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    found = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 100 - 75 + 75 * bag.total() * n_docs // length
            s = 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) if bag[t] else 0
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        found += [(item, n + 1, d[3], -d[0]) for n, d in enumerate(sorted(scores)[:k])]
    return found


def corpus_rows(seed=1, size=400):
    rng = random.Random(seed)
    words = [f"w{int(300 * rng.random() ** 3)}" for _ in range(3000)]
    texts = [None, "", " .,! ", "Été ÉTÉ été", "A a-A_a", "É", "日本 日本", "w1 " * 20_000, "w2", "w2", "w2"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice([3, 3, 3, 5, 8, 40, 200]))) for _ in range(size)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (21, "w1 w2 w250 other text of one id"), (None, "w1 w2 w7"), (None, None)]
    items = [
        (1, "w1 w2 w2 w2"), (2, "É a A w250"), (3, None), (4, ""), (5, "?!"), (6, "never heard"), (7, texts[30]),
        (7, "w2"), (None, "w3"), (8, "w1 " * 50 + "w299"), (8, "w1 " * 50 + "w299"), (9, "ÉTÉ été 日本"), (10, "w2"),
    ]
    return rows, items


@pytest.fixture(scope="module")
def tables(spark):
    rows, items = corpus_rows()
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, row_id int").repartition(3)
    return rows, items, docs, asked


@pytest.mark.parametrize(
    ("chunk_docs", "chunk_postings", "block"), [(2048, 400_000, 512), (7, 400_000, 4), (1, 1, 1), (50, 300, 5)]
)
def test_search_against_all_documents(tables, chunk_docs, chunk_postings, block):
    rows, items, docs, asked = tables
    got = search(asked, build_index(docs, chunk_docs=chunk_docs, chunk_postings=chunk_postings), block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute(rows, items))


def test_fewer_and_more_results(tables):
    rows, items, docs, asked = tables
    index = build_index(docs)
    for k in (1, 3, 100_000):
        assert Counter(tuple(r) for r in search(asked, index, k).collect()) == Counter(brute(rows, items, k))


def test_empty_tables(tables):
    _, _, docs, asked = tables
    nothing = build_index(docs.limit(0))
    assert (nothing.n_docs, nothing.length) == (0, 0)
    assert search(asked, nothing).collect() == []
    assert search(asked.limit(0), build_index(docs)).collect() == []


def test_strata_hold_one_normaliser_and_every_document(tables):
    rows, _, docs, _ = tables
    index = build_index(docs, chunk_docs=10)
    chunks = index.chunks.collect()
    assert all(c.n_docs <= 10 for c in chunks)
    assert Counter(i for c in chunks for i in c.doc_ids) == Counter(i for i, t in rows if terms(t))
    size = dict((i, len(terms(t))) for i, t in rows if i not in (20, 21, None))
    for c in chunks:
        known = [size[i] for i in c.doc_ids if i in size]
        assert {25 + 75 * n * index.n_docs // index.length for n in known} <= {c.m}
        names = c.terms.split(" ")
        assert names == sorted(set(names))
        group, start, tf, largest, held = (
            np.frombuffer(c[x], "<i4").tolist() for x in ("term_group", "group_start", "group_tf", "largest", "held")
        )
        for t in range(len(names)):
            tfs = tf[group[t] : group[t + 1]]
            assert tfs == sorted(set(tfs), reverse=True) and tfs[0] == largest[t]
            assert held[t] == start[group[t + 1]] - start[group[t]]


def test_bounds_skip_chunks(tables):
    """With a score to beat, chunks are left out; the best documents stay the same."""
    rows, _, docs, _ = tables
    index = build_index(docs, chunk_docs=10)
    rng = random.Random(2)
    items = [(i, rows[rng.randrange(11, 400)][1]) for i in range(20)]
    batch = index.chunks.toArrow().combine_chunks().to_batches()[0]
    block = block_of([t for _, t in items])
    df = Counter(t for _, text in rows for t in set(terms(text)))
    weights = weight(np.array([df[t] for t in block.names]), index.n_docs)
    from aerocal.llm.ranked_search import _chunk

    state = Search(block, weights, 10, np.zeros(20, np.int64))
    bounds = [
        state.bounds(t.as_py(), np.frombuffer(x.as_py(), "<i4"), m)
        for t, x, m in zip(batch.column("terms"), batch.column("largest"), batch.column("m").to_pylist())
    ]
    order = np.argsort(-np.stack([b for b, _ in bounds]).max(1), kind="stable")
    for i in order.tolist():
        state.visit(_chunk(batch, i), *bounds[i])
    got = [(i, n + 1, d, s) for i, best in enumerate(state.best) for n, (s, d) in enumerate(best)]
    assert Counter(got) == Counter(brute(rows, items))
    assert state.visited < 0.9 * state.seen


def test_large_strata_are_split(spark):
    rows = [(i, f"same length of text {i % 7}") for i in range(500)] + [(1000, "another one"), (1001, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = build_index(docs)
    assert index.chunks.where("n_docs < 400").count() == index.chunks.count() > 8
    items = [(1, "text 3 another"), (2, "same")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in search(asked, index).collect()) == Counter(brute(rows, items))
    with pytest.raises(ValueError):
        build_index(docs, chunk_docs=1 << 17)


def test_terms():
    assert terms_of("Ab-cD_é1É\x7f\x80x 日") == ["ab", "cd", "é1É", "\x80x", "日"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_registered_query(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    want = con.execute(corpus.oracle_sql()["op11_ranked_search"]).fetchall()
    got = [tuple(r) for r in corpus.op11_ranked_search(spark, FOLDER).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(want) and want

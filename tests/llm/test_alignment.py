"""Token alignment against whole-text encoding and dense matrices."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerocal.llm.alignment import (
    Aligner, Tokenizers, align, aligned, byte_alphabet, pair_bound, segments, token_pairs,
)
from aerocal.llm.common import tokenizer_file
from aerocal.llm.csr import Csr, one_per_column, row_products

FOLDER = "/root/testdata/sf0.001"
A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "x\t  y \n", "don't 've 's", "<|endoftext|>", "<s> </s> <unk>",
    "<0x41>", "a▁b", "Äpfel   é", "\U0001f600 \U0001f600x", "日本語 テキスト", "12345 67,89", "\x00 \x1c \x1d x", "é ﬁ",
    "<|endoftext|> the <|endoftext|>", "a \x85 b", "zz" * 3000, "the cat sat on the mat " * 500, "the", "the",
]


@pytest.fixture(scope="module")
def tokenizers():
    return Tokenizers(tokenizer_file(A_NAME), tokenizer_file(B_NAME))


def whole(tokenizers, text):
    """Ids of both sides by one call each, or None where the joined bytes differ."""
    if not text:
        return None
    letters = byte_alphabet()
    names = tokenizers.a.encode(" " + text, add_special_tokens=False)
    a = b"".join(bytes(letters[c] for c in x) for x in names.tokens)
    ids = tokenizers.b.encode(text)
    b = b""
    for p in tokenizers.b.encode(text, out_type=str):
        b += bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" and p[-1] == ">" else p.replace("▁", " ").encode()
    return (names.ids, ids) if a == b == (" " + text).encode() else None


def brute(tokenizers, texts):
    """Rows of the query, from byte offsets of whole texts."""
    rows, links = [], []
    for text in texts:
        found = whole(tokenizers, text)
        if found is None:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        a, b = found
        a_end = np.cumsum([len(tokenizers.a_bytes[i]) for i in a]).tolist()
        b_end = np.cumsum([len(tokenizers.b_bytes[i]) for i in b]).tolist()
        cuts = sorted(set(a_end) & set(b_end))
        side = [[], []]
        for which, ids, ends in ((0, a, a_end), (1, b, b_end)):
            groups = defaultdict(list)
            for i, e in zip(ids, ends):
                groups[next(c for c in cuts if c >= e) if len(cuts) < 200 else cuts[np.searchsorted(cuts, e)]].append(str(i))
            side[which] = [",".join(groups[c]) for c in cuts]
        text = ";".join(f"{x}|{y}" for x, y in zip(*side))
        where = dict(zip(b_end, b))
        pairs = [(i, where[e]) for i, e in zip(a, a_end) if e in where]
        rows.append((len(a), len(b), len(cuts), len(pairs), hashlib.sha256(text.encode()).hexdigest()))
        links.append(pairs)
    counts = Counter(p for x in links for p in x)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [
        (*r[:4], sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), r[4]) for r, x in zip(rows, links)
    ], counts


def test_query_against_whole_texts(spark, tokenizers):
    rng = random.Random(3)
    words = ["the", "of", "Ärger", "naïve", "x1", "foo-bar", "\n", "...", "日本"]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, "n", "m") for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "the of", "n", "m"), (5, "other text of one id", "n", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, pairs string").repartition(3)
    want, _ = brute(tokenizers, [r[1] for r in rows])
    got = align(docs)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == ["doc_id", *names]
    assert Counter(tuple(r) for r in got.collect()) == Counter((r[0], *w) for r, w in zip(rows, want))


def test_pair_counts_and_bound(spark, tokenizers):
    texts = ["the naïve cat", "foo-bar 12345", "the naïve"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, counts = brute(tokenizers, texts)
    got = {(r.a_id, r.b_id): r["count"] for r in token_pairs(docs, "end").collect()}
    assert got == dict(counts)
    for a, b in got:
        x, y = tokenizers.a_bytes[a], tokenizers.b_bytes[b]
        assert x.endswith(y) or y.endswith(x)
    assert len(got) <= pair_bound(A_NAME, B_NAME) < 1_000_000


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        token_pairs(spark.createDataFrame([], "doc_id long, text string"), "start")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_registered_query(spark, tokenizers):
    from aerocal.llm import queries as corpus

    rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    want, _ = brute(tokenizers, [r[1] for r in rows])
    got = corpus.op12_alignment(spark, FOLDER).collect()
    assert {tuple(r) for r in got} == {(r[0], *w) for r, w in zip(rows, want)}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab '\t\n \x1cé▁日1.<|>e"), max_size=30))
def test_segments_encode_like_the_whole(text):
    t = _shared()
    want = whole(t, text)
    parts = t.ids(segments(text)) if text else [None]
    assert "".join(segments(text)) == " " + text
    if want is None:
        assert None in parts
    else:
        assert ([i for p in parts for i in p[0]], [i for p in parts for i in p[1]]) == want


def _shared(held=[]):  # noqa: B006
    if not held:
        held.append(Tokenizers(tokenizer_file(A_NAME), tokenizer_file(B_NAME)))
    return held[0]


def test_pieces_never_join_a_space_behind_a_character(tokenizers):
    pieces = tokenizers.b.id_to_piece(list(range(tokenizers.b.get_piece_size())))
    assert not [p for p in pieces if "▁" in p.lstrip("▁")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.integers(0, 10_000))
def test_products_against_dense_matrices(sizes, seed):
    total = sum(sizes)
    rng = random.Random(seed)
    other, left = [], total
    while left:
        other.append(rng.randint(1, min(4, left)))
        left -= other[-1]
    both = aligned(np.array(sizes), np.array(other))

    def dense(sizes):
        m = np.zeros((len(sizes), total), int)
        at = 0
        for i, n in enumerate(sizes):
            m[i, at : at + n] = 1
            at += n
        return m

    product = dense(sizes) @ dense(other).T
    rows, cols, values = both.overlap()
    assert (rows.tolist(), cols.tolist()) == tuple(x.tolist() for x in np.nonzero(product))
    assert values.tolist() == product[np.nonzero(product)].tolist()
    a_ends, b_ends = np.cumsum(sizes), np.cumsum(other)
    assert set(zip(*map(np.ndarray.tolist, both.end()))) == {
        (i, j) for i, x in enumerate(a_ends) for j, y in enumerate(b_ends) if x == y
    }
    assert set(zip(*map(np.ndarray.tolist, both.group()))) == {
        (i, j) for i in range(len(sizes)) for j in range(len(other)) if both.a_group[i] == both.b_group[j]
    }


def test_row_products_in_blocks():
    rng = np.random.default_rng(0)
    a, b = (rng.random((20, 30)) < 0.2).astype(int), (rng.random((30, 15)) < 0.2).astype(int)

    def csr(m):
        return Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])

    for step in (1, 7, 1000):
        rows, cols, values = row_products(csr(a), csr(b), step)
        found = np.zeros((20, 15), int)
        found[rows, cols] = values
        assert (found == a @ b).all()
    assert one_per_column(np.zeros(0, int)).height == 0


def test_table_of_segments_is_bounded(tokenizers):
    aligner = Aligner(tokenizers, "end", held=5)
    texts = [f"word{i} the" for i in range(30)]
    one = [aligner.documents([t])["digest"][0] for t in texts]
    assert one == Aligner(tokenizers, "end").documents(texts)["digest"]
    assert len(aligner.number) <= 8

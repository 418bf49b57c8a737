"""Corpus operators against brute force, round trips and edge cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from aerocal.llm import queries as corpus
from aerocal.llm.chunk_dedup import chunk_ends, drop_repeated_chunks
from aerocal.llm.common import tokenizer_file
from aerocal.llm.exact_dedup import drop_copies, exact_groups
from aerocal.llm.jaccard_join import keep_one_each, near_duplicates
from aerocal.llm.knn_join import integer_vectors, top_k
from aerocal.llm.language_id import identify_languages
from aerocal.llm.mixing import mix, sample_mixture
from aerocal.llm.packing import pack_documents
from aerocal.llm.repeats import drop_repeats
from aerocal.llm.simple8b import decode, encode
from aerocal.llm.token_files import ids_crc32, read_token_files, write_token_files
from aerocal.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity
from aerocal.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, N string, digest string, text_key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
given_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


def corpus_texts():
    """Nulls, empty texts, copies, near-copies, shared passages, one long text, non-ASCII text."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    base = " ".join(rng.choice(words) for _ in range(120))
    texts = [None, "", "  \t ", "One", "one", "two words", "Äpfel äpfel", "ab " * 300, base, base.upper()]
    for i in range(30):  # near-copies: a few words differ
        parts = base.split()
        parts[3 * i % 120] = f"x{i % 7}"
        texts.append(" ".join(parts))
    for i in range(20):  # a passage in otherwise different texts
        texts.append(" ".join([*(rng.choice(words) for _ in range(20 + i)), passage, rng.choice(words)]))
    texts.append(" ".join(rng.choice(words) for _ in range(30_000)))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if i % 2 else None, "hot" if i % 3 else None, "x", "y", "z") for i, t in enumerate(corpus_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark, docs):
    """The documents with a null id and rows that are repeated whole."""
    again = docs.where("doc_id in (8, 12)")
    return docs.unionByName(again).unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_sets(texts, size):
    found = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        found[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return found


def components(sets, num, den):
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, size, num):
    sets = shingle_sets(dict(enumerate(corpus_texts())), size)
    want = {i: (len(sets[i]), c) for i, c in components(sets, num, 100).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, size, num, 100).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_jaccard_keeps_one_of_each(odd):
    sets = shingle_sets(dict(enumerate(corpus_texts())), 5)
    low = components(sets, 80, 100)
    stay = Counter({i: 1 for i in low if low[i] == i})
    stay[8] += 1  # a repeated row stays with the one that stays
    stay[None] = 1
    kept = keep_one_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == stay


def test_exact_groups(docs):
    groups = {}
    for i, t in enumerate(corpus_texts()):
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    want = {}
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        want |= {i: (max(ids), len(ids), i == max(ids), sha) for i in ids}
    got = {r.doc_id: tuple(r)[1:] for r in exact_groups(docs).collect()}
    assert got == want
    few = {r.doc_id: tuple(r)[1:] for r in exact_groups(docs, counters=1).collect()}
    assert few == want


def test_exact_dedup_keeps_one_row_of_each_text(odd):
    kept = drop_copies(odd)
    assert kept.columns == odd.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOWER) for t in corpus_texts()})


def removed_by_hand(texts, length):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            window = b[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return want


@pytest.mark.parametrize(("counters", "bucket"), [(1000, 2000), (3, 2)])
def test_repeats(docs, counters, bucket):
    """The second case sends most hashes down the way of very frequent ones."""
    want = removed_by_hand(corpus_texts(), 100)
    found = drop_repeats(docs, 100, with_kept=False, counters=counters, bucket=bucket)
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == want
    assert sum(w[1] for w in want.values()) > 5_000


def test_chunks(docs):
    seen, want = set(), {}
    for i, t in enumerate(corpus_texts()):
        b, start, kept = (t or "").encode(), 0, b""
        for end in chunk_ends(b) if b else []:
            if b[start:end] not in seen:
                kept += b[start:end]
            seen.add(b[start:end])
            start = end
        want[i] = (len(b), len(b) - len(kept), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in drop_repeated_chunks(docs).collect()}
    assert got == want


def test_chunk_borders_resist_shifts():
    text = random.Random(1).randbytes(20_000)
    moved = text[:5_000] + b"inserted" + text[5_000:]

    def pieces(b):
        ends = chunk_ends(b)
        return [bytes(b[a:e]) for a, e in zip([0, *ends], ends)]

    assert b"".join(pieces(moved)) == moved
    assert len(set(pieces(text)) - set(pieces(moved))) < 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**20), st.integers(0, 2**64 - 1)), max_size=600))
def test_simple8b_round_trip(values):
    array = np.array(values, np.uint64)
    words, offsets = encode(array)
    assert decode(words, offsets, len(array)).tolist() == values


def tokens_by_hand(end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in corpus_texts()]


def test_token_files(spark, docs):
    path = scratch_path(spark, "test-tokens")
    write_token_files(docs, path, per_row=500)
    ids = tokens_by_hand(2)
    got = sorted(tuple(r) for r in read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids").collect())
    start = np.cumsum([0, *map(len, ids)]).tolist()
    assert got == [(i, start[i], len(x), x) for i, x in enumerate(ids)]
    crc = {r.doc_id: r.crc for r in read_token_files(spark, path, ids_crc32, "long", "crc").collect()}
    assert crc == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in enumerate(ids)}


def test_packing(docs):
    ids, rows = tokens_by_hand(1), pack_documents(docs, capacity=4096).collect()
    found = {(r.doc_id, r.piece): r for r in rows}
    want = {(i, k) for i, x in enumerate(ids) for k in range(-(-len(x) // 4096))}
    assert set(found) == want and len(rows) == len(want)
    sequences = {}
    for (i, k), r in found.items():
        piece = ids[i][k * 4096 : (k + 1) * 4096]
        assert (r.start, r.length, r.ids_crc32) == (k * 4096, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= -(-sum(map(len, ids)) // 4096) + 1


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(300, 8)), 1))]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (320, rows[0][1]), (340, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(integer_vectors(table), F.col("vec_id") % 20 == 0)
                 .select("query_id", "rank", "vec_id", "score").collect())
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_mixture_reaches_targets(spark, odd):
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.probability <= 1 for r in rows)
    assert all(not r.drawn for r in rows if r.topic == "empty")
    goal = spark.createDataFrame([("hot", 0.75), ("unknown", 0.25)], "value string, target double")
    weighed = Counter()
    short = odd.where("doc_id < 60")  # the one long text would hold most of its topic's target by itself
    for r in mix(short, targets={"source": goal}, sweeps=30).collect():
        weighed[r.source] += r.multiplier * r.tokens
    assert weighed["hot"] / sum(weighed.values()) == pytest.approx(0.75, abs=0.02)
    assert sample_mixture(odd).columns == odd.columns


def test_language_edges(odd):
    rows = identify_languages(odd).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows} <= {"de", "und"}
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (0, 1, 2))


def test_toxicity_learns_and_restores(spark):
    rng = random.Random(2)
    words = ["house", "river", "garden", "window", "morning", "letter", "bridge", "number"]
    rows, marks = [], []
    for i in range(400):
        text = [rng.choice(words) + rng.choice(words) for _ in range(20)]
        if i % 4 == 0:
            text[5] = "blockhead"
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 4 == 0)))
    rows += [(400, "riverhouse b10ckh3ad gardenriver"), (401, "riverhouse b l o c k h e a d river"), (402, None), (403, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit_toxicity(docs, spark.createDataFrame(marks + [(None, 1), (7, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, model).collect()}
    assert {i for i, p in got.items() if p} == {i for i in range(0, 400, 4)} | {400, 401}
    assert drop_toxic(docs, model).count() == 302


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    path = scratch_path(spark, "test-none")
    write_token_files(nothing, path)
    model = fit_toxicity(nothing, labels)
    found = [
        mix(nothing), sample_mixture(nothing), identify_languages(nothing), exact_groups(nothing), drop_copies(nothing),
        read_token_files(spark, path), near_duplicates(nothing), keep_one_each(nothing), drop_repeats(nothing),
        score_toxicity(nothing, model), drop_toxic(nothing, model), drop_repeated_chunks(nothing), pack_documents(nothing),
        top_k(integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")), F.lit(True)),
    ]
    assert [f.count() for f in found] == [0] * len(found)


@given_tables
@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, found = corpus.queries()[name](spark, FOLDER), db.execute(corpus.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    assert sorted(df.columns) == columns
    want = sorted(repr([r[i] for i in at]) for r in found.fetchall())
    assert want and sorted(repr(list(r)) for r in df.select(*columns).collect()) == want


@given_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [set(docs.toPandas().doc_id)]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, now, FOLDER).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == docs.columns
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
    texts = [(r.text or "").translate(LOWER) for r in now.select("text").collect()]
    assert len(texts) == len(set(texts))
    sets = shingle_sets({r.doc_id: r.text for r in now.collect()}, 5)
    low = components(sets, 80, 100)
    assert all(low[i] == i for i in sets)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == sorted(tuple(r) for r in pack_documents(now).collect())
    assert {r[0] for r in got} == kept[-1]

"""Ranked lexical search over a length-stratified index.

Score of a document for a query: the sum, over the query's terms with repeats, of
w * ((10^9 * tf) div (1000 * tf + 8 * m)), with w the weight of the term, tf its occurrences in the
document and m the document's length normaliser. All but the logarithm in w is integer.

Documents with equal m form a stratum. Within a stratum the impact of a term depends on tf alone,
so postings are grouped by term and tf, and each impact is computed once per tf. A stratum is
stored as rows (chunks) of at most ``chunk_docs`` documents: the chunk's distinct terms, for each
term its groups (tf, documents) by descending tf, and the doc ids. The largest tf of each term bounds
the score of every document of a chunk. Chunks are visited by descending bound, and only while the
bound reaches the k-th best score known for the query; ties are visited, so the result is exact.

Plan: texts are read once into bags of words (written), dealt by stratum, sorted and packed into
chunks (written). A stratum with more than its share of the postings, such as one that holds a third
of all documents, is dealt out by a hash of the id as well; the list of these strata has at most
``_SHARES`` entries per shuffle partition. Document frequencies come from the chunks. A first visit takes only the best
chunk of each task for each query, which gives every query a score to beat; the second visit covers all
chunks against these scores. Queries are taken in blocks of at most ``block`` items, so what
travels to the tasks is bounded by the block, whatever the number of items or documents.

Defined cases: null and empty texts have no terms and are never returned. Items without terms, or
with null text, have no rows. Rows of documents that share an id are documents of their own; a null
doc_id sorts before others in ties. Items that are repeated or share an id are ranked each on their
own. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerocal.llm.common import id_text, strings
from aerocal.llm.csr import expand
from aerocal.session import materialise, scratch_path

#: Maximal runs of ASCII letters, digits and all characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
#: m is LEAST + (SHARE * n * N) div L; an impact is (SCALE * tf) div (TF_PART * tf + M_PART * m).
SHARE, LEAST, SCALE, TF_PART, M_PART = 75, 25, 1_000_000_000, 1000, 8

#: A bag holds its distinct terms in one string, parted by spaces, and their counts.
BAGS = "doc_id long, n long, size int, terms string, tfs binary"
#: Terms in ascending order, parted by spaces; the other lists are 32-bit integers, postings 16-bit.
CHUNKS = (
    "m long, n_docs int, terms string, largest binary, held binary, group_tf binary, group_start binary, "
    "term_group binary, postings binary, doc_ids array<long>"
)
#: Most documents of a chunk, whose places are 16-bit numbers.
MOST_DOCS = 1 << 16
#: A stratum is split when it holds more than 1 / (_SHARES * partitions) of all postings.
_SHARES = 4
FOUND = "item long, doc_id long, score long"


def terms_of(text: str) -> list[str]:
    """Terms in order; only A-Z are lower-cased."""
    return TERM.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


def normaliser(n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    return LEAST + SHARE * n * n_docs // max(1, length)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return SCALE * tf // (TF_PART * tf + M_PART * m)


def weight(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


@dataclass(frozen=True)
class Index:
    """Chunks of the strata, documents with a term, and all their terms."""

    chunks: DataFrame
    n_docs: int
    length: int


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            ids, n, size, terms, tfs = [], [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), strings(part.column(1))):
                bag = Counter(terms_of(text))
                if bag:
                    ids.append(doc_id)
                    n.append(bag.total())
                    size.append(len(bag))
                    terms.append(" ".join(bag))
                    tfs.append(np.array(list(bag.values()), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int32()),
                    pa.array(terms, pa.string()), pa.array(tfs, pa.binary()),
                ],
                ["doc_id", "n", "size", "terms", "tfs"],
            )


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_docs: int = 2048,
    chunk_postings: int = 400_000,
) -> Index:
    """Index of all documents; N and L are two numbers of one aggregate."""
    if chunk_docs > MOST_DOCS:
        raise ValueError(f"a chunk holds at most {MOST_DOCS} documents")
    bags = materialise(id_text(docs, id_col, text_col).mapInArrow(_bags, BAGS), "bags")
    total = bags.agg(
        F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("postings"),
    ).first()
    n_docs, length = total.docs, total.length
    m = F.lit(LEAST) + F.expr(f"({SHARE} * n * {n_docs}L) div {max(1, length)}L")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Open((0, 0))
        for batch in batches:
            for at in range(0, len(batch), 100):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 100).columns))
                for stratum, split, doc_id, size, terms, tfs in rows:
                    full = len(held.doc_ids) >= chunk_docs or held.size + size > chunk_postings
                    if held.doc_ids and (full or (stratum, split) != held.part):
                        yield held.chunk()
                        held = _Open((stratum, split))
                    held.part = (stratum, split)
                    held.add(doc_id, terms.split(" "), tfs)
        if held.doc_ids:
            yield held.chunk()

    sized = bags.withColumn("m", m)
    chunks = (
        sized.withColumn("split", _split(sized, total.postings))
        .repartition("m", "split")
        .sortWithinPartitions("m", "split")
        .select("m", "split", "doc_id", "size", "terms", "tfs")
        .mapInArrow(pack, CHUNKS)
    )
    path = scratch_path(docs.sparkSession, "strata")
    chunks.write.parquet(path)
    return Index(docs.sparkSession.read.schema(CHUNKS).parquet(path), n_docs, length)


def _split(bags: DataFrame, postings: int) -> Column:
    """Which part of its stratum a document goes to: 0, but for strata with many postings.

    Parts are as large as the share that makes a stratum a large one, so there are fewer than twice
    as many parts as shares.
    """
    shares = _SHARES * int(bags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = (
        bags.groupBy("m").agg(F.sum("size").alias("size")).where(F.col("size") * shares > postings).collect()
    )  # fewer than ``shares`` rows
    if not large:
        return F.lit(0)
    parts = F.create_map(*[F.lit(x) for row in large for x in (row.m, -(-row["size"] * shares // postings))])
    return F.pmod(F.xxhash64("doc_id", "terms"), F.coalesce(parts[F.col("m")], F.lit(1))).cast("int")


class _Open:
    """Documents of one stratum on their way into a chunk."""

    def __init__(self, part: tuple[int, int]) -> None:
        self.part, self.size = part, 0
        self.number: dict[str, int] = {}
        self.doc_ids: list[int | None] = []
        self.term: list[int] = []
        self.tfs: list[bytes] = []
        self.per_doc: list[int] = []

    def add(self, doc_id: int | None, terms: list[str], tfs: bytes) -> None:
        number = self.number
        self.doc_ids.append(doc_id)
        self.term += [number.setdefault(t, len(number)) for t in terms]
        self.tfs.append(tfs)
        self.per_doc.append(len(terms))
        self.size += len(terms)

    def chunk(self) -> pa.RecordBatch:
        names = sorted(self.number)
        place = np.empty(len(names), np.int64)
        place[[self.number[t] for t in names]] = np.arange(len(names))
        term, tf = place[np.array(self.term)], np.frombuffer(b"".join(self.tfs), "<i4")
        doc = np.repeat(np.arange(len(self.doc_ids)), self.per_doc)
        order = np.lexsort((doc, -tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
        first = np.searchsorted(term[new], np.arange(len(names) + 1))
        values = {
            "m": pa.array([self.part[0]], pa.int64()), "n_docs": pa.array([len(self.doc_ids)], pa.int32()),
            "terms": pa.array([" ".join(names)], pa.string()),
            "largest": _row(tf[new][first[:-1]]), "held": _row(np.bincount(term, minlength=len(names))),
            "group_tf": _row(tf[new]), "group_start": _row(np.append(new, len(term))), "term_group": _row(first),
            "postings": _row(doc, "<u2"), "doc_ids": pa.array([self.doc_ids], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_arrays(list(values.values()), list(values))


def _row(values: np.ndarray, kind: str = "<i4") -> pa.Array:
    return pa.array([values.astype(kind).tobytes()], pa.binary())


def _numbers(value: pa.Scalar, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


@dataclass(frozen=True)
class Items:
    """A block of queries: entries (item, term, repeats) with items ascending."""

    names: list[str]
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray
    size: int


def block_of(texts: list[str | None]) -> Items:
    names: dict[str, int] = {}
    entries = [
        (i, names.setdefault(t, len(names)), n)
        for i, text in enumerate(texts)
        for t, n in Counter(terms_of(text or "")).items()
    ]
    item, term, times = (np.array(x, np.int64) for x in (zip(*entries) if entries else ((), (), ())))
    return Items(list(names), item, term, times, len(texts))


def document_frequencies(index: Index, items: Items) -> np.ndarray:
    """Documents of the whole index that hold each term of the block."""
    wanted = {t: i for i, t in enumerate(items.names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, held in zip(batch.column(0), batch.column(1)):
                at, of = _places(terms.as_py(), wanted)
                found[of] += _numbers(held)[at]
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], ["term", "df"])

    rows = (
        index.chunks.select("terms", "held").mapInArrow(count, "term long, df long")
        .groupBy("term").agg(F.sum("df").alias("df")).collect()
    )  # at most one row per term of the block
    df = np.zeros(len(items.names), np.int64)
    for row in rows:
        df[row.term] = row.df
    return df


def _places(terms: str, wanted: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted terms stand in a chunk, and which they are."""
    both = [(i, wanted[t]) for i, t in enumerate(terms.split(" ")) if t in wanted]
    return tuple(np.array(x, np.int64) for x in zip(*both)) if both else (np.zeros(0, np.int64),) * 2


class Search:
    """Visits chunks for a block of queries, and keeps the ``k`` best of each."""

    def __init__(self, items: Items, weights: np.ndarray, k: int, beat: np.ndarray) -> None:
        self.items, self.k = items, k
        self.wanted = {t: i for i, t in enumerate(items.names)}
        self.gain = items.times * weights[items.term]
        #: Scores to reach; the task's own k-th best raises them.
        self.beat = beat.copy()
        self.best: list[list[tuple[int, int | None]]] = [[] for _ in range(items.size)]
        self.visited = self.seen = 0

    def bounds(self, terms: str, largest: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Bound of each query's scores in a chunk, and where its terms stand in it (-1: absent)."""
        at, of = _places(terms, self.wanted)
        place = np.full(len(self.wanted), -1)
        place[of] = at
        most = np.zeros(len(self.wanted), np.int64)
        most[of] = impact(largest[at].astype(np.int64), m)
        bound = np.zeros(self.items.size, np.int64)
        np.add.at(bound, self.items.item, self.gain * most[self.items.term])
        return bound, place

    def visit(self, chunk: dict, bound: np.ndarray, place: np.ndarray, only: np.ndarray | None = None) -> None:
        """Score the chunk's documents for the queries whose bound reaches the score to beat."""
        wanted = (bound > 0) & (bound >= self.beat)
        if only is not None:
            wanted &= only
        self.seen += int((bound > 0).sum())
        self.visited += int(wanted.sum())
        items = self.items
        entry = np.flatnonzero(wanted[items.item] & (place[items.term] >= 0))
        if not len(entry):
            return
        start, group = chunk["group_start"], chunk["term_group"]
        n_docs = chunk["n_docs"]
        size = np.diff(start)
        worth = np.repeat(impact(chunk["group_tf"].astype(np.int64), chunk["m"]), size)  # once per tf
        at = place[items.term[entry]]
        first, last = start[group[at]], start[group[at + 1]]
        of = items.item[entry]
        # blocks of whole queries with about a million postings each
        ends = np.cumsum(last - first)
        cuts = np.searchsorted(ends, np.arange(1_000_000, ends[-1], 1_000_000))
        cuts = np.unique(np.searchsorted(of, of[cuts]))
        for part in np.split(np.arange(len(entry)), cuts[cuts > 0]):
            rows, local = np.unique(of[part], return_inverse=True)
            count = last[part] - first[part]
            place_in = expand(first[part], count)
            cell = np.repeat(local * n_docs, count) + chunk["postings"][place_in]
            # sums below 2^53: weights are under 10^5 and an impact under 10^6
            total = np.bincount(
                cell, weights=np.repeat(self.gain[entry[part]], count) * worth[place_in], minlength=len(rows) * n_docs
            )
            self._keep(rows, total.reshape(len(rows), n_docs).astype(np.int64), chunk["doc_ids"])

    def _keep(self, rows: np.ndarray, scores: np.ndarray, doc_ids: list[int | None]) -> None:
        for i, line in zip(rows.tolist(), scores):
            good = np.flatnonzero((line > 0) & (line >= self.beat[i]))
            if len(good) > self.k:
                cut = np.partition(line[good], len(good) - self.k)[len(good) - self.k]
                good = good[line[good] >= cut]
            if not len(good):
                continue
            both = self.best[i] + [(int(line[d]), doc_ids[d]) for d in good.tolist()]
            both.sort(key=_order)
            self.best[i] = both[: self.k]
            if len(both) >= self.k:
                self.beat[i] = max(self.beat[i], both[self.k - 1][0])

    def found(self) -> pa.RecordBatch:
        rows = [(i, d, s) for i, best in enumerate(self.best) for s, d in best]
        item, doc_id, score = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())],
            ["item", "doc_id", "score"],
        )


def _order(found: tuple[int, int | None]) -> tuple:
    return -found[0], found[1] is not None, found[1] or 0


def _chunk(batch: pa.RecordBatch, i: int) -> dict:
    lists = {x: _numbers(batch.column(x)[i]) for x in ("group_tf", "group_start", "term_group")}
    lists["postings"] = _numbers(batch.column("postings")[i], "<u2")
    m, n_docs = batch.column("m")[i].as_py(), batch.column("n_docs")[i].as_py()
    return lists | {"m": m, "n_docs": n_docs, "doc_ids": batch.column("doc_ids")[i].as_py()}


def _visits(index: Index, items: Items, weights: np.ndarray, k: int, beat: np.ndarray, first: bool) -> DataFrame:
    """The ``k`` best of every task; ``first`` visits only the best chunk of each batch for each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Search(items, weights, k, beat)
        for batch in batches:
            bounds = [
                state.bounds(terms.as_py(), _numbers(largest), m)
                for terms, largest, m in zip(batch.column("terms"), batch.column("largest"), batch.column("m").to_pylist())
            ]
            if not bounds:
                continue
            table = np.stack([b for b, _ in bounds])
            top = table.argmax(0)
            for i in np.argsort(-table.max(1), kind="stable").tolist():
                only = top == i if first else None
                if first and not only.any():
                    continue
                state.visit(_chunk(batch, i), *bounds[i], only)
        yield state.found()

    return index.chunks.mapInArrow(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    items: DataFrame, index: Index, k: int = 10, id_col: str = "item_id", text_col: str = "text", block: int = 512
) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item."""
    spark = items.sparkSession
    keyed = materialise(
        id_text(items, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()), "items"
    )
    starts = _block_starts(keyed, block)
    results = []
    for low, high in zip(starts, [*starts[1:], None]):
        some = keyed.where(F.col("row_id") >= low)
        some = some.where(F.col("row_id") < high) if high is not None else some
        rows = sorted(some.collect(), key=lambda r: r.row_id)  # at most ``block`` items
        wanted = block_of([r.text for r in rows])
        weights = weight(document_frequencies(index, wanted), index.n_docs)
        beat = np.zeros(wanted.size, np.int64)
        seeds = _ranked(_visits(index, wanted, weights, k, beat, True), k).where(F.col("rank") == k)
        for row in seeds.collect():  # one score per item
            beat[row.item] = row.score
        ids = spark.createDataFrame([(i, r.doc_id) for i, r in enumerate(rows)], "item long, item_id long")
        best = _ranked(_visits(index, wanted, weights, k, beat, False), k)
        results.append(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    return found


def _block_starts(keyed: DataFrame, step: int) -> list[int]:
    """Each ``step``-th row id, from the counts of the partitions that made the ids."""
    part = F.shiftright("row_id", 33)
    starts, before = [], 0
    for row in sorted(keyed.groupBy(part.alias("part")).count().collect()):
        starts += [(row.part << 33) + at for at in range(-before % step, row["count"], step)]
        before += row["count"]
    return starts

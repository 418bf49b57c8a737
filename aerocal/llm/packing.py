"""Best-fit packing of documents into sequences of fixed capacity.

Pieces are packed as best-fit decreasing would pack them, in bulk-synchronous steps. The
pieces are range-sorted by length, and every piece gets its rank among pieces of its length
(rank in its range plus the counts of the ranges before). A step takes all unplaced pieces of
the largest length at once, sweeps the open gaps in ascending size from the smallest
that is large enough (the successor), pairs pieces and gaps by rank, so that no gap is
taken twice, moves the gaps used to their new size, and repeats while pieces are left.

What the steps exchange are counts: pieces per length and, for gaps, ranges of consecutive
sequence numbers per size. Lengths and sizes are at most ``capacity``, so a step's state has a
bound that does not depend on the number of documents; it is swept on the driver. The
pieces themselves are placed by a lookup of (length, rank) in the broadcast step results.

Defined cases: a null or empty text is a piece that holds only the end id. Only documents
longer than ``capacity`` are cut, into full pieces and one last piece. Rows that share
an id are packed each on its own. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.llm.common import id_text
from aerocal.llm.token_files import _encoder
from aerocal.session import materialise

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(
    docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str = "word_bpe_49k.json",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of an encoded document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                some = batch.slice(at, 1_000)
                flat, lengths = encoder.encode(some.column(1))
                ids = np.insert(flat, np.cumsum(lengths), end_id).astype("<u4")
                data, sizes = memoryview(ids).cast("B"), lengths + 1
                ends = np.cumsum(sizes)
                rows = []
                for doc, n, end in zip(some.column(0).to_pylist(), sizes.tolist(), ends.tolist()):
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        first = end - n + start
                        crc = zlib.crc32(data[4 * first : 4 * (first + length)])
                        rows.append((doc, k, start, length, crc))
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return id_text(docs, id_col, text_col).mapInArrow(cut, PIECES)


def best_fit_steps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Where the pieces go: rows (length, first rank, first sequence, offset).

    A row holds from its rank up to the next row of that length; each rank further on goes to the
    next sequence, at the same offset.
    """
    stock: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap size -> (sequence, how many)
    sizes: list[int] = []  # gap sizes with stock, ascending
    rows: list[tuple[int, int, int, int]] = []
    opened = 0

    def put(size: int, sequence: int, n: int) -> None:
        if size:
            if not stock[size]:
                insort(sizes, size)
            last = stock[size][-1] if stock[size] else None
            if last and last[0] + last[1] == sequence:
                stock[size][-1] = (last[0], last[1] + n)
            else:
                stock[size].append((sequence, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):  # no gap is large enough: as many new sequences as they fill
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            size = sizes[at]
            sequence, n = stock[size].pop()
            if not stock[size]:
                sizes.pop(at)
            if n > left:
                put(size, sequence + left, n - left)
                n = left
            rows.append((length, rank, sequence, capacity - size))
            put(size - length, sequence, n)
            rank, left = rank + n, left - n
    return rows


def _rank_in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), defaultdict(int)
    for batch in batches:
        lengths = batch.column(3).to_numpy()
        rank = np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        values, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
        for v, a, m in zip(values.tolist(), first.tolist(), n.tolist()):
            rank[order[a : a + m]] = seen[v] + np.arange(m)
            seen[v] += m
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(rank)],
            [*batch.schema.names, "part", "rank"],
        )


def pack(found: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to ``pieces``; offsets in a sequence have no gap from 0 on."""
    ranked = materialise(
        found.repartitionByRange("length", "doc_id", "piece", "ids_crc32")
        .sortWithinPartitions("length", "doc_id", "piece", "ids_crc32")
        .mapInArrow(_rank_in_range, f"{PIECES}, part int, rank long"),
        "pieces",
    )
    per_range = ranked.groupBy("length", "part").agg(F.count("*").alias("n")).collect()
    # at most one row per range and one per length, since ranges are sorted by length
    counts: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for row in sorted(per_range, key=lambda r: (r.length, r.part)):
        before[row.length, row.part] = counts[row.length]
        counts[row.length] += row.n
    steps = sorted(best_fit_steps(counts, capacity))
    keys = np.array([(s[0] << 44) + s[1] for s in steps], np.int64)
    table = np.array(steps, np.int64).reshape(-1, 4)
    held = shared(found, (before, keys, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier, bounds, where = held.value
        for batch in batches:
            lengths = batch.column(3).to_numpy().astype(np.int64)
            parts = batch.column(5).to_numpy()
            base = np.fromiter(
                (earlier[k] for k in zip(lengths.tolist(), parts.tolist())), np.int64, len(lengths)
            )
            rank = batch.column(6).to_numpy() + base
            step = np.searchsorted(bounds, (lengths << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(where[step, 2] + rank - where[step, 1]),
                 pa.array(where[step, 3])],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def shared(df: DataFrame, value):
    """A broadcast variable of the session's context; the caller states why it is bounded."""
    return df.sparkSession.sparkContext.broadcast(value)


def pack_documents(
    docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str = "word_bpe_49k.json",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode, cut and pack: one row per piece with its sequence and its place there."""
    found = pieces(docs, capacity, end_id, tokenizer, id_col, text_col)
    # written first: a range sort samples its input, which would encode every text twice
    return pack(materialise(found, "cut"), capacity)

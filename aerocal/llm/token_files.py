"""Token ids as Simple-8b files in ascending document order.

A data set is a folder with two tables. ``blocks`` holds one row for up to ``per_row`` ids (a
row ends with a document): its part and number, the doc ids, their lengths and the
ids as Simple-8b words with the word offset of every block of 1,024 ids. ``index`` holds the
number of ids before each part. Parts are ranges of doc_id, so parts, rows and documents in
them are in ascending order. The rows are written and read by Spark, so the folder may be
in any store.

Texts are sorted by range before encoding, which moves the text once and its ids never.

Defined cases: a null text is empty and has only its end id. A null doc_id comes first.
Rows that share a doc_id follow each other, ordered by a hash of their text. An empty
table gives an empty data set. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerocal.llm.common import id_text, tokenizer_file
from aerocal.llm.simple8b import decode, encode
from aerocal.llm.tokens import WordEncoder

BLOCKS = (
    "part int, number int, n_ids long, doc_ids array<long>, lengths binary, words binary, "
    "word_offsets binary"
)


def write_token_files(
    docs: DataFrame, path: str, end_id: int = 2, tokenizer: str = "word_bpe_49k.json",
    id_col: str = "doc_id", text_col: str = "text", per_row: int = 1 << 20,
) -> None:
    """Encode whole texts, put ``end_id`` behind each, and write the data set to ``path``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer)
        docs_held, sizes, ids, total = [], [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                some = batch.slice(at, 1_000)
                flat, lengths = encoder.encode(some.column(1))
                ends = np.cumsum(lengths)
                docs_held.extend(some.column(0).to_pylist())
                sizes.append(lengths + 1)
                ids.append(np.insert(flat, ends, end_id))
                total += int(lengths.sum()) + len(lengths)
                if total >= per_row:
                    yield _row(part, number, docs_held, sizes, ids)
                    docs_held, sizes, ids, total = [], [], [], 0
                    number += 1
        if docs_held:
            yield _row(part, number, docs_held, sizes, ids)

    ordered = (
        id_text(docs, id_col, text_col)
        .withColumn("key", F.xxhash64("text"))
        .repartitionByRange("doc_id", "key")
        .sortWithinPartitions("doc_id", "key")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(pack, BLOCKS).write.parquet(f"{path}/blocks")
    spark = docs.sparkSession
    totals = (
        spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    )  # one number per part
    before, index = 0, []
    for row in sorted(totals):
        index.append((row.part, before))
        before += row.n
    spark.createDataFrame(index, "part int, before long").coalesce(1).write.parquet(f"{path}/index")


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(tokenizer: str) -> WordEncoder:
    """One encoder per worker process; its word table serves every task the worker runs."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = WordEncoder(tokenizer_file(tokenizer))
    return _ENCODERS[tokenizer]


def _row(part: int, number: int, docs: list, sizes: list, ids: list) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    words, offsets = encode(flat)
    lengths = np.concatenate(sizes).astype("<u4")
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()), pa.array([number], pa.int32()),
            pa.array([len(flat)], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
            pa.array([lengths.tobytes()], pa.binary()),
            pa.array([words.astype("<u8").tobytes()], pa.binary()),
            pa.array([offsets.astype("<u4").tobytes()], pa.binary()),
        ],
        ["part", "number", "n_ids", "doc_ids", "lengths", "words", "word_offsets"],
    )


def read_token_files(
    spark: SparkSession, path: str, of: Callable[[np.ndarray], object] | None = None,
    kind: str = "array<int>", name: str = "ids",
) -> DataFrame:
    """One row per document: doc_id, start (ids before it), n_tokens and its ids.

    ``of`` reduces the ids of a document in the decoding task to a value of SQL type ``kind``.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    index = spark.read.schema("part int, before long").parquet(f"{path}/index")
    schema = f"part int, number int, n_ids long, doc_id long, at long, n_tokens long, {name} {kind}"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(
                    np.frombuffer(row["words"], "<u8"),
                    np.frombuffer(row["word_offsets"], "<u4").astype(np.int64), row["n_ids"],
                ).astype("<u4")
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                values = [
                    of(ids[b - n : b]) if of else ids[b - n : b].astype(np.int32)
                    for n, b in zip(lengths.tolist(), ends.tolist())
                ]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["number"]] * n, pa.int32()),
                        pa.array([row["n_ids"]] * n, pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths),
                        pa.array(lengths), pa.array(values) if n else pa.nulls(0),
                    ],
                    ["part", "number", "n_ids", "doc_id", "at", "n_tokens", name],
                )

    heads = blocks.select("part", "number", "n_ids").join(F.broadcast(index), "part")
    rows_before = F.coalesce(
        F.expr("sum(n_ids) over (partition by part order by number "
               "rows between unbounded preceding and 1 preceding)"), F.lit(0),
    )
    starts = heads.select("part", "number", (F.col("before") + rows_before).alias("row_start"))
    return (
        blocks.mapInArrow(unpack, schema)
        .join(F.broadcast(starts), ["part", "number"])  # one row per ``per_row`` ids
        .select("doc_id", (F.col("row_start") + F.col("at")).alias("start"), "n_tokens", name)
    )


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())

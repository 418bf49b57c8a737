"""Substring deduplication over content-defined chunks.

A gear rolling hash over the last 32 bytes sets chunk borders where its top bits are zero,
so a border depends on content only and an insertion moves just the chunks it touches.
Chunks have at least ``smallest`` and at most ``largest`` bytes, the mean is near
2 ** bits + smallest. Equal chunks (128-bit digest and length) after the first, in order of
(doc_id, start), are repeats.

Only (digest, doc_id, start, length) is shuffled for the comparison, and the first place of
a digest is a map-side combined minimum, so a chunk that a third of all documents hold
costs a row per task. Digests seen once are dropped before the places are looked up.

Defined cases: a null text is empty and has no chunk. A document is told by (doc_id, hash of
its text): texts that share an id are apart, a row that is repeated whole is the same
document and is not a repeat of itself. A null doc_id comes before all others. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.llm.common import id_text, utf8

#: One pseudo-random 32-bit number for each byte value, made by rule.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j < 32, by doubling."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        if len(h) > shift:
            moved = h[:-shift] << np.uint32(shift)
            h = h.copy()
            h[shift:] += moved
    return h


def chunk_ends(text: bytes, bits: int = 6, smallest: int = 32, largest: int = 512) -> list[int]:
    """Ends of the chunks of ``text``, in order; the last is its length."""
    if not text:
        return []
    low = np.uint32(32 - bits)
    borders = (np.flatnonzero((gear_hash(np.frombuffer(text, np.uint8)) >> low) == 0) + 1).tolist()
    ends, start = [], 0
    for border in borders:
        while border - start > largest:
            start += largest
            ends.append(start)
        if border - start >= smallest:
            ends.append(border)
            start = border
    while len(text) - start > largest:
        start += largest
        ends.append(start)
    if start < len(text):
        ends.append(len(text))
    return ends


def chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bits: int = 6, smallest: int = 32, largest: int = 512,
) -> DataFrame:
    """One row per chunk: doc_id, text_key, start, length, digest (16 bytes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, at, size, found = [], [], [], [], []
            rows = zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist())
            for doc, text, key in rows:
                start = 0
                for end in chunk_ends(text, bits, smallest, largest):
                    ids.append(doc)
                    keys.append(key)
                    at.append(start)
                    size.append(end - start)
                    found.append(xxhash.xxh3_128_digest(text[start:end]))
                    start = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(at, pa.int64()),
                 pa.array(size, pa.int32()), pa.array(found, pa.binary())],
                ["doc_id", "text_key", "start", "length", "digest"],
            )

    return (
        id_text(docs, id_col, text_col)
        .withColumn("text_key", F.xxhash64("text"))
        .mapInArrow(cut, "doc_id long, text_key long, start long, length int, digest binary")
    )


def repeated_chunks(found: DataFrame) -> DataFrame:
    """Chunks after the first of their digest: place, length and first place."""
    place = F.struct("doc_id", "text_key", "start")
    first = (
        found.groupBy("digest", "length")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "length", "first")
    )
    return (
        found.join(first, ["digest", "length"])
        .where(~place.eqNullSafe(F.col("first")))
        .select(
            "doc_id", "text_key", "start", "length",
            F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"),
        )
    )


def cut_spans(with_kept: bool):
    """Arrow function: (doc_id, text, spans of (start, end)) to counts and what is left.

    Spans may overlap; a run is a maximal stretch of cut bytes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, runs, sha, left = [], [], [], [], []
            for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                at, kept, gone, count = 0, [], 0, 0
                last = None
                for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                    if last is None or start > last:
                        kept.append(text[at:start])
                        count += 1
                        last = start
                    gone += max(0, end - last)
                    last = at = max(last, end)
                kept.append(text[at:])
                whole = b"".join(kept)
                n.append(len(text))
                removed.append(gone)
                runs.append(count)
                sha.append(hashlib.sha256(whole).hexdigest())
                left.append(whole if with_kept else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                       pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                columns.append(pa.array(left, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def remove_spans(texts: DataFrame, spans: DataFrame, with_kept: bool) -> DataFrame:
    """Cut ``spans`` (doc_id, text_key, start, end) out of ``texts`` (doc_id, text), per document."""
    lists = (
        spans.groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        .select(F.col("doc_id").alias("span_doc"), F.col("text_key").alias("span_key"), "spans")
    )
    return (
        texts.withColumn("text_key", F.xxhash64("text"))
        .join(
            lists,
            F.col("text_key").eqNullSafe(F.col("span_key"))
            & F.col("doc_id").eqNullSafe(F.col("span_doc")),
            "left",
        )
        .select("doc_id", "text", "spans")
        .mapInArrow(
            cut_spans(with_kept),
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
            + (", kept binary" if with_kept else ""),
        )
    )


def drop_repeated_chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bits: int = 6, smallest: int = 32, largest: int = 512, with_kept: bool = True,
) -> DataFrame:
    """One row per document with what is left after its repeated chunks are cut out.

    Columns: doc_id, n_bytes, n_removed (bytes cut), n_spans (maximal cut runs), kept_sha256
    and, if asked for, kept (the bytes that stay; a character may be cut at a border).
    """
    found = chunks(docs, id_col, text_col, bits, smallest, largest)
    spans = repeated_chunks(found).select(
        "doc_id", "text_key", "start", (F.col("start") + F.col("length")).alias("end")
    )
    return remove_spans(id_text(docs, id_col, text_col), spans, with_kept)

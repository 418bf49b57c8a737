"""Exact deduplication with a heavy-hitter split.

Each text is reduced to the SHA-256 of its normal form (A-Z lower-cased, nothing else) in
one pass; :func:`exact_groups` shuffles only digests, :func:`drop_copies` the rows it returns and
the few copies that pass the scan. A Misra-Gries summary of ``counters`` entries per task finds
every digest that holds more than rows / (counters + 1) of the rows. The candidates, at
most ``counters`` of them, are counted exactly, and the verified winners are broadcast:
their rows are decided where they stand. All other digests go through an ordinary shuffle
in which a key holds at most rows / (counters + 1) rows.

Defined cases: a null text is empty, so null and empty texts are equal. Of equal texts
the row with the largest doc_id stays; a null doc_id is smaller than any other; of rows
repeated with the same id and text exactly one stays. An empty table gives an empty
result. Columns other than id and text are not read by :func:`exact_groups` and are
returned unchanged by :func:`drop_copies`.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerocal.llm.common import fresh, id_text, named, utf8
from aerocal.session import materialise


def digest(text: bytes) -> bytes:
    """SHA-256 of the text with A-Z lower-cased (``bytes.lower`` touches ASCII only)."""
    return hashlib.sha256(text.lower()).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([digest(t) for t in utf8(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "digest"])


def shrink(counts: Counter, counters: int) -> Counter:
    """Misra-Gries merge rule: subtract the (counters + 1)-th largest count, keep what is left."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def frequent_digests(digests: DataFrame, counters: int) -> DataFrame:
    """At most ``counters`` digests, among them all with over rows / (counters + 1) rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held.update(batch.column(0).to_pylist())
            held = shrink(held, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
            ["digest", "n"],
        )

    merged = (
        digests.select("digest")
        .mapInArrow(summarise, "digest binary, n long")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
    )
    top = merged.orderBy(F.desc("n"), "digest").limit(counters + 1).collect()
    held = shrink(Counter({bytes(r.digest): r.n for r in top}), counters)
    return digests.sparkSession.createDataFrame([(bytearray(k),) for k in held], "digest binary")


def heavy_winners(digests: DataFrame, counters: int) -> DataFrame:
    """Verified groups of the frequent digests: digest, group_size, last (doc_id and row id)."""
    candidates = frequent_digests(digests, counters)
    return (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("last"))
        .where("group_size > 1")
    )


def _digest_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, row_id) written once, so that row ids stay the same for every reader."""
    found = id_text(docs, id_col, text_col).mapInArrow(_digests, "doc_id long, digest binary")
    return materialise(found.withColumn("row_id", F.monotonically_increasing_id()), "digests")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _digest_table(docs, id_col, text_col)
    heavy = materialise(heavy_winners(rows, counters), "heavy")
    decided = rows.join(F.broadcast(heavy), "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "*",
        F.count("*").over(same).alias("group_size"),
        F.max(F.struct("doc_id", "row_id")).over(same).alias("last"),
    )
    return decided.unionByName(rest).select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("last.row_id") == F.col("row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged.

    Rows of the broadcast winners are removed in the scan (per task at most one row of the
    winning id passes); what passes is shuffled once by digest and the largest id kept.
    """
    heavy = heavy_winners(_digest_table(docs, id_col, text_col), counters).collect()
    winners = {bytes(r.digest): r.last.doc_id for r in heavy}  # at most ``counters`` rows
    mark, ident = fresh(docs, "row_digest"), fresh(docs, "row_ident")
    tagged = docs.withColumn(ident, named(id_col).cast("long"))
    text_at, id_at = docs.columns.index(text_col), len(docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            found = [digest(t) for t in utf8(batch.column(text_at))]
            keep = []
            for d, i in zip(found, batch.column(id_at).to_pylist()):
                stays = d not in winners or (i == winners[d] and d not in seen)
                if stays and d in winners:
                    seen.add(d)
                keep.append(stays)
            columns = [*batch.columns, pa.array(found, pa.binary())]
            whole = pa.RecordBatch.from_arrays(columns, [*batch.schema.names, mark])
            yield whole.filter(pc.cast(pa.array(keep, pa.bool_()), pa.bool_()))

    schema = tagged.withColumn(mark, F.lit(b"").cast("binary")).schema
    order = Window.partitionBy(named(mark)).orderBy(named(ident).desc_nulls_last())
    rank = fresh(docs, "row_rank")
    return (
        tagged.mapInArrow(scan, schema)
        .withColumn(rank, F.row_number().over(order))
        .where(named(rank) == 1)
        .drop(rank, mark, ident)
    )

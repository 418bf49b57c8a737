"""Repeated substrings over a sparse enhanced suffix array, and their removal.

Suffixes are taken at content-chosen places: in every window of ``length`` bytes those where
the next 40 bytes have the smallest hash of the window. Equal windows choose equal places, so
all copies of a repeat of ``length`` bytes share a suffix, and about a thirtieth of all
suffixes are handled. The steps:

1. A suffix is a hash of its 40 bytes, a digest of its context (up to length - 40 bytes on either
   side), document and place. Of documents that are equal as a whole only the first is looked at.
2. Suffixes with equal contexts are one class, known by its first place. All others of a class
   repeat the first over the whole context. One shuffle by hash finds classes and their first places.
   Hashes that hold over rows / (counters + 1) suffixes are found by Misra-Gries summaries and an exact
   count, at most ``counters`` of them; their classes are combined map-side instead.
3. Where a hash has several classes, each class fetches the bytes of its first place. All other
   suffixes are done.
4. Classes of one hash are sorted by the bytes that follow: an enhanced suffix array. A stack scan
   over the common-prefix lengths of neighbours gives the tree of common-prefix intervals. An
   interval is tested for left extensions: its classes are sorted by the bytes before
   (backwards), and a second scan gives the groups that also share enough to the left for
   ``length`` bytes in all. Each is a repeat group with all its occurrences; all but its first
   place are repeats.
5. A hash with very many classes (the edge of a passage that a large share of the documents hold) is
   not put into one task: its windows are dealt out one by one, and the first place of each
   window is a map-side combined minimum. Both ways give the same bytes.

Defined cases: a null text is empty and has no repeat. A document is told by (doc_id, hash of its
text); documents of one id are ordered by that hash, a null id comes first, and a row that is
repeated whole is the same document. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerocal.llm.chunk_dedup import remove_spans
from aerocal.llm.common import id_text, utf8
from aerocal.llm.exact_dedup import frequent_digests
from aerocal.session import materialise

SEED = 40  # bytes of a suffix that are hashed
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 256, dtype=np.uint64)
PART = 1 << 20


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each place on: 32 by doubling, then eight more."""
    h, power = _BYTE[data], _BASE
    eight = None
    for half in (1, 2, 4, 8, 16):
        h = h[:-half] * np.uint64(power) + h[half:]
        power = power * power % 2**64
        if half == 4:
            eight, shift = h, power
    h = h[:-8] * np.uint64(shift) + eight[32:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each place on."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def chosen_places(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, ascending, with the smallest hash of some window of ``length`` bytes, and the hashes.

    Equal smallest hashes are all chosen. Long texts are done in overlapping parts.
    """
    width = length - SEED + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes = [], []
    for at in range(0, len(data) - length + 1, PART):
        h = seed_hashes(data[at : at + PART + length - 1])
        least = _sliding_min(h, width)
        # a place is chosen if the largest of the minima of the windows that hold it is its own hash
        edge = np.zeros(width - 1, np.uint64)
        largest = ~_sliding_min(~np.concatenate([edge, least, edge]), width)
        low = np.flatnonzero(h == largest)
        places.append(low + at)
        hashes.append(h[low])
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def suffixes(texts: DataFrame, length: int) -> DataFrame:
    """(hash, context, doc_id, text_key, place, after) of the chosen suffixes.

    ``context`` is a digest of the bytes from ``length - SEED`` before the place on, ``after`` how many
    of them follow the place.
    """
    side = length - SEED

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = utf8(batch.column(2))
            for begin in range(0, len(raw), 1_000):
                counts, places, hashes, contexts, follow = [], [], [], [], []
                for text in raw[begin : begin + 1_000]:
                    p, h = chosen_places(np.frombuffer(text, np.uint8), length)
                    counts.append(len(p))
                    places.append(p)
                    hashes.append(h)
                    follow.append(np.minimum(len(text) - p, length))
                    contexts.extend(_context(text, at, side, length) for at in p.tolist())
                owner = pa.array(np.repeat(np.arange(begin, begin + len(counts)), counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes).view(np.int64)),
                     pa.array(np.array(contexts, np.uint64).view(np.int64)), batch.column(0).take(owner),
                     batch.column(1).take(owner), pa.array(np.concatenate(places)),
                     pa.array(np.concatenate(follow).astype(np.int32))],
                    ["hash", "context", "doc_id", "text_key", "place", "after"],
                )

    return texts.select("doc_id", "text_key", "text").mapInArrow(
        choose, "hash long, context long, doc_id long, text_key long, place long, after int"
    )


def _context(text: bytes, place: int, side: int, length: int) -> int:
    """Digest of the context; the seed tells where in it a context cut short on the left begins."""
    return xxhash.xxh3_64_intdigest(text[max(0, place - side) : place + length], min(place, side))


def _contexts(length: int):
    side = length - SEED

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = utf8(batch.column(2))
            for begin in range(0, len(raw), 200):
                cols: list[list] = [[] for _ in range(6)]
                part = batch.slice(begin, 200)
                rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw[begin : begin + 200],
                           part.column(3).to_pylist())
                for doc, key, text, wanted in rows:
                    for item in wanted:
                        p = item["place"]
                        before, after = text[max(0, p - side) : p], text[p : p + length]
                        for col, value in zip(cols, (item["hash"], doc, key, p, before, after)):
                            col.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)],
                    ["hash", "doc_id", "text_key", "place", "before", "after"],
                )

    return fetch


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Common-prefix intervals (depth, parent's depth, first, last) of an enhanced suffix array.

    ``lcp[i]`` is the common prefix of entries i and i + 1. One stack scan; intervals come out
    when they close, and each has two entries or more.
    """
    stack: list[tuple[int, int]] = []  # (depth, first)
    for i, depth in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, max(depth, stack[-1][0] if stack else 0), first, i
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeat_groups(rows: list[tuple[bytes, bytes]], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Repeat groups among the classes (bytes before, bytes from the suffix on) of one hash.

    Yields (left, right, members): ``members`` agree on ``left`` bytes before and ``right`` bytes
    from the suffix on, left + right >= length, and every window of ``length`` bytes in it that
    starts before the suffix and holds its seed is shared by these members and no others.
    """
    order = sorted(range(len(rows)), key=lambda i: rows[i][1])
    lcp = [_common(rows[a][1], rows[b][1]) for a, b in zip(order, order[1:])]
    for depth, parent, first, last in intervals(lcp):
        # windows that start ``o`` bytes before the suffix, least <= o <= most, belong to this interval
        least, most = max(0, length - depth), length - max(parent + 1, SEED)
        if depth < SEED or least > most:
            continue
        inside = order[first : last + 1]
        if depth >= length:
            yield 0, length, inside
        inside = sorted(inside, key=lambda i: rows[i][0][::-1])
        left = [_common(rows[a][0][::-1], rows[b][0][::-1]) for a, b in zip(inside, inside[1:])]
        for shared, above, a, b in intervals(left):  # left extensions that differ
            low, high = max(least, above + 1), min(shared, most)
            if low <= high:
                yield high, length - low, inside[a : b + 1]


COVER = "kind int, doc_id long, text_key long, start long, end long, window binary"


def _cover_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) if rows else [[]] * 6
    names = [c.split()[0] for c in COVER.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _windows(row: tuple, length: int) -> Iterator[tuple]:
    """The windows of one class that hold its seed."""
    _, doc, key, place, before, after = row
    whole, at = before + after, len(before)
    for o in range(max(0, length - len(after)), min(at, length - SEED) + 1):
        window = xxhash.xxh3_128_digest(whole[at - o : at - o + length])
        yield 1, doc, key, place - o, place - o + length, window


def _group(rows: list[tuple], length: int) -> Iterator[tuple]:
    """Covered spans of the classes of one hash: every member of a group but its first place.

    All spans of a class hold its seed, so together they are one span.
    """
    widest: dict[int, tuple[int, int]] = {}
    for left, right, members in repeat_groups([(r[4], r[5]) for r in rows], length):
        first = min(members, key=lambda i: rows[i][6])
        for i in members:
            if i != first:
                before, after = widest.get(i, (0, 0))
                widest[i] = max(before, left), max(after, right)
    for i, (left, right) in widest.items():
        _, doc, key, place = rows[i][:4]
        yield 0, doc, key, place - left, place + right, None


def _tree_scan(length: int, bucket: int, hot: frozenset[int]):
    """Arrow function over classes sorted by hash and place: spans, or windows where a hash has too many.

    A class that comes again, as its row is repeated whole, counts once.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        over, current, out, last = False, None, [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] == last:
                    continue
                last = row[:4]
                if row[0] != current:
                    if len(held) > 1:
                        out.extend(_group(held, length))
                    held, current = [], row[0]
                    over = current in hot
                if over:
                    out.extend(_windows(row, length))
                else:
                    held.append((*row, (row[1] is not None, row[1] or 0, row[2], row[3])))
                    if len(held) > bucket:
                        for r in held:
                            out.extend(_windows(r[:6], length))
                        held, over = [], True
                if len(out) > 20_000:
                    yield _cover_batch(out)
                    out = []
        if len(held) > 1:
            out.extend(_group(held, length))
        yield _cover_batch(out)

    return scan


def repeated_spans(texts: DataFrame, length: int = 100, counters: int = 1000, bucket: int = 2000) -> DataFrame:
    """Bytes of repeats that are not the first: doc_id, text_key, start, end (may overlap).

    ``texts`` has doc_id, text_key, text. A whole-text copy gives one span.
    """
    place = F.struct("doc_id", "text_key", "place")
    slim = materialise(
        texts.select("doc_id", "text_key", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n_bytes")),
        "texts",
    )
    firsts = slim.where(F.col("n_bytes") >= length).groupBy("sha").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("many")
    ).where("many > 1")
    whole = materialise(
        slim.join(firsts, "sha").where(~F.struct("doc_id", "text_key").eqNullSafe(F.col("first"))).select(
            "doc_id", "text_key", F.lit(0).cast("long").alias("start"), F.col("n_bytes").cast("long").alias("end")
        ).distinct(),
        "whole",
    )
    copies = whole.select(F.col("doc_id").alias("copy_doc"), F.col("text_key").alias("copy_key"))
    own = texts.join(
        copies, F.col("doc_id").eqNullSafe(F.col("copy_doc")) & (F.col("text_key") == F.col("copy_key")), "left_anti"
    )
    found = materialise(suffixes(own, length), "suffixes")
    digests = found.select(F.to_binary(F.lpad(F.hex("hash"), 16, "0"), F.lit("hex")).alias("digest"))
    often = frequent_digests(digests, counters).select(F.conv(F.hex("digest"), 16, -10).cast("long").alias("hash"))
    likely = [r.hash for r in often.collect()]  # at most ``counters`` numbers, confirmed by an exact count
    counts = found.where(F.col("hash").isin(likely)).groupBy("hash").count()
    hashes = frozenset(
        r.hash for r in counts.where(F.col("count") > F.lit(found.count()) / (counters + 1)).collect()
    )
    is_often = F.col("hash").isin(*hashes) if hashes else F.lit(False)
    same, equal = Window.partitionBy("hash"), Window.partitionBy("hash", "context")
    rest = (
        found.where(~is_often)
        .repartition(F.col("hash"))  # here, so that the place beside its own columns does not travel
        .withColumn("at", F.min(place).over(equal))
        .withColumn("several", F.min("context").over(same) != F.max("context").over(same))
    )
    hot = found.where(is_often)
    heads = materialise(hot.groupBy("hash", "context").agg(F.min(place).alias("at")), "heads")
    told = materialise(
        rest.unionByName(hot.join(heads, ["hash", "context"]).withColumn("several", F.lit(True)))
        .withColumn("again", ~place.eqNullSafe(F.col("at")))
        .where("again or several")
        .select("again", "hash", "doc_id", "text_key", "place", "after"),
        "classes",
    )
    start = F.col("place") - F.least("place", F.lit(length - SEED).cast("long"))
    again = told.where("again").select(
        "doc_id", "text_key", start.alias("start"), (F.col("place") + F.col("after")).alias("end")
    ).where(F.col("end") - F.col("start") >= length)
    wanted = (
        told.where("not again").groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("place", "hash")).alias("wanted"))
        .select(F.col("doc_id").alias("first_doc"), F.col("text_key").alias("first_key"), "wanted")
    )
    # a very frequent hash is spread: its windows are dealt out one by one
    spread = F.when(is_often, F.xxhash64("doc_id", "place"))
    covers = materialise(
        own.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_key") == F.col("first_key")))
        .select("doc_id", "text_key", "text", "wanted")
        .mapInArrow(_contexts(length), "hash long, doc_id long, text_key long, place long, before binary, after binary")
        .repartition(F.col("hash"), F.coalesce(spread, F.lit(0).cast("long")))
        .sortWithinPartitions("hash", "doc_id", "text_key", "place")
        .mapInArrow(_tree_scan(length, bucket, hashes), COVER),
        "covers",
    )
    windows = covers.where("kind = 1").select("doc_id", "text_key", "start", "end", "window")
    at = F.struct("doc_id", "text_key", "start")
    earliest = windows.groupBy("window").agg(F.min(at).alias("at"), F.count("*").alias("many")).where("many > 1")
    later = windows.join(earliest.drop("many"), "window").where(~at.eqNullSafe(F.col("at"))).select(
        "doc_id", "text_key", "start", "end"
    )
    spans = covers.where("kind = 0").select("doc_id", "text_key", "start", "end")
    return whole.unionByName(again).unionByName(spans).unionByName(later)


def drop_repeats(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
    with_kept: bool = True, counters: int = 1000, bucket: int = 2000,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept."""
    texts = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    spans = repeated_spans(texts, length, counters, bucket)
    return remove_spans(texts.select("doc_id", "text"), spans, with_kept)

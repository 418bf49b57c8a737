"""N-gram Jaccard join by grouped prefixes: which documents are near-duplicates of which.

A document is its set of distinct word shingles, as 64-bit hashes. Two documents link when
den * intersection >= num * union. The steps:

1. Words are counted by documents; at most ``limit`` frequent ones are kept. The order of shingles
   is by the count of their rarest word, then by hash, so a prefix holds the rarest shingles and
   stock phrases come last. The order only steers the work: any order gives the same links.
2. A set of n shingles must share one of its first n - ceil(num * n / den) + 1 with each partner
   (prefix filter). Equal sets are one class, and classes with equal prefix and size are one group.
3. Groups that share a prefix shingle and fit in size are candidates. Shingles that the same groups
   hold give the same candidates, so one of them stands for all. In a bucket of a shingle one group is compared with all others (a star) and then leaves; buckets whose remaining
   groups are all in one component are done, for further links among them change nothing.
   When the pairs left are no more than a few times the rows at first, when a round leaves
   over nine tenths of them, or after ``stars`` rounds, they are compared one by one, but only across components.
4. Candidate groups are expanded to their classes. Each set has a parity sketch: bit i is the parity of
   the number of shingles that fall on i. Two sketches differ in no more bits than their sets differ in
   shingles, so a pair with too many differing bits cannot link and goes before whole sets
   travel. In the last comparison the sketches are part of the join itself. What is left is verified
   by the whole sets.

So the comparisons in a group of copies grow with its size and not its square, and no link
between components is left out. Components come from alternating star steps.

Defined cases: a null text, an empty one or one without a word has an empty set and links with
nothing; fewer words than a shingle has are one shingle. Rows with a null doc_id link with nothing
and have a null component. Classes are known by a 64-bit digest of their set, so different texts under
one id are each compared, and each has its own row and component. An empty table gives an empty result. Other columns are not read by :func:`near_duplicates` and are
returned unchanged by :func:`keep_one_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerocal.llm.common import fresh, id_text, named, utf8
from aerocal.llm.components import connected
from aerocal.session import materialise, small_batches

#: Up to this many ids are broadcast to find the texts of classes in doubt.
BROADCAST_IDS = 200_000
#: Longs of a parity sketch.
SKETCH = 16
#: Rows that a task of whole texts gets, and gives, at once.
BATCH = 1_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    """64-bit hash of a word, held in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes(text: bytes, held: WordHashes) -> np.ndarray:
    """Hashes of the words, in order; words are runs without blanks or 0x09-0x0D."""
    found = text.lower().split()
    return np.fromiter(map(held.__getitem__, found), np.uint64, len(found))


def rolled(h: np.ndarray, words: int) -> np.ndarray:
    """One shingle hash (int64) for each place of the word hashes ``h``."""
    if not len(h):
        return np.zeros(0, np.int64)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
    if len(h) < words:
        out = (out ^ np.uint64(len(h))) * _MIX[1]
    return out.view(np.int64)


def shingles(text: bytes, words: int, held: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(rolled(word_hashes(text, held), words))


def ranks(h: np.ndarray, words: int, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each place, the count of the rarest word of its shingle (0: not among the frequent)."""
    if not len(often) or not len(h):
        return np.zeros(max(0, min(len(h), max(1, len(h) - words + 1))), np.int64)
    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
    rank = np.where(often[at] == h, counts[at], 0)
    n = max(1, len(h) - words + 1)
    return np.minimum.reduce([rank[k : k + n] for k in range(min(words, len(h)))])


def sketch(items: np.ndarray) -> np.ndarray:
    """Parity sketch of a set of shingle hashes, as int64 words."""
    bits = np.bincount((items.view(np.uint64) >> np.uint64(7)) % np.uint64(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _may_link(num: int, den: int, a: str, b: str, n_a: str, n_b: str) -> Column:
    """Whether sketches ``a`` and ``b`` of sets of these sizes differ in few enough bits."""
    differ = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH))
    return F.expr(f"({differ}) * {den + num}L <= ({n_a} + {n_b}) * {den - num}L")


def digest(items: np.ndarray) -> int:
    """64-bit digest of an array, signed."""
    return int.from_bytes(xxhash.xxh3_64_digest(items.tobytes()), "big", signed=True)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def frequent_words(texts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of at most ``limit`` frequent words and in how many documents they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, docs, size = WordHashes(), [], 0, 0

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(waiting), return_counts=True)
            often = n >= max(2, docs // 2000)
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(n[often])], ["word", "n"]
            )

        for batch in batches:
            for text in utf8(batch.column(1)):
                found = np.unique(word_hashes(text, held))
                waiting.append(found)
                docs, size = docs + 1, size + len(found)
                if size > 1_500_000:
                    yield flush()
                    waiting, docs, size = [], 0, 0
        if waiting:
            yield flush()

    top = (
        texts.mapInArrow(count, "word long, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(limit)
    )
    with small_batches(texts.sparkSession, BATCH):
        top = top.toArrow()  # at most ``limit`` rows
    values, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


def _signatures(texts: DataFrame, words: int, num: int, den: int, limit: int) -> DataFrame:
    """One row per document: doc_id, n, digest of the set, digest of the prefix, prefix, sketch."""
    order = texts.sparkSession.sparkContext.broadcast(frequent_words(texts, limit))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, (often, counts) = WordHashes(), order.value
        for batch in batches:
            sizes, digests, heads, prefixes, sketches = [], [], [], [], []
            for text in utf8(batch.column(1)):
                h = word_hashes(text, held)
                found, place = np.unique(rolled(h, words), return_index=True)
                n = len(found)
                rank = ranks(h, words, often, counts)[place]
                prefix = found[np.lexsort((found, rank))[: prefix_length(n, num, den)]]
                sizes.append(n)
                digests.append(digest(found))
                heads.append(digest(prefix))
                prefixes.append(prefix)
                sketches.append(sketch(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()),
                 pa.array(heads, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "head", "prefix", "sketch"],
            )

    return texts.mapInArrow(
        sign, "doc_id long, n long, digest long, head long, prefix array<long>, sketch array<long>"
    )


def _sets(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingle array) of the documents that stand for the classes ``nodes`` (doc_id, node)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = WordHashes()
        for batch in batches:
            found = [shingles(t, words, held) for t in utf8(batch.column(1))]
            same = [digest(s) == e for s, e in zip(found, batch.column(2).to_pylist())]
            whole = pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(found, pa.list_(pa.int64()))], ["node", "items"]
            )
            yield whole.filter(pa.array(same, pa.bool_()))

    # rows repeated whole go before the sets are built; what is left of one id only repeats links
    wanted = (
        texts.join(nodes, "doc_id")
        .withColumn("key", F.xxhash64("text"))
        .dropDuplicates(["node", "key"])
        .select("doc_id", "text", "node")
    )
    return wanted.mapInArrow(build, "node long, items array<long>")


def _links(
    pairs: DataFrame, texts: DataFrame, sketches: DataFrame, words: int, num: int, den: int, files: int
) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; sketches sort out most of the others.

    Sets are built from the texts of the classes that are left, whose ids are broadcast up to
    ``BROADCAST_IDS`` of them, so texts that no pair needs stay where they are.
    """
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    pairs = materialise(
        pairs.join(left, "a").join(right, "b")
        .where(_may_link(num, den, "sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b").coalesce(files),
        "likely",
    )
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(
        sketches.select("node", "doc_id"), "node"
    )
    nodes = F.broadcast(nodes) if 2 * n_pairs <= BROADCAST_IDS else nodes
    with small_batches(texts.sparkSession, BATCH):
        sets = materialise(_sets(texts, nodes, words).coalesce(files), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("items_a") + F.size("items_b")).alias("sum"))
        .where(F.col("both") * den >= num * (F.col("sum") - F.col("both")))
        .select("a", "b")
        .coalesce(files)
    )


def _verified(
    pairs: DataFrame, grouped: DataFrame, texts: DataFrame, sketches: DataFrame, words: int, num: int, den: int,
    files: int,
) -> DataFrame:
    """Links between the groups of ``pairs``: first groups as such, then the classes in the others."""
    first = materialise(_links(pairs, texts, sketches, words, num, den, files), "links")
    if grouped.isEmpty():
        return first
    left = grouped.select(F.col("grp").alias("a"), F.col("node").alias("node_a"))
    right = grouped.select(F.col("grp").alias("b"), F.col("node").alias("node_b"))
    rest = (
        pairs.join(first, ["a", "b"], "left_anti")
        .join(left, "a", "left").join(right, "b", "left")
        .select("a", "b", F.coalesce("node_a", "a").alias("node_a"), F.coalesce("node_b", "b").alias("node_b"))
        .where((F.col("a") != F.col("node_a")) | (F.col("b") != F.col("node_b")))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    )
    return materialise(first.unionByName(_links(rest, texts, sketches, words, num, den, files)), "links")


def file_count(rows: DataFrame) -> int:
    """Into how many files at most the short rows about documents are written; grows with ``rows``."""
    return max(24, rows.count() // 10_000)


def class_links(
    texts: DataFrame, words: int, num: int, den: int, limit: int = 400_000, stars: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and links (a, b) that connect all linked classes."""
    signed = _signatures(texts, words, num, den, limit)
    with small_batches(texts.sparkSession, BATCH):
        rows = materialise(signed, "signatures")
    # a file written costs its task more than a few thousand short rows
    files = file_count(rows)
    named_rows = rows.where("n > 0 and doc_id is not null")
    classes = materialise(
        named_rows.groupBy(F.col("digest").alias("node"), "n", "head").agg(
            F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")
        ).coalesce(files),
        "classes",
    )
    groups = classes.groupBy("head", "n").agg(
        F.min(F.struct("node", "doc_id")).alias("first"), F.count("*").alias("size")
    ).select("size", F.col("first.node").alias("grp"), F.col("first.doc_id").alias("doc_id"), "head", "n")
    heads = (
        named_rows.select("doc_id", F.col("digest").alias("grp"), "prefix")
        .join(groups, ["grp", "doc_id"])
        .dropDuplicates(["grp", "doc_id"])  # rows repeated whole
    )
    tokens = heads.select(F.explode("prefix").alias("token"), "grp", "n", "size")
    # tokens of the same groups (told by their number and the sum of their hashes, without carries)
    shared = (
        tokens.groupBy("token")
        .agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("grp")).alias("held"), F.max(F.col("size") > 1).alias("wide"))
        .where("many > 1 or wide")
        .groupBy("many", "held")
        .agg(F.min("token").alias("token"))
        .select("token")
    )
    bucket = materialise(
        tokens.select("token", "grp", "n").join(shared, "token").select("token", "grp", "n").coalesce(files), "buckets"
    )
    members = materialise(
        classes.join(groups.where("size > 1").select("head", "n", "grp"), ["head", "n"])
        .select("grp", "node").coalesce(files),
        "members",
    )
    used = bucket.select(F.col("grp").alias("node")).unionByName(members.select("node")).distinct()
    sketches = materialise(
        classes.join(used, "node").select("node", "n", "doc_id", "sketch").coalesce(files), "sketches"
    )
    inner = members.where("grp <> node").select(F.col("grp").alias("a"), F.col("node").alias("b"))
    links = materialise(_links(inner, texts, sketches, words, num, den, files), "links")
    # a class that links with its group's first stays in the group, any other is a group of its own
    linked = links.select(F.col("a").alias("grp"), F.col("b").alias("node"))
    grouped = materialise(
        linked.unionByName(linked.select("grp", F.col("grp").alias("node"))).distinct().coalesce(files), "members"
    )
    alone = members.where("grp <> node").join(linked, ["grp", "node"], "left_anti")
    many = grouped.groupBy("grp").agg(F.count("*").alias("size"))
    bucket = bucket.unionByName(
        bucket.join(alone, "grp").select("token", F.col("node").alias("grp"), "n")
    ).distinct().join(many, "grp", "left").withColumn("size", F.coalesce("size", F.lit(1)))

    def labelled() -> DataFrame:
        both = bucket.join(linked_to.withColumnRenamed("node", "grp"), "grp", "left")
        both = both.select("token", "grp", "n", "size", F.coalesce("component", "grp").alias("component"))
        return materialise(both.coalesce(files), "live")

    fits = (F.col("n") * num <= F.col("pivot_n") * den) & (F.col("pivot_n") * num <= F.col("n") * den)

    def centres() -> DataFrame:
        # the star's centre is in the component that came last, so that outliers find the others
        last = F.max(F.struct("component", "grp", "n")).alias("last")
        return (
            live.groupBy("token")
            .agg(
                F.sum("size").alias("many"), F.min("component").alias("least"), last,
                F.count("*").alias("rows"), F.bit_xor(F.xxhash64("grp")).alias("held"),
            )
            .where("least <> last.component")
            .groupBy("rows", "held")  # the same groups are left for several tokens: one stands for all
            .agg(F.min(F.struct("token", "many", "last")).alias("one"))
            .select(
                "one.token", "one.many", F.col("one.last.grp").alias("pivot"), F.col("one.last.n").alias("pivot_n"),
                F.col("one.last.component").alias("pivot_component"),
            )
        )

    linked_to = materialise(connected(links, files).coalesce(files), "components")
    live = labelled()
    rows_first = live.agg(F.sum("size")).first()[0] or 0
    before = None
    for _ in range(stars):
        centre = centres()
        pairs_left = centre.agg(F.sum(F.col("many") * (F.col("many") - 1) / 2)).first()[0]
        if not pairs_left or pairs_left <= 3 * rows_first or before and 10 * pairs_left > 9 * before:
            break  # nothing is left, or a few pairs for each row of the buckets, or stars hardly help
        before = pairs_left
        around = live.join(centre.drop("many"), "token").where("grp <> pivot")
        pairs = around.where(fits & (F.col("component") != F.col("pivot_component"))).select(
            F.least("grp", "pivot").alias("a"), F.greatest("grp", "pivot").alias("b")
        )
        found = _verified(materialise(pairs.distinct().coalesce(files), "pairs"), grouped, texts, sketches, words, num, den, files)
        # what was linked so far goes on as one link of each class to its component
        links = linked_to.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
        linked_to = materialise(connected(links, files).coalesce(files), "components")
        bucket = materialise(around.select("token", "grp", "n", "size").coalesce(files), "buckets")
        live = labelled()
    # groups of several classes are expanded, so that the sketches are those of the classes themselves
    spread = live.join(centres().select("token"), "token").join(grouped.select("grp", "node"), "grp", "left").select(
        "token", F.coalesce("node", "grp").alias("node"), "n", "component"
    )
    sketched = materialise(spread.join(sketches.select("node", "sketch"), "node").coalesce(files), "sketched")
    left = sketched.select(
        "token", F.col("node").alias("a"), F.col("n").alias("pivot_n"), F.col("component").alias("c"),
        F.col("sketch").alias("sketch_a"),
    )
    right = sketched.select("token", F.col("node").alias("b"), "n", "component", F.col("sketch").alias("sketch_b"))
    pairs = (
        left.join(
            right,
            (left["token"] == right["token"]) & (F.col("a") < F.col("b")) & (F.col("c") != F.col("component")) & fits
            & _may_link(num, den, "sketch_a", "sketch_b", "n", "pivot_n"),
        )
        .select("a", "b")
        .distinct()
        .coalesce(files)
    )
    found = _links(materialise(pairs, "pairs"), texts, sketches, words, num, den, files)
    links = linked_to.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
    return rows, materialise(links.coalesce(files), "links")


def near_duplicates(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows, links = class_links(id_text(docs, id_col, text_col), words, num, den)
    files = file_count(rows)
    found = materialise(connected(links, files).coalesce(files), "components")
    classes = (
        rows.where("n > 0 and doc_id is not null")
        .groupBy(F.col("digest").alias("node"))
        .agg(F.min("doc_id").alias("least"))
        .join(found, "node", "left")
        .select("node", "least", F.coalesce("component", "node").alias("component"))
    )
    labels = classes.groupBy("component").agg(F.min("least").alias("smallest"))
    label = materialise(
        classes.join(labels, "component").select(F.col("node").alias("digest"), "smallest").coalesce(files), "labels"
    )
    return rows.select("doc_id", "n", "digest").join(label, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id"))
        .when(F.col("doc_id").isNotNull(), F.col("smallest")).alias("component_id"),
    )


def keep_one_each(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with their columns unchanged.

    Rows with an empty set or a null id stay; of rows repeated under the id that stays, all stay.
    """
    found = near_duplicates(docs, words, num, den, id_col, text_col)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    mark = fresh(docs, "row_ident")
    return (
        docs.withColumn(mark, named(id_col).cast("long"))
        .join(gone.withColumnRenamed("doc_id", mark), mark, "left_anti")
        .select(*(named(c) for c in docs.columns))
    )

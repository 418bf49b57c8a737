"""Language identification by prediction by partial matching over bytes.

For every language a context tree of depth four holds how often each byte followed each
context of 0 to 4 bytes. Under these frozen counts the code length of a byte comes from
the longest context that has seen it, with an escape (method C: number of different
successors over that number plus the total) for each longer context that has not, down to
one in 256. A text's code length in a language is the sum over its bytes; the shortest
wins, and the score is the winner's share when lengths are turned into probabilities.

Counting covers every byte of every training text: a task counts its five-byte windows and
Spark adds the counts; shorter contexts are sums of longer windows. The tree that is
broadcast keeps the ``nodes`` most frequent nodes over all languages and depths, which
bounds it (16 bytes a node) and drops only the rarest contexts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if no row can be learned from. Equal code lengths go to the first name. Rows with
a null language teach nothing; a null doc_id is not held out and teaches nothing. Repeated
rows count as often as they stand. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.llm.common import crc_mod, named, utf8

DEPTH = 4
LETTER = regex.compile(r"\p{L}")  # letters only: no digits, fractions or number signs
STEP = 1 << 20


def windows(data: np.ndarray) -> np.ndarray:
    """Five-byte windows as integers; ``data`` has DEPTH bytes more than windows."""
    wide = data.astype(np.int64)
    n = len(data) - DEPTH
    out = wide[:n].copy()
    for k in range(1, DEPTH + 1):
        out <<= 8
        out |= wide[k : k + n]
    return out


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in a row with DEPTH zero bytes before each, and the first and last place of each."""
    data = np.frombuffer(b"".join(b"\0" * DEPTH + t for t in texts), np.uint8)
    ends = np.cumsum([len(t) + DEPTH for t in texts], dtype=np.int64)
    return data, ends


def _real_windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, number of the text) for the real bytes, about a million at a time."""
    data, ends = padded(texts)
    begins = np.concatenate([[0], ends[:-1]])
    for at in range(DEPTH, len(data), STEP):
        stop = min(at + STEP, len(data))
        place = np.arange(at, stop)
        owner = np.searchsorted(ends, place, side="right")
        real = place >= begins[owner] + DEPTH
        yield windows(data[at - DEPTH : stop])[real], owner[real]


def window_counts(train: DataFrame) -> DataFrame:
    """(lang, window, n) over all texts of ``train`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waiting: dict[str, int] = {}

        def fold(lang: str) -> None:
            values = np.concatenate([v for v, _ in held[lang]])
            n = np.concatenate([c for _, c in held[lang]])
            found, inverse = np.unique(values, return_inverse=True)
            held[lang] = [(found, np.bincount(inverse, n, len(found)).astype(np.int64))]
            waiting[lang] = 0

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = utf8(batch.column(1))
            for lang in sorted(set(langs)):
                for found, _ in _real_windows([texts[i] for i in np.flatnonzero(langs == lang)]):
                    values, n = np.unique(found, return_counts=True)
                    held.setdefault(lang, []).append((values, n))
                    waiting[lang] = waiting.get(lang, 0) + len(values)
                    if waiting[lang] > 2_000_000:
                        fold(lang)
        for lang in held:
            fold(lang)
            values, n = held[lang][0]
            for at in range(0, len(values), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values[part])), pa.array(values[part]), pa.array(n[part])],
                    ["lang", "window", "n"],
                )

    return (
        train.mapInArrow(count, "lang string, window long, n long")
        .groupBy("lang", "window")
        .agg(F.sum("n").alias("n"))
    )


class ContextTrees:
    """Frozen counts of all languages: ``bits(windows)`` has a column per language."""

    def __init__(self, nodes: pd.DataFrame) -> None:
        self.langs = sorted(nodes["lang"].unique())
        self.trees = []
        for lang in self.langs:
            levels = []
            for depth in range(DEPTH + 1):
                mine = nodes[(nodes["lang"] == lang) & (nodes["depth"] == depth)].sort_values("node")
                node, n = mine["node"].to_numpy(np.int64), mine["n"].to_numpy(np.int64)
                context, first = np.unique(node >> 8, return_index=True)
                total = np.add.reduceat(n, first) if len(n) else n
                kinds = np.diff(np.concatenate([first, [len(n)]]))
                levels.append((node, n, context, total, kinds))
            self.trees.append(levels)
        full = nodes.loc[nodes["depth"] == DEPTH, "node"].unique()
        self.known = np.sort(full.astype(np.int64))
        self.table = self._bits(self.known).astype(np.float32)
        self.index: pd.Index | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": None}

    def _bits(self, found: np.ndarray) -> np.ndarray:
        out = np.empty((len(found), len(self.langs)))
        for column, levels in enumerate(self.trees):
            p = np.full(len(found), 1 / 256)
            for depth, (node, n, context, total, kinds) in enumerate(levels):
                if not len(node):
                    continue
                mask = (1 << (8 * (depth + 1))) - 1
                part = found & mask
                at = np.minimum(np.searchsorted(context, part >> 8), len(context) - 1)
                seen = context[at] == part >> 8
                where = np.minimum(np.searchsorted(node, part), len(node) - 1)
                hits = np.where(node[where] == part, n[where], 0)
                whole = total[at] + kinds[at]
                p = np.where(seen, np.where(hits > 0, hits / whole, p * kinds[at] / whole), p)
            out[:, column] = -np.log2(p)
        return out

    def bits(self, found: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each window after the others, by language."""
        if self.index is None:
            self.index = pd.Index(self.known)
        at = self.index.get_indexer(found)
        out = self.table[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            values, inverse = np.unique(found[new], return_inverse=True)
            out[new] = self._bits(values)[inverse]
        return out


def fit_context_trees(train: DataFrame, nodes: int = 2_000_000) -> ContextTrees | None:
    """Trees from all of ``train`` (lang, text); None if there is nothing to learn from."""
    counts = window_counts(train.where("lang is not null and text is not null"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    mask = F.expr("shiftleft(1L, 8 * (depth + 1)) - 1")
    kept = (
        counts.select("*", levels.alias("depth"))
        .groupBy("lang", "depth", F.col("window").bitwiseAND(mask).alias("node"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "lang", "depth", "node")
        .limit(nodes)
    )
    found = kept.toArrow().to_pandas()  # at most ``nodes`` rows
    return ContextTrees(found) if len(found) else None


def identify(
    docs: DataFrame, trees: ContextTrees | None, text_col: str = "text"
) -> DataFrame:
    """``docs`` (columns carried along: doc_id, held_out) with lang_pred, score and bits_per_byte."""
    model = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by its node limit
    rows = docs.select("doc_id", "held_out", named(text_col).cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            readable = [bool(t and LETTER.search(t)) and known is not None for t in texts]
            raw = [t.encode() if r else b"" for t, r in zip(texts, readable)]
            langs, best, per_byte = ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw))
            if known is not None:
                total = np.zeros((len(raw), len(known.langs)))
                for found, owner in _real_windows(raw):
                    cost = known.bits(found)
                    first = np.flatnonzero(np.diff(owner, prepend=-1))
                    if len(first):
                        sums = np.add.reduceat(cost, first, axis=0, dtype=np.float64)
                        total[owner[first]] += sums
                pick = total.argmin(axis=1)
                least = total[np.arange(len(raw)), pick]
                share = 1 / np.exp2(np.maximum(least[:, None] - total, -1000)).sum(axis=1)
                for i, ok in enumerate(readable):
                    if ok:
                        langs[i], best[i] = known.langs[pick[i]], share[i]
                        per_byte[i] = least[i] / len(raw[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(best),
                 pa.array(per_byte)],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    return rows.mapInArrow(
        score,
        "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double",
    )


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    nodes: int = 2_000_000,
) -> DataFrame:
    """Learn from rows with crc32(id) mod 4 other than 2 and predict every row."""
    ident = named(id_col).cast("long")
    part = crc_mod(ident, 4)
    train = docs.where(part != 2).select(
        named(lang_col).cast("string").alias("lang"), named(text_col).cast("string").alias("text")
    )
    trees = fit_context_trees(train, nodes)
    rows = docs.select(
        ident.alias("doc_id"), F.coalesce(part == 2, F.lit(False)).alias("held_out"),
        named(text_col).alias("text"),
    )
    return identify(rows, trees)

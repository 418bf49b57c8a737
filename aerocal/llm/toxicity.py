"""Toxicity scores of texts restored through a noisy channel.

Spellings such as ``1d10t``, ``i d i o t`` or ``idiooot`` are character lattices: a digit or sign
stands for letters it looks like, a sign or a space inside a word may be noise, a repeated
letter may be one. Viterbi decoding picks the cheapest path under a character trigram model of
the whole corpus plus the cost of each change. Words whose lattice has one path are left
as they are. The restored words are then scored.

Features are words that are frequent in toxic training texts and, for all other words, their first
four, five and six letters. A feature's weight is the lower Wilson bound of its toxic share among
labelled training texts (near-equal texts count once, by the smallest hash of their three-word
sequences), and a text's score is the largest weight among its features, or half the toxic share
of the training texts if none is known.

What is collected is bounded: 28 ** 3 trigram counts over all texts, at most ``max_labels``
labelled rows (those with the smallest hashes), and the features that ``least`` toxic ones of these rows
share. No feature is dropped beyond that.

Defined cases: a null or empty text has no word and gets the base score. Rows without a
label, or with a null label or id, teach nothing; if a doc_id has several labels the largest
counts. Without any training row every score is 0. Repeated rows are scored alike. Other
columns are not read by :func:`score_toxicity` and are returned unchanged by
:func:`drop_toxic`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.llm.common import crc_mod, id_text, named, strings, utf8

#: Letters that a digit or sign can stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
    "*": "aeiou", "#": "aeiou",
}
NOISE = "!|+(*#"  # signs that are as often noise as a letter
SWAP, DROP, REPEAT = 1.0, 1.5, 0.5  # costs of the channel, in nats
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
RUN = re.compile(r"(.)\1\1")
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$!|") + "«»„“”‚‘’…¿¡"
SIZE = 28  # boundary, a to z, any other letter

_CLASS = np.zeros(256, np.int64)
for _c in range(26):
    _CLASS[ord("a") + _c] = _CLASS[ord("A") + _c] = _c + 1
_CLASS[128:] = 27


def letter_class(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 if char.isalpha() else 0


def trigram_costs(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """-log p(c | a, b) over letter classes, from every text; 28 x 28 x 28."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 500):
                data = b" ".join([b" ", *utf8(batch.column(0).slice(at, 500)), b" "])
                c = _CLASS[np.frombuffer(data, np.uint8)]
                c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
                if len(c) > 2:
                    total += np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = (
        docs.select(named(text_col).cast("string").alias("text"))
        .mapInArrow(count, "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most 28 ** 3 rows
    )
    three = np.zeros(SIZE**3)
    for row in rows:
        three[row.gram] = row.n
    three = three.reshape(SIZE, SIZE, SIZE)
    two = three.sum(axis=0)
    one = (two.sum(axis=0) + 1) / (two.sum() + SIZE)
    given_one = (two + 10 * one) / (two.sum(axis=1, keepdims=True) + 10)
    given_two = (three + 10 * given_one[None]) / (three.sum(axis=2, keepdims=True) + 10)
    return -np.log(given_two)


class Restorer:
    """Viterbi decoding of words and spaced-out words under the trigram costs."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs.tolist()
        self.held: dict[str, str] = {}

    def _decode(self, chars: str) -> str:
        """The cheapest reading. States hold back pointers, so time and memory grow with the length.

        Equal costs go to the smallest state (at the end) or to the one found first (on the way).
        """
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for char in chars:
            options: list[tuple[str, float]] = []
            if char.isalpha():
                options.append((char, 0.0))
                if char == before:
                    options.append(("", REPEAT))
            else:
                options += [(c, SWAP) for c in LOOKS.get(char, "")]
                if not options or char in NOISE:
                    options.append(("", DROP))
                if char in " \t":
                    options.append((" ", 0.0))
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, back) in paths.items():
                row = self.costs[a][b]
                for letter, extra in options:
                    if not letter:
                        state, price, step = (a, b), cost + extra, back
                    else:
                        c = letter_class(letter)
                        price, step = cost + extra + row[c], (letter, back)
                        state = (b, c)
                    if state not in new or price < new[state][0]:
                        new[state] = (price, step)
            paths, before = new, char
        _, _, back = min((cost + self.costs[a][b][0], (a, b), back) for (a, b), (cost, back) in paths.items())
        letters = []
        while back is not None:
            letter, back = back
            letters.append(letter)
        return "".join(reversed(letters))

    def word(self, token: str) -> str:
        """The restored form of one lower-case token without its outer punctuation."""
        word = token.strip(EDGE)
        if word.isalpha() and not RUN.search(word):
            return word
        found = self.held.get(word)
        if found is None:
            if any(c.isalpha() for c in word):
                found = self._decode(word).strip()
            else:
                found = ""
            if len(self.held) > 200_000:
                self.held.clear()
            self.held[word] = found
        return found

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a text."""
        low = text.lower()
        found = {self.word(t) for t in set(low.split())}
        for words in self.spaced(low):
            found.update(words)
        found.discard("")
        return found

    def spaced(self, low: str) -> Iterator[list[str]]:
        """Words restored from runs of single characters."""
        for match in SPACED.finditer(low):
            if sum(c.isalpha() for c in match[0]) >= 2:
                yield self._decode(match[0]).split()


def features(word: str, known: frozenset[str] | set[str] | None) -> list[str]:
    """The word if it is one of the known words, else its beginnings; all of them before any is known."""
    starts = [word[:n] + "*" for n in (4, 5, 6) if len(word) >= n]
    if known is None:
        return [word, *starts]
    return [word] if word in known else starts


def lower_bound(hits: float, n: float, z: float = 2.58) -> float:
    """Lower end of the Wilson interval for a share."""
    if not n:
        return 0.0
    p, q = hits / n, z * z / n
    return (p + q / 2 - z * math.sqrt(p * (1 - p) / n + q / (4 * n))) / (1 + q)


def _sketch(text: str) -> int:
    words = text.lower().split()
    found = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return min(xxhash.xxh3_64_intdigest(s) for s in found) - (1 << 63)


def _counts(rows: DataFrame, costs: np.ndarray, only: set[str] | None) -> DataFrame:
    """(feature, n, hits) over training rows (toxic, text); ``only`` limits the features."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, n, hits = Restorer(costs), Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                found = {f for w in restorer.words(text) for f in features(w, only)}
                if only is not None:
                    found &= only
                n.update(found)
                if toxic:
                    hits.update(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()),
             pa.array([hits[f] for f in n], pa.int64())],
            ["feature", "n", "hits"],
        )

    return (
        rows.select("toxic", "text")
        .mapInArrow(count, "feature string, n long, hits long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    )


class ToxicityModel:
    """Costs of the channel model, weight of each feature (words may weigh 0), base score."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], base: float) -> None:
        self.costs, self.weights, self.base = costs, weights, base
        self.restorer: Restorer | None = None
        self.held: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"restorer": None, "held": {}}

    def _weight(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word, self.weights.keys())), default=0.0)

    def _token(self, token: str) -> float:
        found = self.held.get(token)
        if found is None:
            if len(self.held) > 400_000:
                self.held.clear()
            words = self.restorer.word(token).split()
            found = self.held[token] = max(map(self._weight, words), default=0.0)
        return found

    def score(self, text: str) -> float:
        if self.restorer is None:
            self.restorer = Restorer(self.costs)
        low = text.lower()
        best = max(map(self._token, set(low.split())), default=0.0)
        for words in self.restorer.spaced(low):
            best = max(best, max(map(self._weight, words), default=0.0))
        return best or self.base


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_labels: int = 200_000, least: int = 5,
    id_col: str = "doc_id", text_col: str = "text",
) -> ToxicityModel:
    """Channel model from all texts, weights from labelled rows with crc32(id) mod 5 not 0."""
    costs = trigram_costs(docs, text_col)
    known = labels.select(
        named(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    ).where("toxic is not null")
    sample = (
        known.where(crc_mod(F.col("doc_id"), 5) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labels)
    )
    rows = id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_sketch(t) for t in strings(batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found],
                                             ["doc_id", "toxic", "sketch"])

    once = (
        rows.select("doc_id", "toxic", "text")
        .mapInArrow(sketch, "doc_id long, toxic int, sketch long")
        .groupBy("sketch")
        .agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
        .select("doc_id", "toxic")
        .toArrow()  # at most ``max_labels`` rows
    )
    n, hits = len(once), sum(once.column("toxic").to_pylist())
    if not n:
        return ToxicityModel(costs, {}, 0.0)
    chosen = docs.sparkSession.createDataFrame(once.to_pandas(), "doc_id long, toxic int")
    train = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    candidates = (
        _counts(train.where("toxic > 0"), costs, None)
        .where(F.col("n") >= least)
        .select("feature")
        .toArrow()  # of at most ``max_labels`` rows, ``least`` of which share each feature
    )
    only = set(candidates.column("feature").to_pylist())
    counted = _counts(train, costs, only).toArrow()  # no more rows than ``only``
    weights = {}
    for feature, m, h in zip(*(counted.column(c).to_pylist() for c in ("feature", "n", "hits"))):
        weight = lower_bound(h, m)
        if weight > hits / n or not feature.endswith("*"):
            weights[feature] = weight if weight > hits / n else 0.0
    return ToxicityModel(costs, weights, hits / n / 2)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled rows it was fitted on

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.score(t) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"]
            )

    return id_text(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(at))
            yield batch.filter(pa.array([held.value.score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

"""Alignment of the tokens of two tokenizers over the bytes they share.

Tokenizer A is a byte-level BPE of the tokenizers library, tokenizer B a sentencepiece BPE with
byte fallback. Both cover the bytes of space + text. With the incidence matrices A (A tokens by
bytes) and B (B tokens by bytes) in compressed rows, the Gustavson product A·Bᵀ holds the number of
bytes that two tokens share: its nonzeros are the ``overlap`` links. Those of them whose ranges end
at the same byte are the ``end`` links. The byte offsets where both sides end cut the tokens
into groups; the product of the two group incidences gives the ``group`` links.

Neither tokenizer joins a character that is not white space with a space behind it: A's word
splitting starts a word at such a space, and no piece of B has its space mark behind another
character. A text is therefore split at these places, and each distinct segment (a
word with the white space before it) is encoded and aligned once per batch of new segments; workers
hold a bounded table of them.

An ``end`` link joins two byte strings of which one is the end of the other. The distinct id
pairs are thus at most the sum of the byte lengths of both vocabularies, whatever the corpus:
:func:`pair_bound`. The corpus counts of these pairs are collected and sent to the tasks
under that bound, which :func:`align` checks.

Defined cases: a text that is null, empty, or that one side does not cover byte by byte (say a
U+2581 in it) has no tokens. Strings of special tokens are plain text. Rows that share a doc_id, or
that are repeated, are each counted and returned. A null doc_id is kept. Ties for the best A id of
a B id are all best. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocal.llm.common import id_text, strings, tokenizer_file
from aerocal.llm.csr import expand, one_per_column, one_per_row, row_products
from aerocal.session import materialise

SPACE_MARK = "▁"
#: A space that another white space character precedes: the text is not split before it.
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_B_BITS = 32


def byte_alphabet() -> dict[str, int]:
    """Letter to byte of a byte-level vocabulary: printable bytes are themselves, others follow 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(moved)): b for b in range(256)}


class Tokenizers:
    """Both tokenizers, the bytes of all their tokens, and their ids of single segments."""

    def __init__(self, a_file: str, b_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_alphabet()
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if set(entry) <= set(letters) else entry.encode()
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
            for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.lone = self.b.encode("a" + " ")[len(self.b.encode("a")) :]

    def ids(self, segments: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides for segments that start with a space; None where bytes differ."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in segments], num_threads=1)  # it adds the space
        found = []
        for segment, x, y in zip(segments, a, b):
            y = y if len(segment) > 1 else self.lone
            whole = segment.encode()
            same = b"".join([self.a_bytes[i] for i in x]) == whole == b"".join([self.b_bytes[i] for i in y])
            found.append((x, y) if same else None)
        return found


_HELD: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(a_name: str, b_name: str) -> Tokenizers:
    """One per worker process, from its own installation."""
    if (a_name, b_name) not in _HELD:
        _HELD[a_name, b_name] = Tokenizers(tokenizer_file(a_name), tokenizer_file(b_name))
    return _HELD[a_name, b_name]


@dataclass(frozen=True)
class Aligned:
    """Token runs over common bytes: ends of both sides, group of each token."""

    a_ends: np.ndarray
    b_ends: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    n_groups: int

    def overlap(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A token, B token, shared bytes) of all tokens with common bytes."""
        a = one_per_column(np.diff(self.a_ends, prepend=0))
        b = one_per_column(np.diff(self.b_ends, prepend=0))
        return row_products(a, b.transposed())

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        """Overlap links whose ranges end together."""
        a, b, _ = self.overlap()
        same = self.a_ends[a] == self.b_ends[b]
        return a[same], b[same]

    def group(self) -> tuple[np.ndarray, np.ndarray]:
        """All token pairs within a group."""
        a = one_per_row(self.a_group, self.n_groups)
        b = one_per_row(self.b_group, self.n_groups)
        return row_products(a, b.transposed())[:2]


def aligned(a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    """Align two runs of tokens with these byte lengths (equal in sum, none zero)."""
    a_ends, b_ends = np.cumsum(a_size), np.cumsum(b_size)
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return Aligned(a_ends, b_ends, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), len(cuts))


def segments(text: str) -> list[str]:
    """Space + text, cut before each space that follows a character other than white space."""
    if text[:1] == " " or text[-1:] == " " or _RUN.search(text):
        return _CUT.split(" " + text)
    return [" " + w for w in text.split(" ")]


class Aligner:
    """Numbers distinct segments and keeps what each contributes to a document."""

    def __init__(self, tokenizers: Tokenizers, kind: str, held: int = 400_000) -> None:
        self.tokenizers, self.kind, self.held = tokenizers, kind, held
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        #: A ids, B ids, groups, links, bad (bytes differ) of each segment.
        self.counts = np.zeros((0, 5), np.int64)
        self.pairs = np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Align segments that were not met before, all in one product."""
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])

    def _learn(self, new: list[str]) -> None:
        t = self.tokenizers
        ids = t.ids(new)
        empty: tuple = ((), ())
        n_a = np.array([len((x or empty)[0]) for x in ids])
        n_b = np.array([len((x or empty)[1]) for x in ids])
        a = np.array([i for x in ids if x for i in x[0]], np.int64)
        b = np.array([i for x in ids if x for i in x[1]], np.int64)
        both = aligned(t.a_size[a], t.b_size[b])
        left, right = {"end": both.end, "group": both.group, "overlap": lambda: both.overlap()[:2]}[self.kind]()
        owner = np.repeat(np.arange(len(new)), n_a)
        # segments end on both sides at once, so the groups of a segment are its own
        last = np.zeros(both.n_groups, np.int64)
        last[both.a_group] = owner
        n_groups = np.bincount(last, minlength=len(new))
        n_links = np.bincount(owner[left], minlength=len(new))
        a_size = np.bincount(both.a_group, minlength=both.n_groups).tolist()
        b_size = np.bincount(both.b_group, minlength=both.n_groups).tolist()
        a_text, b_text = iter(map(str, a.tolist())), iter(map(str, b.tolist()))
        sides = iter(
            [
                ",".join([next(a_text) for _ in range(x)]) + "|" + ",".join([next(b_text) for _ in range(y)])
                for x, y in zip(a_size, b_size)
            ]
        )
        self.text += [";".join([next(sides) for _ in range(n)]) for n in n_groups.tolist()]
        bad = np.array([x is None for x in ids])
        self.number.update(zip(new, range(len(self.counts), len(self.counts) + len(new))))
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links, bad], 1)])
        self.pairs = np.concatenate([self.pairs, (a[left] << _B_BITS) | b[right]])

    def documents(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """Counts, digest of the groups, and distinct pairs with counts of each text."""
        if len(self.number) > self.held:
            self.clear()
        split = [segments(t) if t else [] for t in texts]
        number = self.number
        new = list(dict.fromkeys([s for parts in split for s in parts if s not in number]))
        if new:
            self.learn(new)
        index = [[number[s] for s in parts] for parts in split]
        size = np.array([len(x) for x in index])
        flat = np.array([i for x in index for i in x], np.int64)
        ends = np.cumsum(size)
        counts = np.diff(np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.counts[flat], 0)])[
            np.concatenate([[0], ends])], axis=0)
        whole = counts[:, 4] == 0
        counts[~whole] = 0
        text = self.text
        digest = [
            hashlib.sha256(";".join([text[i] for i in x]).encode()).hexdigest() if ok and x else ""
            for x, ok in zip(index, whole.tolist())
        ]
        doc = np.repeat(np.arange(len(texts)), size)
        keep = whole[doc]
        key, times = np.unique(doc[keep] * len(self.counts) + flat[keep], return_counts=True)
        doc, seg = np.divmod(key, max(1, len(self.counts)))
        links = self.counts[seg, 3]
        first = (np.cumsum(self.counts[:, 3]) - self.counts[:, 3])[seg]
        pair = self.pairs[expand(first, links)]
        doc, times = np.repeat(doc, links), np.repeat(times, links)
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        new_at = np.flatnonzero(
            np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])[: len(doc)]
        )
        n = np.add.reduceat(times, new_at) if len(new_at) else times
        offsets = np.searchsorted(doc[new_at], np.arange(len(texts) + 1))
        return {"counts": counts, "digest": digest, "pairs": pair[new_at], "n": n, "offsets": offsets}


_ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<long>"
)


def document_pairs(
    docs: DataFrame, kind: str = "end", a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: its counts, digest of its groups, distinct linked id pairs.

    ``kind`` is ``end``, ``overlap`` or ``group``. A pair is ``a << 32 | b``; ``times`` counts its
    links in the document.
    """
    if kind not in ("end", "overlap", "group"):
        raise ValueError(f"unknown kind of link: {kind}")

    def align_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_tokenizers(a_name, b_name), kind)
        for batch in batches:
            for part in _blocks(batch):
                found = aligner.documents(strings(part.column(1)))
                offsets = pa.array(found["offsets"], pa.int32())
                columns = [part.column(0), *(pa.array(found["counts"][:, i]) for i in range(4))]
                columns += [pa.array(found["digest"], pa.string())]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(found[x])) for x in ("pairs", "n")]
                yield pa.RecordBatch.from_arrays(
                    columns,
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return id_text(docs, id_col, text_col).mapInArrow(align_batches, _ALIGNED)


def _blocks(batch: pa.RecordBatch, n_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``n_bytes`` of text each; a longer text is one slice."""
    if not len(batch):
        return
    size = np.cumsum([len(x or "") for x in batch.column(1).to_pylist()])
    block = size // n_bytes
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(batch)]
    for start, stop in zip(cuts, cuts[1:]):
        yield batch.slice(start, stop - start)


def pair_counts(aligned_docs: DataFrame) -> DataFrame:
    """(pair, count) over all documents; sums combine map-side."""
    return (
        aligned_docs.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.times").alias("count"))
    )


def token_pairs(docs: DataFrame, kind: str = "overlap", **names: str) -> DataFrame:
    """(a_id, b_id, count) of all linked id pairs of the corpus."""
    counted = pair_counts(document_pairs(docs, kind, **names))
    return counted.select(
        F.shiftright("pair", _B_BITS).cast("int").alias("a_id"),
        F.col("pair").bitwiseAND((1 << _B_BITS) - 1).cast("int").alias("b_id"),
        "count",
    )


def pair_bound(a_name: str, b_name: str) -> int:
    """Most distinct pairs that ``end`` links can have: a token's ends that are tokens of the other side."""
    t = _tokenizers(a_name, b_name)
    return int(t.a_size.sum() + t.b_size.sum())


def align(
    docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    ``n_best`` counts the ``end`` links whose id pair has the highest corpus count of its B id;
    ``count_sum`` sums the corpus counts over the links.
    """
    found = materialise(document_pairs(docs, "end", a_name, b_name, id_col, text_col), "aligned")
    counted = pair_counts(found).toArrow()
    if len(counted) > pair_bound(a_name, b_name):
        raise RuntimeError("more linked id pairs than the two vocabularies allow")
    pair = counted.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, count = pair[order], counted.column("count").to_numpy()[order]
    _, of = np.unique(pair & ((1 << _B_BITS) - 1), return_inverse=True)
    top = np.zeros(of.max() + 1 if len(of) else 0, np.int64)
    np.maximum.at(top, of, count)
    best = count == top[of]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, times = batch.column(6), batch.column(7).flatten().to_numpy()
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])

            def per_document(x: np.ndarray) -> pa.Array:
                return pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]).astype(np.int64))

            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], per_document(times * best[at]), per_document(times * count[at]), batch.column(5)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return found.mapInArrow(
        score,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string",
    )

"""Token ids of whole texts by an installed public tokenizer, word by word.

The tokenizer of ``word_bpe_49k.json`` lower-cases, drops white space and never joins
characters across it, so the ids of a text are the ids of its lower-cased, white-space
separated words in order. A batch is split and numbered by its distinct words; each word is
encoded once by the tokenizers library and held in a bounded table. A word of letters only,
which the tokenizer's normal form and word splitting leave as it is, goes straight to the
library's BPE model. Texts on which Python or Arrow and the tokenizer could disagree about
white space, case or normal form are encoded whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space to only one of the two sides, and letters whose lower case depends on context.
UNCLEAR = "[\\x1c-\\x1f᠎Σİ]"
_EMPTY = np.zeros(0, np.uint32)


def _byte_letters() -> list[str]:
    """Byte-level alphabet of the model: printable bytes stand for themselves, others follow 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(moved) for b in range(256)]


class WordEncoder:
    """``encode(texts)`` gives the ids of all texts in a row and the number of ids of each."""

    def __init__(self, path: str, held: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words come here once; its own table would only cost time
        self.letters = _byte_letters()
        self.held = held
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _word(self, word: str) -> bytes:
        found = self.new.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self._encode_word(word)
            self.new[word] = found
        return found

    def _encode_word(self, word: str) -> bytes:
        if word.isalpha():
            if not word.isascii():
                word = "".join(self.letters[b] for b in word.encode())
            return np.array([t.id for t in self.model.tokenize(word)], np.uint32).tobytes()
        core = word.rstrip(".,")
        if core.isalpha():
            return self._word(core) + self._word(word[len(core) :])
        return self._whole(word).tobytes()

    def encode(self, texts: pa.Array, step: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._some(texts[at : at + step]) for at in range(0, len(texts), step)]
        if not parts:
            return _EMPTY, np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, UNCLEAR).to_numpy(zero_copy_only=False).copy()
        wide = np.flatnonzero(~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False) & ~odd)
        for i in wide:
            odd[i] = not unicodedata.is_normalized("NFC", texts[int(i)].as_py())
        plain = pc.if_else(pa.array(~odd), texts, "")
        words = pc.utf8_split_whitespace(pc.utf8_lower(plain))
        per_text = pc.list_value_length(words).to_numpy()
        named = pc.dictionary_encode(words.flatten())
        if len(self.new) > self.held // 2:
            self.old, self.new = self.new, {}
        found = [self._word(w) if w else b"" for w in named.dictionary.to_pylist()]
        flat = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        index = named.indices.to_numpy()
        counts = size[index]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(first[index] - (ends - counts), counts) + np.arange(total)
        ids = flat[at] if total else _EMPTY
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        lengths = np.diff(bounds)
        if odd.any():
            pieces = np.split(ids, bounds[1:-1])
            for i in np.flatnonzero(odd):
                pieces[i] = self._whole(texts[int(i)].as_py())
                lengths[i] = len(pieces[i])
            ids = np.concatenate(pieces)
        return ids, lengths

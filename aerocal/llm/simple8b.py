"""Simple-8b coding of unsigned 64-bit values in blocks of 1,024.

A word has a 4-bit selector and 60 bits of payload: selector s > 0 packs COUNT[s] values of
WIDTH[s] bits, lowest first. Selector 0 is an escape: one value that needs over 60 bits, kept
raw behind the words of its block. Every block starts on a word of its own; the word
offset of each block and its number of words are stored, so that all blocks decode at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Fixed by the coding: values per word and bits per value for selectors 1 to 14.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTH = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint64)


def _bits(values: np.ndarray) -> np.ndarray:
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int8)


def _largest(bits: np.ndarray, span: int, done: dict[int, np.ndarray]) -> np.ndarray:
    """Largest of ``span`` values from each place on, from windows of half the span or more."""
    if span not in done:
        half = 1 << ((span - 1).bit_length() - 1)
        base = _largest(bits, half, done)
        out = base.copy()
        np.maximum(base[:, : -(span - half)], base[:, span - half :], out=out[:, : -(span - half)])
        done[span] = out
    return done[span]


def encode(values: np.ndarray, step: int = 256 * BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word offset of each block with the total behind them."""
    parts = [_encode(values[at : at + step]) for at in range(0, max(1, len(values)), step)]
    base = np.cumsum([0, *(len(w) for w, _ in parts)])
    offsets = [o[:-1] + b for (_, o), b in zip(parts, base)]
    return np.concatenate([w for w, _ in parts]), np.concatenate([*offsets, base[-1:]])


def _encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, BLOCK)
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = n - (blocks - 1) * BLOCK
    bits = _bits(padded).reshape(blocks, BLOCK)
    selector = np.zeros((blocks, BLOCK), np.int8)  # escape unless a selector fits
    done = {1: bits}
    for s in range(len(COUNT) - 1, 0, -1):
        np.copyto(selector, s, where=_largest(bits, int(COUNT[s]), done) <= int(WIDTH[s]))
    step = COUNT[selector]
    starts = np.zeros((blocks, BLOCK), bool)
    at, open_ = np.zeros(blocks, np.int64), np.arange(blocks)
    while len(open_):  # all blocks advance by one word
        starts[open_, at[open_]] = True
        at[open_] += step[open_, at[open_]]
        open_ = open_[at[open_] < sizes[open_]]
    where = np.flatnonzero(starts)
    chosen = selector.reshape(-1)[where].astype(np.int64)
    reach = np.concatenate([padded, np.zeros(64, np.uint64)])
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if s == 0:
            continue
        mine = chosen == s
        places = where[mine]
        # values beyond the end of a block are another block's and must not be packed
        stop = (places // BLOCK) * BLOCK + sizes[places // BLOCK]
        packed = np.zeros(len(places), np.uint64)
        for k in range(int(COUNT[s])):
            inside = places + k < stop
            packed |= np.where(inside, reach[places + k], 0).astype(np.uint64) << np.uint64(k * int(WIDTH[s]))
        words[mine] |= packed
    block_of = where // BLOCK
    raw = chosen == 0
    per_block = np.bincount(block_of, minlength=blocks) + np.bincount(block_of[raw], minlength=blocks)
    offsets = np.concatenate([[0], np.cumsum(per_block)]).astype(np.int64)
    out = np.zeros(offsets[-1], np.uint64)
    first = np.concatenate([[0], np.cumsum(np.bincount(block_of, minlength=blocks))])[:-1]
    out[offsets[block_of] + np.arange(len(where)) - first[block_of]] = words
    if raw.any():
        rank = np.arange(raw.sum()) - np.concatenate(
            [[0], np.cumsum(np.bincount(block_of[raw], minlength=blocks))]
        )[:-1][block_of[raw]]
        behind = offsets[:-1] + np.bincount(block_of, minlength=blocks)
        out[behind[block_of[raw]] + rank] = padded[where[raw]]
    return out, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values; the inverse of :func:`encode`."""
    if n == 0:
        return np.zeros(0, np.uint64)
    blocks = len(offsets) - 1
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = n - (blocks - 1) * BLOCK
    block_of = np.repeat(np.arange(blocks), np.diff(offsets))
    # raw words behind the packed ones of a block have any top bits; what they say is not used
    chosen = np.minimum((words >> np.uint64(60)).astype(np.int64), len(COUNT) - 1)
    counts = COUNT[chosen]
    before = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = before - before[offsets[:-1]][block_of]  # within the block; raw words lie past its size
    real = place < sizes[block_of]
    out = np.zeros(blocks * BLOCK + 64, np.uint64)
    base = block_of * BLOCK + place
    for s in np.unique(chosen[real]):
        mine = np.flatnonzero(real & (chosen == s))
        if s == 0:
            continue
        mask = np.uint64((1 << int(WIDTH[s])) - 1)
        room = sizes[block_of[mine]] - place[mine]
        for k in range(int(COUNT[s])):
            ok = room > k
            out[base[mine[ok]] + k] = (words[mine[ok]] >> np.uint64(k * int(WIDTH[s]))) & mask
    escaped = np.flatnonzero(real & (chosen == 0))
    if len(escaped):
        used = np.bincount(block_of[real], minlength=blocks)
        rank = np.arange(len(escaped)) - np.searchsorted(block_of[escaped], block_of[escaped])
        out[base[escaped]] = words[offsets[:-1][block_of[escaped]] + used[block_of[escaped]] + rank]
    return out[:n] if blocks == 1 else np.concatenate([out[: (blocks - 1) * BLOCK], out[(blocks - 1) * BLOCK : n]])

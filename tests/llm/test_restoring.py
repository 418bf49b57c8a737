"""Viterbi restoring against a listing of all readings; letters of the language model."""

import itertools
import random
import time

import numpy as np
import pytest

from aerocal.llm.language_id import LETTER
from aerocal.llm.toxicity import DROP, LOOKS, NOISE, REPEAT, SIZE, SWAP, Restorer, letter_class


def choices(chars):
    """Options (letters, cost) of each character."""
    out, before = [], ""
    for char in chars:
        if char.isalpha():
            found = [(char, 0.0)] + ([("", REPEAT)] if char == before else [])
        else:
            found = [(c, SWAP) for c in LOOKS.get(char, "")]
            if not found or char in NOISE:
                found.append(("", DROP))
            if char in " \t":
                found.append((" ", 0.0))
        out.append(found)
        before = char
    return out


def cheapest(costs, chars):
    """The least cost over every path of the lattice, and the readings that have it."""
    best, texts = float("inf"), set()
    for path in itertools.product(*choices(chars)):
        a = b = 0
        cost = 0.0
        for letter, extra in path:
            cost += extra
            if letter:
                c = letter_class(letter)
                cost, a, b = cost + costs[a][b][c], b, c
        cost += costs[a][b][0]
        if cost < best - 1e-9:
            best, texts = cost, set()
        if cost < best + 1e-9:
            texts.add("".join(letter for letter, _ in path))
    return texts


@pytest.fixture(scope="module")
def costs():
    return np.random.default_rng(5).uniform(0.1, 6, (SIZE, SIZE, SIZE))


def test_readings_are_the_cheapest_of_all_paths(costs):
    rng, restorer = random.Random(8), Restorer(costs)
    for _ in range(150):
        chars = "".join(rng.choice("aabbzéö01!|*#$ .-") for _ in range(rng.randint(1, 7)))
        assert restorer._decode(chars) in cheapest(costs, chars), chars


def test_time_grows_with_the_length_of_a_token(costs):
    rng, restorer, seconds = random.Random(9), Restorer(costs), []
    for size in (20_000, 160_000):
        chars = "".join(rng.choice("abcdefgh01!*#") for _ in range(size))
        began = time.perf_counter()
        assert restorer._decode(chars)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 24 * seconds[0] + 1  # eight times the length


@pytest.mark.parametrize("text", ["½ 123 ²", "", "12_3 ...", "①Ⅳ", "٣٤"])
def test_numbers_and_signs_are_no_letters(text):
    assert not LETTER.search(text)


@pytest.mark.parametrize("text", ["1 a", "é", "漢", "ß", "ª"])
def test_letters_of_any_script(text):
    assert LETTER.search(text)

"""Greedy string tiling against a plain search for the longest match."""

import time

import numpy as np

from hearthline.llm import decontam


def plain(text, item, least):
    text, item, out = list(text), list(item), []
    free_text, free_item = [x != 0 for x in text], [True] * len(item)
    while True:
        found = []
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and free_text[i + n] and free_item[j + n]:
                    n += 1
                found.append((-n, i, j))
        longest = -min(found, default=(0,))[0]
        if longest < least:
            return out
        for _, i, j in sorted(x for x in found if x[0] == -longest):
            if all(free_text[i : i + longest]) and all(free_item[j : j + longest]):
                free_text[i : i + longest] = free_item[j : j + longest] = [False] * longest
                out.append((i, j, longest))


def test_tiles_equal_the_plain_tiling():
    chance = np.random.default_rng(3)
    for _ in range(1500):
        text = chance.integers(0, chance.integers(2, 6), chance.integers(0, 26))
        item = chance.integers(1, chance.integers(2, 6), chance.integers(0, 16))
        least = int(chance.integers(1, 5))
        assert decontam.tiles(text, item, least) == plain(text, item, least)


def test_long_periodic_texts_end_soon():
    began = time.time()
    found = decontam.tiles(np.arange(20000) % 3 + 1, np.arange(3001) % 3 + 1)
    assert sum(n for _, _, n in found) == 3001 and time.time() - began < 5
    found = decontam.tiles(np.arange(20000) % 3 + 1, np.arange(20000) % 5 % 3 + 1)
    assert time.time() - began < 20

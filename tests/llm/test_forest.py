"""Reducing links in one task, and packing plans, against plain versions."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from tessergraph.llm import packing
from tessergraph.llm.common import forest
from tests.llm.test_text_operators import brute_components


def test_forest_on_chains():
    """500,000 links of a chain in random order and direction, within seconds."""
    draw = np.random.default_rng(1)
    names = draw.permutation(10**7)[:500_001].astype(np.int64)
    links = np.stack([names[:-1], names[1:]], 1)[draw.permutation(500_000)]
    flip = draw.random(500_000) < 0.5
    links[flip] = links[flip][:, ::-1]
    began = time.time()
    got = forest(pd.DataFrame(links, columns=["a", "b"]))
    assert time.time() - began < 5
    assert len(got) == 500_000 and (got["b"] == names.min()).all()


@pytest.mark.parametrize("seed", range(6))
def test_forest_on_random_links(seed):
    draw = random.Random(seed)
    links = [(draw.randint(-50, 200), draw.randint(-50, 200)) for _ in range(draw.choice([1, 20, 90, 300]))]
    got = forest(pd.DataFrame(links, columns=["a", "b"]))
    want = brute_components(links, {x for e in links for x in e})
    heads = dict(zip(got["a"], got["b"]))
    assert {n: heads.get(n, n) for n in want} == want and all(a != b for a, b in heads.items())


def optimum(counts, capacity):
    """The fewest sequences, by search over the pieces that are left."""
    from functools import cache

    lengths = [n for n in range(capacity, 0, -1) if counts[n]]

    @cache
    def best(left):
        if not any(left):
            return 0
        first = next(i for i, c in enumerate(left) if c)

        def fill(i, room, now):
            yield now
            for j in range(i, len(lengths)):
                if now[j] and lengths[j] <= room:
                    yield from fill(j, room - lengths[j], now[:j] + (now[j] - 1,) + now[j + 1 :])

        start = left[:first] + (left[first] - 1,) + left[first + 1 :]
        return 1 + min(best(x) for x in set(fill(first, capacity - lengths[first], start)))

    return best(tuple(int(counts[n]) for n in lengths))


def size(plan):
    return sum(times for _, times in plan)


@pytest.mark.parametrize("low, high", [(300, 700), (200, 800), (1, 1024), (100, 400), (330, 350), (250, 520), (900, 1024), (5, 6)])
def test_plans_are_whole_and_never_longer_than_best_fit(low, high):
    draw = np.random.default_rng(low)
    counts = np.bincount(draw.integers(low, high, 20_000), minlength=1025).astype(np.int64)
    made = packing.plan(counts)
    used = np.zeros_like(counts)
    for lengths, times in made:
        assert sum(lengths) <= 1024 and times > 0
        for n in lengths:
            used[n] += times
    assert (used == counts).all()
    assert size(made) <= size(packing.best_fit(counts))
    print(low, high, size(made), size(packing.best_fit(counts)), -(-int((counts * np.arange(1025)).sum()) // 1024))


@pytest.mark.parametrize("seed", range(12))
def test_small_plans_against_the_optimum(seed):
    draw = random.Random(seed)
    counts = np.zeros(21, np.int64)
    for _ in range(9):
        counts[draw.randint(1, 20)] += 1
    assert optimum(counts, 20) <= size(packing.plan(counts, 20)) <= optimum(counts, 20) + 1

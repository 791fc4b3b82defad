"""Conflict-free inputs against the scan in order."""

import random

import pytest

from strandline.operators import evidence as E


def scan(pairs):
    own, seen, taken = {}, set(), []
    for i, c in pairs:
        own.setdefault(i, set()).add(c)
    for i in sorted(own):
        if not own[i] & seen:
            taken.append(i)
            seen |= own[i]
    return taken


def accepted(spark, pairs):
    return sorted(r.ord for r in E.accepted_inputs(spark.createDataFrame(pairs, "ord long, chr string")).collect())


@pytest.mark.parametrize("seed, inputs, chroms, most", [(1, 60, 25, 3), (2, 80, 200, 4), (3, 40, 3, 2), (4, 150, 90, 2)])
def test_random_clashes(spark, seed, inputs, chroms, most):
    rnd = random.Random(seed)
    pairs = [(i, f"c{rnd.randrange(chroms)}") for i in rnd.sample(range(1000), inputs) for _ in range(rnd.randint(1, most))]
    assert accepted(spark, pairs + pairs[:5]) == scan(pairs)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    steps = []
    real = E.stored
    monkeypatch.setattr(E, "stored", lambda df, name: steps.append(name) or real(df, name))
    chain = [(i, f"c{j}") for i in range(1000) for j in (i, i + 1)]
    assert accepted(spark, chain) == list(range(0, 1000, 2))
    assert steps.count("waits") == 1 and steps.count("chains") < 15


def test_one_chromosome_of_many_inputs(spark):
    pairs = [(i, "hot") for i in range(500)] + [(i, f"c{i}") for i in range(250, 750)]
    assert accepted(spark, pairs) == scan(pairs) == [0] + list(range(500, 750))


def test_rows_that_say_nothing(spark):
    assert accepted(spark, [(None, "a"), (1, None), (3, "a"), (2, "a")]) == [2]
    assert accepted(spark, []) == []

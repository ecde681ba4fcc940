"""Connected components against a walk over the edges, in one task and by rounds."""

import random

import pytest

from tallybrook.llm import components


def walked(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(root)}


def path(n, seed):
    nodes = random.Random(seed).sample(range(10 * n), n)
    return list(zip(nodes, nodes[1:], strict=False))


RANDOM = [(random.Random(k).randrange(3000), random.Random(k + 10**6).randrange(3000)) for k in range(1800)]
ODD = [(1, 1), (None, 4), (5, None), (7, 6), (6, 7), (6, 7), (-3, 6), (2**62, -(2**62))]


@pytest.mark.parametrize("edges", [path(10_000, 1), list(zip(range(10_000), range(1, 10_001), strict=True)), RANDOM, ODD, []])
def test_components_in_one_task(spark, edges):
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == walked(edges)


@pytest.mark.parametrize("edges", [path(16, 2), RANDOM[:40], ODD])
def test_components_by_rounds(spark, monkeypatch, edges):
    monkeypatch.setattr(components, "HELD_EDGES", 2)
    found = components.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == walked(edges)


def test_stars_are_solved_in_few_rounds():
    u, v = map(list, zip(*path(200_000, 3), strict=True))
    nodes, least = components.least_nodes(components.np.array(u), components.np.array(v))
    assert len(nodes) == 200_000 and (least == min(nodes)).all()

"""Connected components against a plain form."""

import random

import pytest

from tallyrank.llm.components import components


def plain(edges):
    name = {}
    for a, b in edges:
        if a != b:
            x, y = name.setdefault(a, {a}), name.setdefault(b, {b})
            if x is not y:
                x |= y
                for node in y:
                    name[node] = x
    return {node: min(group) for node, group in name.items()}


def _random(seed):
    draw = random.Random(seed)
    return [(draw.randrange(120), draw.randrange(120)) for _ in range(80)]


@pytest.mark.parametrize("edges", [
    [], [(4, 4)], [(7, 2), (2, 7), (7, 2)],
    [(1, i) for i in range(2, 40)], [(50, i) for i in range(2, 40)],
    [(i, i + 1) for i in range(60)], [(9, 5), (9, 3), (3, 1), (8, 5)], _random(1), _random(2),
], ids=["none", "loop", "repeated", "star", "star-of-the-largest", "chain", "two-parents", "random", "random-again"])
def test_components_are_named_by_their_smallest_node(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == plain(edges) and len(got) == len(plain(edges))

import random

import numpy as np
import pytest
from foliate.llm import components as module
from foliate.llm.components import components, least_reached
from foliate.llm.workspace import Workspace


def brute(edges):
    least = {x: x for e in edges if None not in e for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a is not None and b is not None and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    return {x: c for x, c in least.items() if any(x in e and e[0] != e[1] for e in edges if None not in e)}


def graphs():
    rng = random.Random(4)
    yield "path", [(i, i + 1) for i in range(60)]
    yield "star", [(7, i) for i in range(40)]
    yield "random", [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    yield "loops, repeats and nulls", [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (6, 9)]
    yield "none", []


@pytest.mark.parametrize("task_edges", [500_000, 9])
@pytest.mark.parametrize("name,edges", list(graphs()))
def test_equals_brute_force(spark, monkeypatch, name, edges, task_edges):
    monkeypatch.setattr(module, "TASK_EDGES", task_edges)
    df = spark.createDataFrame(edges, "x long, y long").repartition(5)
    got = [(r.node, r.component) for r in components(Workspace(spark, "components"), df).collect()]
    assert len(got) == len(set(got)) and dict(got) == brute(edges)


def test_least_reached():
    assert least_reached(np.array([4, 3, 0]), np.array([3, 1, 5]), 6).tolist() == [0, 1, 2, 1, 1, 0]

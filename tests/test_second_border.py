"""Collective influence at two steps: sums over blocks of sources and ends against sets of neighbours."""

import random

import pytest

from fragspark.operators import centrality as C

EDGE = "network string, src long, dst long"


def ends(seed, n, m):
    rnd = random.Random(seed)
    return sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)})


def by_sets(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return {v: (len(near[v]) - 1) * sum(len(near[u]) - 1 for u in set().union(*(near[w] for w in near[v])) - near[v] - {v}) for v in near}


@pytest.mark.parametrize("side", [8_000_000, 40])
def test_two_steps_by_blocks(spark, side, monkeypatch):
    monkeypatch.setattr(C, "SIDE_EDGES", side)
    graphs = {"g": [*ends(1, 40, 90), (100, 100)], "hub": [(0, i) for i in range(1, 30)] + [(5, 6)], "pair": [(3, 9)]}
    rows = [(net, a, b) for net, pairs in graphs.items() for a, b in pairs]
    got = {}
    for r in C.collective_influence(spark.createDataFrame(rows, EDGE), 2).collect():
        got.setdefault(r.network, {})[r.v] = r.score
    assert got == {net: by_sets(pairs) for net, pairs in graphs.items()}


def test_paths_never_become_rows(spark):
    plan = C.collective_influence(spark.createDataFrame([("g", a, b) for a, b in ends(2, 30, 60)], EDGE), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # degrees with borders


@pytest.mark.parametrize("at_once, places", [(1, 1), (5, 60), (1000, 10_000)])
def test_batches_of_sources(at_once, places, monkeypatch):
    import numpy as np

    monkeypatch.setattr(C, "PATHS_AT_ONCE", at_once)
    monkeypatch.setattr(C, "PLACES", places)
    pairs = ends(4, 25, 50)
    near = [sorted({b if a == v else a for a, b in pairs if v in (a, b)}) for v in range(25)]
    start, flat = np.r_[0, np.cumsum([len(x) for x in near])], np.array([y for x in near for y in x])
    k = np.array([len(x) - 1.0 for x in near])
    got = C._second_border(start, flat, start, flat, np.arange(25), start, flat, k)
    assert got.tolist() == [sum(k[u] for u in {u for w in near[v] for u in near[w]} - set(near[v]) - {v}) for v in range(25)]

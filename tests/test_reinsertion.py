"""Reinsertion by rounds against union-find and the one-at-a-time order."""

import random

import numpy as np
import pytest

from fragspark.operators import kernels as K
from fragspark.operators import reinsertion as R
from fragspark.operators.reinsertion import reinserted


def largest_of(pairs, n, out):
    """Of every vertex that is not out, the size of its component."""
    near = {v: set() for v in range(n) if v not in out}
    for a, b in pairs:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    size = {}
    for v in near:
        if v not in size:
            seen, stack = {v}, [v]
            while stack:
                for u in near[stack.pop()] - seen:
                    seen.add(u)
                    stack.append(u)
            size.update(dict.fromkeys(seen, len(seen)))
    return size


def test_no_component_reaches_the_target_and_none_more_could_return(spark):
    graphs, targets = {}, {"tree": 8, "thin": 10, "hub": 6, "free": 100}
    for name, n, extra in (("tree", 50, 0), ("thin", 40, 14), ("free", 20, 3)):
        rnd = random.Random(name)
        graphs[name] = (sorted({(rnd.randrange(i), i) for i in range(1, n)} | {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(extra)}), n)
    graphs["hub"] = ([(0, i) for i in range(1, 30)], 30)
    gone = {name: {v for v in range(n) if random.Random(f"{name}{v}").random() < 0.5} for name, (_, n) in graphs.items()}
    gone["hub"] = set(range(1, 30))
    e = spark.createDataFrame([(g, a, b) for g, (pairs, _) in graphs.items() for a, b in pairs], "network string, src long, dst long")
    out = spark.createDataFrame([(g, v) for g, own in gone.items() for v in own] + [("tree", 999)], "network string, v long")
    got = {name: set() for name in graphs}
    for r in reinserted(e, out, spark.createDataFrame(list(targets.items()), "network string, target long")).collect():
        got[r.network].add(r.v)
    assert got["free"] == set() and len(got["hub"]) == 25
    for g, (pairs, n) in graphs.items():
        assert got[g] <= gone[g]
        now = largest_of(pairs, n, got[g])
        assert all(now[v] < targets[g] for v in gone[g] - got[g])
        for v in got[g]:
            assert largest_of(pairs, n, got[g] - {v})[v] >= targets[g]
        graph = K.Graph([a for a, _ in pairs], [b for _, b in pairs])
        assert len(got[g]) <= 1.3 * len(K.reinserted(graph, sorted(gone[g]), targets[g])) + 1


def test_empty_tables_repeated_rows_nulls_and_vertices_without_edges(spark):
    edge, vertex = "network string, src long, dst long", "network string, v long"
    target = spark.createDataFrame([("g", 3)], "network string, target long")
    assert reinserted(spark.createDataFrame([], edge), spark.createDataFrame([], vertex), target).collect() == []
    e = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 5, 5)], edge)
    out = spark.createDataFrame([("g", 2), ("g", 2), ("g", None), ("g", 5), ("other", 1)], vertex)
    assert [r.v for r in reinserted(e, out, target).collect()] == [2]


@pytest.mark.parametrize("rows, rounds", [(-1, True), (20, True), (1_000_000, False)])
def test_the_last_rows_go_to_one_task(spark, rows, rounds, monkeypatch):
    monkeypatch.setattr(R, "TASK_ROWS", rows)
    tables, write = [], R.written
    monkeypatch.setattr(R, "written", lambda df, name, *done: tables.append(name) or write(df, name, *done))
    test_no_component_reaches_the_target_and_none_more_could_return(spark)
    assert ("free" in tables) == rounds and ("rest" in tables) == (rows >= 0)


def test_vertices_that_wait_are_few():
    """A chain of removed vertices around one growing component: none is looked at again for every vertex that comes back."""
    n = 20_000
    out = R._stay(n, 15_000, np.array([5]), (np.arange(n), np.zeros(n, np.int64)), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert len(out) == n - (15_000 - 5 - 1) and out.tolist() == list(range(n - len(out), n))

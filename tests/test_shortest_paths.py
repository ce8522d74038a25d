"""Distances and numbers of shortest paths, by layers looked through whole or gathered, against a plain walk."""

import random

import numpy as np
import pandas as pd
import pytest

from fragspark.operators import centrality as C


def graph(kind):
    rnd = random.Random(2)
    pairs = {"path": [(i, i + 1) for i in range(60)], "dense": [(rnd.randrange(40), rnd.randrange(40)) for _ in range(300)], "two": [(0, 1), (1, 2), (7, 8)], "tails": [(i, j) for i in range(12) for j in range(i)] + [(20 + i, 21 + i) for i in range(40)] + [(0, 20)]}[kind]
    return sorted({tuple(sorted(p)) for p in pairs if p[0] != p[1]})


@pytest.mark.parametrize("kind", ["path", "dense", "two", "tails"])
def test_distances_and_paths(kind):
    ids, start, near = C._adjacency(pd.DataFrame(graph(kind), columns=["src", "dst"]))
    n, begins = len(ids), np.repeat(np.arange(len(ids)), np.diff(start))
    for s in range(n):
        dist, paths, layers = C._shortest(s, start, near, begins)
        far, many, f = {s: 0}, {s: 1}, [s]
        while f:
            step = {}
            for v in f:
                for u in near[start[v] : start[v + 1]]:
                    if u not in far:
                        step[u] = step.get(u, 0) + many[v]
            far.update(dict.fromkeys(step, len(set(far.values()))))
            many.update(step)
            f = list(step)
        assert dist.tolist() == [far.get(v, -1) for v in range(n)]
        assert paths.tolist() == [many.get(v, 0) for v in range(n)]
        assert sum(len(b) for b, _ in layers) == sum(far.get(a, -9) + 1 == far.get(b, -5) for a, b in zip(begins, near, strict=True))

"""Attacks whose degrees and components are kept as tables, against recomputation from scratch."""

import random

import numpy as np
import pytest

from fragspark.operators import kernels as K
from fragspark.operators import live as L
from fragspark.operators import replay as R

EDGE = "network string, src long, dst long"


def random_edges(seed, n, m, net="g"):
    rnd = random.Random(seed)
    return sorted({(net, *sorted(rnd.sample(range(n), 2))) for _ in range(m)})


def sizes(rows, gone):
    left = [(a, b) for _, a, b in rows if a not in gone and b not in gone]
    ids = sorted({v for _, a, b in rows for v in (a, b)} - gone)
    place = {v: i for i, v in enumerate(ids)}
    union = K.Union(len(ids))
    for a, b in left:
        union.join(place[a], place[b])
    return max((union.size[union.find(i)] for i in range(len(ids))), default=0)


@pytest.mark.parametrize("block", [1, 4])
def test_orders_equal_recomputed_degrees(spark, block):
    graphs = {"g": random_edges(1, 26, 40), "h": random_edges(2, 18, 22, "h")}
    e = spark.createDataFrame([r for rows in graphs.values() for r in rows], EDGE)
    got = {}
    for r in L.adaptive_degree_order(e, 0.25, block, compact_every=3).collect():
        got.setdefault(r.network, {})[r.removal_num] = (r.v, r.score)
    for net, rows in graphs.items():
        vertices, gone, want = {v for _, a, b in rows for v in (a, b)}, set(), []
        while sizes(rows, gone) > np.ceil(len(vertices) * 0.25):
            d = {v: sum(v in (a, b) and a not in gone and b not in gone for _, a, b in rows) for v in vertices - gone}
            new = sorted(d, key=lambda v: (-d[v], v))[:block]
            want += [(v, float(d[v])) for v in new]
            gone |= set(new)
        want += [(v, None) for v in sorted(vertices - gone)]
        assert [got[net][i] for i in range(1, len(vertices) + 1)] == want


@pytest.mark.parametrize("candidates", [3, 7, 1000])
def test_leaps_are_few_and_change_no_order(spark, candidates, monkeypatch):
    e = spark.createDataFrame(random_edges(7, 60, 150) + random_edges(8, 30, 40, "h") + [("h", 99, 99)], EDGE)
    leaps, leap = [], L._leap
    monkeypatch.setattr(L, "_leap", lambda *a: leaps.append(1) or leap(*a))
    got = sorted(tuple(r) for r in L.adaptive_degree(e, 0.2, 2, candidates).select("network", "removal_num", "id", "lcc", "slcc").collect())
    want = sorted(tuple(r) for r in R.adaptive_degree_curve(e, 0.2, 2).select("network", "removal_num", "id", "lcc", "slcc").collect())
    assert got == want and (candidates < 1000 or len(leaps) <= 2)


def test_batches_read_only_the_components_they_touch(spark):
    rows = random_edges(3, 20, 30) + [("g", 100 + a, 100 + b) for _, a, b in random_edges(4, 20, 30)]
    e = spark.createDataFrame(rows, EDGE)
    order = [*range(0, 8), *range(100, 108)]
    ranks = spark.createDataFrame([("g", v, i) for i, v in enumerate(order, 1)], "network string, v long, removal_num int")
    got = sorted(tuple(r) for r in L.batched_sizes(e, ranks, 4).collect())
    assert [(r[1], r[2]) for r in got] == [(k, sizes(rows, set(order[:k]))) for k in (4, 8, 12, 16)]
    assert all(r[3] < r[4] for r in got)

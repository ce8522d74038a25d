"""Tours, sizes and centroids of forests against the greedy walk of one tree in memory."""

import random

import pytest

from fragspark.operators import forest as T
from fragspark.operators import kernels as K
from fragspark.operators.components import components
from fragspark.operators.ranges import numbered, with_next

EDGE = "network string, src long, dst long"


def tree(seed, n, near=3):
    rnd = random.Random(seed)
    names = rnd.sample(range(1000), n)
    return sorted(tuple(sorted((names[i], names[rnd.randrange(max(0, i - near), i)]))) for i in range(1, n))


def test_places_and_next_rows(spark):
    rows = [(i % 3, i * 7 % 50) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(4)
    want = sorted(rows)
    assert sorted((r.place, r.a, r.b) for r in numbered(df, ["a", "b"]).collect()) == [(i, *x) for i, x in enumerate(want)]
    nexts = {(r.a, r.b): tuple(r.next) if r.next else None for r in with_next(df, ["a", "b"], ["a", "b"]).collect()}
    assert nexts == dict(zip(want, [*want[1:], None], strict=True))


@pytest.mark.parametrize("stop", [1, 6])
def test_parallel_splits_equal_the_greedy_ones(spark, stop):
    graphs = {"path": [(i, i + 1) for i in range(25)], "bush": tree(1, 30, 30), "long": tree(2, 28), "star": [(0, i) for i in range(1, 9)], "two": tree(3, 12) + [(2000 + a, 2000 + b) for a, b in tree(4, 11)]}
    rows = [(g, a, b) for g, pairs in graphs.items() for a, b in pairs]
    most = spark.createDataFrame([(g, stop) for g in graphs], "network string, most long")
    got = T.broken_trees(spark.createDataFrame(rows, EDGE), most).collect()
    for g, pairs in graphs.items():
        near = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        ids = sorted(near)
        place = {v: i for i, v in enumerate(ids)}
        want = K.tree_break([{place[y] for y in near[v]} for v in ids], set(range(len(ids))), stop)
        assert {r.v for r in got if r.network == g} == {ids[i] for i in want}
        sizes = [r.size for r in sorted((r for r in got if r.network == g), key=lambda r: -r.size)]
        assert all(s > stop for s in sizes)


def test_cycles_raise_and_no_edges_give_nothing(spark):
    ring = spark.createDataFrame([("g", 0, 1), ("g", 1, 2), ("g", 0, 2), ("g", 2, 3)], EDGE)
    with pytest.raises(ValueError, match="cycle"):
        T.subtree_sizes(ring, components(ring))
    assert T.broken_trees(ring.limit(0), spark.createDataFrame([("g", 1)], "network string, most long")).count() == 0


def test_shallow_trees_are_not_toured(spark, monkeypatch):
    def toured(*_, **__):
        raise AssertionError("toured")

    monkeypatch.setattr(T, "tours", toured)
    pairs = [(0, i) for i in range(1, 6)] + [(i, 10 * i + j) for i in range(1, 6) for j in range(8)] + [(500, 501)]
    e = spark.createDataFrame([("g", a, b) for a, b in pairs], EDGE)
    got = T.centroids(e, components(e)).collect()
    assert sorted((r.component, r.v, r.worst, r.size) for r in got) == [(0, 0, 9, 46), (500, 500, 1, 2)]


@pytest.mark.parametrize("leaves", [0.0, 0.125, 2.0])
def test_leaves_and_tours_give_the_same_centroids(spark, monkeypatch, leaves):
    graphs = {"path": [(i, i + 1) for i in range(25)], "bush": tree(1, 30, 30), "comb": [(i, i + 1) for i in range(12)] + [(i, 100 + 10 * i + j) for i in range(13) for j in range(i % 4)]}
    rows = [(g, a, b) for g, pairs in graphs.items() for a, b in pairs]
    e = spark.createDataFrame(rows, EDGE)
    want = {}
    for g, pairs in graphs.items():
        vertices = sorted({v for p in pairs for v in p})

        def worst(gone, pairs=pairs, vertices=vertices):
            label = {v: v for v in vertices}
            for _ in vertices:
                for a, b in pairs:
                    if gone not in (a, b):
                        label[a] = label[b] = min(label[a], label[b])
            return max(list(label.values()).count(c) for v, c in label.items() if v != gone)

        want[g] = min((worst(v), v) for v in vertices) + (len(vertices),)
    monkeypatch.setattr(T, "LEAVES", leaves)
    assert {r.network: (r.worst, r.v, r.size) for r in T.centroids(e, components(e)).collect()} == want
    ring = spark.createDataFrame([("g", 0, 1), ("g", 1, 2), ("g", 0, 2), ("g", 2, 3)], EDGE)
    with pytest.raises(ValueError, match="cycle"):
        T.centroids(ring, components(ring))

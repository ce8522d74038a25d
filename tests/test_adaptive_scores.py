"""Adaptive attacks that find again only what a removal could have moved to the front: the same as scoring all vertices each time."""

import numpy as np

from fragspark.operators import kernels as K


def random_graph(rng, n: int, m: int) -> K.Graph:
    a, b = rng.integers(0, n, (2, m))
    return K.Graph(a[a != b], b[a != b])


def plain_closeness(near: list[set[int]]) -> np.ndarray:
    out = np.zeros(len(near))
    for s in range(len(near)):
        order, dist = [s], {s: 0}
        for x in order:
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    order.append(y)
        if len(order) > 1:
            out[s] = (len(order) - 1) / sum(dist.values())
    return out


def plainly(graph: K.Graph, scores) -> list[tuple[int, float]]:
    """All vertices scored again before each removal, until no edge is left."""
    near, gone, out = [set(x) for x in graph.near], set(), []
    while any(near):
        score = np.round(scores(near), 9)
        v = max((v for v in range(graph.n) if v not in gone), key=lambda v: (score[v], -v))
        for y in near[v]:
            near[y].discard(v)
        near[v] = set()
        gone.add(v)
        out.append((v, float(score[v])))
    return out


def test_adaptive_closeness_is_that_of_all_vertices():
    rng = np.random.default_rng(5)
    graphs = [random_graph(rng, n, m) for n, m in ((4, 3), (12, 11), (20, 30), (30, 90))]
    graphs += [K.Graph(range(12), range(1, 13)), K.Graph([0] * 8 + [10, 11], [*range(1, 9), 11, 12])]
    for g in graphs:
        got = K.adaptive(g, "closeness", 0)
        assert [r[:2] for r in got] == plainly(g, plain_closeness)


def test_adaptive_closeness_searches_from_few_vertices(monkeypatch):
    g, asked, search = random_graph(np.random.default_rng(6), 200, 1000), [], K.distances
    monkeypatch.setattr(K, "distances", lambda s, *rest: asked.append(s) or search(s, *rest))
    removals = len(K.adaptive(g, "closeness", 20))
    assert removals > 50
    assert len(asked) < 0.2 * removals * g.n


def plain_betweenness(near: list[set[int]]) -> np.ndarray:
    total = np.zeros(len(near))
    for s in range(len(near)):
        order, dist, paths, part = [s], {s: 0}, {s: 1.0}, {}
        for x in order:
            for y in near[x]:
                if y not in dist:
                    dist[y], paths[y] = dist[x] + 1, 0.0
                    order.append(y)
                if dist[y] == dist[x] + 1:
                    paths[y] += paths[x]
        for y in reversed(order[1:]):
            for x in near[y]:
                if dist[x] == dist[y] - 1:
                    part[x] = part.get(x, 0.0) + paths[x] / paths[y] * (1 + part.get(y, 0.0))
            total[y] += part.get(y, 0.0)
    return total


def test_betweenness_by_blocks_of_sources(monkeypatch):
    rng = np.random.default_rng(7)
    graphs = [random_graph(rng, n, m) for n, m in ((4, 3), (15, 14), (30, 45), (40, 160))] + [K.Graph(range(12), range(1, 13))]
    for cost in (0.01, 8, 1e6):  # rows of all sources, both, single cells
        for cells in (50, 1 << 22):
            monkeypatch.setattr(K, "SPARSE_COST", cost)
            monkeypatch.setattr(K, "BLOCK_CELLS", cells)
            for g in graphs:
                assert np.allclose(K.live_betweenness(g.near), plain_betweenness(g.near), atol=1e-9)
                assert [r[:2] for r in K.adaptive(g, "betweenness", 0)] == plainly(g, plain_betweenness)
